"""Cuts a JSON array into its elements' texts, wherever its blocks begin.

A file is read in blocks that end after a comma, where no escape is open.  What a block does depends
on what came before it in two ways only: whether it begins inside a string, and how deep.  So each
block tells its end for both cases, at depths counted from its own start; these few numbers, put in
order, give every block's true start, and then each is cut by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

BLOCK_BYTES = 1 << 20
_BLANKS = b" \t\r\n"
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)|[\[\]{},]', re.DOTALL)
_STRING_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+("?)', re.DOTALL)


class Effect(NamedTuple):
    """What a block does: whether it ends inside a string, its change of depth, its least depth after
    a closing bracket, and its commas at depths up to 1, all depths from its start."""

    inside: bool
    change: int
    least: int
    depths: list[int]
    commas: list[int]


class Start(NamedTuple):
    """A block's place in the file, and how it begins; ``element`` is the place in the array."""

    place: int
    inside: bool
    depth: int
    element: int


def effect(block: bytes, inside: bool) -> Effect:
    at, depth, least, commas = 0, 0, 1, Counter()
    if inside:
        rest = _STRING_REST.match(block)
        at, inside = rest.end(), not rest[1]
    if not inside:
        for m in _TOKEN.finditer(block, at):
            c = block[m.start()]
            if c == 44:
                if depth <= 1:
                    commas[depth] += 1
            elif c == 34:
                inside = not m[1]
            elif c in b"[{":
                depth += 1
            else:
                depth -= 1
                least = min(least, depth)
    return Effect(inside, depth, least, list(commas), list(commas.values()))


def opens(block: bytes) -> bool:
    """Whether a file's first block begins an array."""
    return block.lstrip(_BLANKS).startswith(b"[")


def starts(effects: Iterable[tuple[Effect, Effect]]) -> tuple[list[Start], bool]:
    """The starts of a file's blocks up to the array's end, by their effects outside and inside a string,
    and whether the array ends; what follows it isn't looked at, as in Spark's parser."""
    found, inside, depth, element = [], False, 0, 0
    for place, cases in enumerate(effects):
        found.append(Start(place, inside, depth, element))
        own = cases[inside]
        if depth + own.least <= 0:
            return found, True
        element += sum(n for d, n in zip(own.depths, own.commas, strict=True) if depth + d == 1)
        inside, depth = own.inside, depth + own.change
    return found, False


def cut(block: bytes, start: Start) -> Iterator[tuple[int, bool, bytes]]:
    """(element, whole, text): the block's elements; parts that a neighbour may go on with are not whole."""
    _, inside, depth, element = start
    begin, at, whole = 0, 0, False
    if not start.place:
        begin = at = block.index(b"[") + 1
        depth, whole = 1, True
    if inside:
        rest = _STRING_REST.match(block)
        if not rest[1]:
            yield element, False, block
            return
        at = rest.end()
    for m in _TOKEN.finditer(block, at):
        c = block[m.start()]
        if c == 44:
            if depth == 1:
                yield element, whole, block[begin : m.start()]
                element, begin, whole = element + 1, m.end(), True
        elif c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
            if not depth:
                # a wrong bracket stays in the text, which then is none
                text = block[begin : m.start() if c == 93 else m.end()]
                if element or text.strip(_BLANKS):
                    yield element, whole, text
                return
    if begin < len(block):
        yield element, False, block[begin:]
