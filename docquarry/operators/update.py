"""Document updates as column expressions.

Operators apply in the order ``$pull``, ``$push``, ``$set``, ``$unset``, and fields in the order of
their names.  An update compiles once into an expression from a document to a document
and then runs over one document or many.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import variants as V
from docquarry.status import Code, QuarryError

OPERATORS = ("$pull", "$push", "$set", "$unset")


def _at_path(value: Column, steps: list[str], leaf) -> Column:
    """Rebuilds the values on a path around a changed object; a broken path changes nothing.
    ``leaf`` makes the new object from the one that holds the last name."""
    name = steps[0]
    member = V.get(value, name)
    if len(steps) == 1:
        return F.when(V.is_object(value) & member.isNotNull(), leaf(value, name)).otherwise(value)
    inside = V.with_member(value, name, V.let(member, lambda m: _at_path(m, steps[1:], leaf)))
    changed = F.when(V.is_object(value) & member.isNotNull(), inside)
    if name.isdigit() and name.isascii():
        place = int(name)
        items = V.as_array(value)
        replaced = V.pack(F.transform(items, lambda x, i: F.when(i == place, _at_path(x, steps[1:], leaf)).otherwise(x)))
        changed = changed.when(V.is_array(value) & (F.size(items) > place), replaced)
    return changed.otherwise(value)


Step = Callable[[Column], Column]


def _put(members: Column, new: dict[str, Column]) -> Column:
    """The members with some set."""
    others = F.map_filter(members, lambda k, _: ~k.isin(*new))
    return F.map_concat(others, F.create_map(*(x for name, v in new.items() for x in (F.lit(name), v))))


def _drop(members: Column, names: list[str]) -> Column:
    return F.map_filter(members, lambda k, _: ~k.isin(*names))


def _inside(members: Column, path: str, leaf) -> Column:
    """Changes below a member; a missing one changes nothing."""
    first, *rest = path.split(".")
    member = F.element_at(members, first)
    return F.when(member.isNull(), members).otherwise(_put(members, {first: V.let(member, lambda m: _at_path(m, rest, leaf))}))


def _set_below(path: str, value: Any) -> Step:
    """A dotted name overwrites what exists, only."""
    return lambda m: _inside(m, path, lambda obj, last: V.with_member(obj, last, V.literal(value)))


def _unset_below(path: str) -> Step:
    return lambda m: _inside(m, path, lambda obj, last: V.without_member(obj, last))


def _push(name: str, value: Any) -> Step:
    """Appends to an array; makes an array of another value and the new one; a missing
    field becomes the value itself."""

    def step(m: Column) -> Column:
        new = V.literal(value)
        added = lambda old: F.when(old.isNull(), new).when(V.is_array(old), V.pack(F.array_append(V.as_array(old), new))).otherwise(V.pack(F.array(old, new)))
        return _put(m, {name: V.let(F.element_at(m, name), added)})

    return step


def _pull(name: str, value: Any) -> Step:
    """Removes all equal elements of an array; another value is erased if equal and
    overwritten if not; a missing field stays missing."""

    def step(m: Column) -> Column:
        old = F.element_at(m, name)
        kept = V.let(old, lambda o: V.pack(F.filter(V.as_array(o), lambda x: ~V.equals(x, value))))
        return F.when(old.isNull(), m).when(V.is_array(old), _put(m, {name: kept})).when(V.equals(old, value), _drop(m, [name])).otherwise(_put(m, {name: V.literal(value)}))

    return step


def _steps(update: dict) -> list[Step]:
    """Plain names set or unset next to each other make one step."""
    steps: list[Step] = []
    for op in OPERATORS:
        body = update.get(op, {})
        if not isinstance(body, dict):
            raise QuarryError(Code.INVALID_ARGUMENT, f"{op} takes an object")
        plain = sorted(n for n in body if "." not in n)
        dotted = sorted(n for n in body if "." in n)
        if op == "$pull":
            steps += [_pull(n, body[n]) for n in sorted(body)]
        elif op == "$push":
            steps += [_push(n, body[n]) for n in sorted(body)]
        elif op == "$set":
            # in order of names: a plain name comes before the dotted ones below it
            if plain:
                steps.append(lambda m, names=plain, b=body: _put(m, {n: V.literal(b[n]) for n in names}))
            steps += [_set_below(n, body[n]) for n in dotted]
        else:
            if plain:
                steps.append(lambda m, names=plain: _drop(m, names))
            steps += [_unset_below(n) for n in dotted]
    return steps


def compile_update(data: Column, update: Any) -> Column:
    """The updated document; unknown operators are ignored.

    The document is opened into its members once, whatever the number of operators, and what
    isn't an object stays as it is.
    """
    if not isinstance(update, dict):
        raise QuarryError(Code.INVALID_ARGUMENT, "an update is an object")
    steps = _steps(update)
    if not steps:
        return data
    members = V.as_map(data)
    for step in steps:
        members = _bound(members, step)
    return F.coalesce(V.pack(members), data)


def _bound(members: Column, step: Step) -> Column:
    return V.let(members, lambda m: step(m))
