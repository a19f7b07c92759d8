"""The query language: parsing and validation into a small tree.

A query is an object of operators.  Operators run in the order of their names and their
results follow one another: two operators on one level are a concatenation, not a conjunction.

Only indexed fields can be compared.  A comparison that breaks a rule contributes nothing
and leaves a status; inside ``$and`` and ``$or`` it empties the whole query.
"""

from __future__ import annotations

from collections.abc import Set
from dataclasses import dataclass, field
from typing import Any

from docquarry.status import OK, Code, QuarryError, Status


@dataclass(frozen=True)
class Cmp:
    """One comparison: op is eq, gt or lt; the value is a JSON scalar."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class All:
    parts: tuple[Cmp, ...]


@dataclass(frozen=True)
class Any_:
    parts: tuple[Cmp, ...]


@dataclass(frozen=True)
class OrderBy:
    field: str
    ascending: bool


Node = Cmp | All | Any_ | OrderBy


@dataclass
class Query:
    """Operators with their places in the order of names, and the last failure."""

    nodes: list[tuple[int, Node]] = field(default_factory=list)
    status: Status = OK


def _comparison(op: str, body: Any, indexed: Set[str]) -> Cmp:
    if not isinstance(body, dict) or not body:
        raise QuarryError(Code.INVALID_ARGUMENT, f"{op} takes an object with one field")
    name = min(body)
    value = body[name]
    if isinstance(value, (dict, list)):
        raise QuarryError(Code.INVALID_ARGUMENT, f"{op} compares with a scalar, not with an object or array")
    if op != "$eq" and (value is None or value == ""):
        raise QuarryError(Code.INVALID_ARGUMENT, f"{op} has no value to compare with")
    if name not in indexed:
        code = Code.INVALID_ARGUMENT if op == "$eq" else Code.NOT_FOUND
        raise QuarryError(code, f"field {name} has no index")
    return Cmp(op[1:], name, value)


def _comparisons(op: str, items: Any, indexed: Set[str]) -> tuple[Cmp, ...]:
    """All comparisons of all items; anything but the three comparisons is refused."""
    if not isinstance(items, list):
        return ()
    found = []
    for item in items:
        if not isinstance(item, dict):
            raise QuarryError(Code.INVALID_ARGUMENT, f"{op} takes objects")
        for inner in sorted(item):
            if inner not in ("$eq", "$gt", "$lt"):
                raise QuarryError(Code.INVALID_ARGUMENT, f"{inner} is not supported inside {op}")
            found.append(_comparison(inner, item[inner], indexed))
    return tuple(found)


def parse(query: Any, indexed: Set[str], strict: bool = False) -> Query:
    """The tree of a query.  With ``strict`` the first broken rule raises."""
    if not isinstance(query, dict):
        raise QuarryError(Code.INVALID_ARGUMENT, "a query is an object")
    tree = Query()
    for place, op in enumerate(sorted(query)):
        body = query[op]
        try:
            if op in ("$eq", "$gt", "$lt"):
                tree.nodes.append((place, _comparison(op, body, indexed)))
            elif op in ("$and", "$or"):
                try:
                    parts = _comparisons(op, body, indexed)
                except QuarryError as e:
                    if strict:
                        raise
                    return Query([], e.status)
                if parts:
                    tree.nodes.append((place, All(parts) if op == "$and" else Any_(parts)))
            elif op == "$orderBy":
                if not isinstance(body, dict) or not body:
                    raise QuarryError(Code.INVALID_ARGUMENT, "$orderBy takes an object with one field")
                name = min(body)
                if name not in indexed:
                    raise QuarryError(Code.NOT_FOUND, f"field {name} has no index")
                tree.nodes.append((place, OrderBy(name, body[name] == "asc")))
            elif strict:
                raise QuarryError(Code.INVALID_ARGUMENT, f"unknown operator {op}")
        except QuarryError as e:
            if strict:
                raise
            tree.status = e.status
    return tree
