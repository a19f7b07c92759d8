"""One document on the driver: an id, a JSON object, and the updates that Spark applies to many."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from docquarry.operators.update import OPERATORS
from docquarry.status import Code, QuarryError


def same(a: Any, b: Any) -> bool:
    """Deep JSON equality: 1 equals 1.0, but no boolean equals a number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def _holder(data: dict, path: str) -> tuple[dict, str] | None:
    """The object that holds a dotted name's last part, if the path and the part exist."""
    *steps, last = path.split(".")
    here: Any = data
    for step in steps:
        if isinstance(here, list) and step.isdigit() and step.isascii() and int(step) < len(here):
            here = here[int(step)]
        elif isinstance(here, dict) and step in here:
            here = here[step]
        else:
            return None
    return (here, last) if isinstance(here, dict) and last in here else None


@dataclass
class Document:
    id: str
    data: dict = field(default_factory=dict)

    def has_field(self, name: str) -> bool:
        return name in self.data

    def get_value(self, name: str) -> Any:
        if name not in self.data:
            raise QuarryError(Code.NOT_FOUND, f"no field {name}")
        return self.data[name]

    def set_value(self, name: str, value: Any) -> None:
        self.data[name] = value

    def to_json(self) -> str:
        return json.dumps(self.data, sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, doc_id: str, text: str) -> Document:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise QuarryError(Code.CORRUPTION, f"no JSON text: {e}") from e
        if not isinstance(data, dict):
            raise QuarryError(Code.INVALID_ARGUMENT, "a document is an object")
        return cls(doc_id, data)

    def apply_update(self, update: dict) -> None:
        """The same result as the compiled update, on this document alone."""
        for op in OPERATORS:
            for name, value in sorted(update.get(op, {}).items()):
                getattr(self, "_" + op[1:])(name, value)

    def _set(self, name: str, value: Any) -> None:
        if "." not in name:
            self.data[name] = value
        elif at := _holder(self.data, name):
            at[0][at[1]] = value

    def _unset(self, name: str, _: Any) -> None:
        if "." not in name:
            self.data.pop(name, None)
        elif at := _holder(self.data, name):
            del at[0][at[1]]

    def _push(self, name: str, value: Any) -> None:
        old = self.data.get(name)
        if name not in self.data:
            self.data[name] = value
        elif isinstance(old, list):
            self.data[name] = [*old, value]
        else:
            self.data[name] = [old, value]

    def _pull(self, name: str, value: Any) -> None:
        if name not in self.data:
            return
        old = self.data[name]
        if isinstance(old, list):
            self.data[name] = [x for x in old if not same(x, value)]
        elif same(old, value):
            del self.data[name]
        else:
            self.data[name] = value
