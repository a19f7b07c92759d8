"""Outcomes of operations: seven codes, as a value and as an exception."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Code(Enum):
    OKAY = "okay"
    NOT_FOUND = "not found"
    CORRUPTION = "corruption"
    NOT_SUPPORTED = "not supported"
    INVALID_ARGUMENT = "invalid argument"
    IO_ERROR = "io error"
    INTERNAL_ERROR = "internal error"


@dataclass(frozen=True)
class Status:
    code: Code = Code.OKAY
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.code is Code.OKAY

    def __bool__(self) -> bool:
        return self.ok


OK = Status()


class QuarryError(Exception):
    """An operation's failure, with its status."""

    def __init__(self, code: Code, message: str):
        super().__init__(message)
        self.status = Status(code, message)


def guarded(action) -> Status:
    """Runs an action and turns its outcome into a status."""
    try:
        action()
    except QuarryError as e:
        return e.status
    return OK
