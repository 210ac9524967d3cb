"""Errors of the dialect."""

from __future__ import annotations

import difflib


class SqlError(ValueError):
    """A statement that the dialect refuses; the message says what to write instead, where there is something."""


class BudgetError(RuntimeError):
    """A call that the remaining budget does not cover."""


def unknown(kind: str, name: str, known) -> SqlError:
    """'unknown column' and the like, with the nearest known name."""
    near = difflib.get_close_matches(name.lower(), [str(k).lower() for k in known], 1, 0.6)
    return SqlError(f"unknown {kind} {name}" + (f"; did you mean {near[0]}?" if near else ""))
