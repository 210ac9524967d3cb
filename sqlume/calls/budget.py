"""Budgets: calls are reserved before they are made and settled afterwards."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from sqlume.errors import BudgetError


@dataclass
class Budget:
    """Limits of a session; None is no limit."""

    calls: float | None = None
    tokens: float | None = None
    dollars: float | None = None
    depth: int = 2
    used_calls: float = 0
    used_tokens: float = 0
    used_dollars: float = 0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def remaining(self, what: str) -> float | None:
        limit = getattr(self, what)
        return None if limit is None else max(0, limit - getattr(self, f"used_{what}"))

    def reserve(self, calls: int) -> None:
        """Take calls before they are made, or refuse them all."""
        with self._lock:
            for what, need in (("calls", calls), ("tokens", 1 if calls else 0), ("dollars", 1e-12 if calls else 0)):
                left = self.remaining(what)
                if left is not None and need > left:
                    raise BudgetError(f"the {what} budget is spent: {need:g} needed, {left:g} of {getattr(self, what):g} left")
            self.used_calls += calls

    def settle(self, unused: int = 0, tokens: float = 0, dollars: float = 0) -> None:
        with self._lock:
            self.used_calls -= unused
            self.used_tokens += tokens
            self.used_dollars += dollars

    def check(self, calls: float, dollars: float) -> None:
        """Refuse a statement whose estimate exceeds what is left."""
        for what, need in (("calls", calls), ("dollars", dollars)):
            left = self.remaining(what)
            if left is not None and need > left:
                raise BudgetError(f"the estimate of {need:g} {what} exceeds the remaining budget of {left:g}")

    def slice(self, share: float = 0.5) -> Budget:
        """A child's budget: a share of what is left."""
        part = lambda w: None if self.remaining(w) is None else self.remaining(w) * share
        return Budget(part("calls"), part("tokens"), part("dollars"), self.depth - 1)

    def narrowed(self, limits: dict[str, float]) -> Budget:
        """The tighter of this budget and given limits."""
        low = lambda a, b: b if a is None else a if b is None else min(a, b)
        return Budget(low(self.calls, limits.get("calls")), low(self.tokens, limits.get("tokens")), low(self.dollars, limits.get("dollars")), int(low(self.depth, limits.get("depth"))))
