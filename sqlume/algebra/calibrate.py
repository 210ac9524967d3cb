"""Thresholds of a cascade from a sample of scores and verdicts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    low: float
    high: float
    accepted: int
    asked: int
    rejected: int


def thresholds(sample: list[tuple[float, bool]], recall: float = 0.9, precision: float = 0.9) -> Thresholds:
    """high: the least score from which on at least precision of the rows are true (1 if there is none).

    low: the greatest score from which on at least recall of all true rows lie (0 if none are true); at most high.
    """
    scores = sorted({s for s, _ in sample})
    true = sum(ok for _, ok in sample)

    def above(t: float) -> list[bool]:
        return [ok for s, ok in sample if s >= t]

    high = next((t for t in scores if sum(above(t)) / len(above(t)) + 1e-9 >= precision), 1.0)
    low = next((t for t in reversed(scores) if sum(above(t)) / true + 1e-9 >= recall), 0.0) if true else 0.0
    low = min(low, high)
    return Thresholds(low, high, sum(s >= high for s, _ in sample), sum(low <= s < high for s, _ in sample), sum(s < low for s, _ in sample))
