"""Resolved plans: 14 relational nodes over typed expressions with columns by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class X:
    """A typed expression. op: lit, col, outer, fn, call, agg, case, cast, in, exists, inquery, scalar, or an operator's name."""

    op: str
    args: tuple = ()
    type: str = "ANY"
    val: object = None

    def walk(self) -> Iterator[X]:
        yield self
        for a in self.args:
            yield from a.walk()


@dataclass(frozen=True)
class Plan:
    """op: scan values cte project filter join tablefunc aggregate sort limit distinct union with recursive."""

    op: str
    inputs: tuple = ()
    fields: tuple = ()  # (name, type)
    info: dict = field(default_factory=dict)

    def with_inputs(self, *inputs: Plan) -> Plan:
        return replace(self, inputs=inputs)

    def exprs(self) -> list[X]:
        """The node's own expressions."""
        i = self.info
        return [*i.get("exprs", ()), *([i["pred"]] if i.get("pred") is not None else []), *i.get("args", ()), *i.get("groups", ()), *i.get("aggs", ()),
                *(k[0] for k in i.get("keys", ())), *(x for r in i.get("rows", ()) for x in r)]

    def walk(self) -> Iterator[Plan]:
        yield self
        for p in self.inputs:
            yield from p.walk()


def col(i: int, fields) -> X:
    return X("col", (), fields[i][1], i)


def conjuncts(x: X | None) -> list[X]:
    if x is None:
        return []
    return [c for a in x.args for c in conjuncts(a)] if x.op == "AND" else [x]


def conjoin(xs: list[X]) -> X | None:
    out = None
    for x in xs:
        out = x if out is None else X("AND", (out, x), "BOOLEAN")
    return out


def rewrite(x: X, fn: Callable[[X], X | None]) -> X:
    """Replace expressions top down where fn gives something."""
    new = fn(x)
    if new is not None:
        return new
    return replace(x, args=tuple(rewrite(a, fn) for a in x.args)) if x.args else x


def has_call(x: X) -> bool:
    return any(a.op == "call" or isinstance(a.val, Plan) and plan_calls(a.val) for a in x.walk())


def plan_calls(p: Plan) -> bool:
    return any(n.op == "tablefunc" and n.info["def"].kind != "pure" or any(map(has_call, n.exprs())) for n in p.walk())


def max_outer(x: X, depth: int = 1) -> bool:
    """Whether an expression refers to columns outside its own query at this depth or further out."""
    for a in x.walk():
        if a.op == "outer" and a.val[0] >= depth:
            return True
        if isinstance(a.val, Plan) and any(max_outer(e, depth + 1) for n in a.val.walk() for e in n.exprs()):
            return True
    return False
