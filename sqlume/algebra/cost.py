"""Estimates of rows, calls, tokens and dollars for plans with model calls."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from sqlume.catalog import Catalog, FunctionDef
from sqlume.plans.logical import Plan, X, conjuncts, has_call


@dataclass(frozen=True)
class Estimate:
    rows: float = 0.0
    calls: float = 0.0
    tokens: float = 0.0
    dollars: float = 0.0

    def __add__(self, o: Estimate) -> Estimate:
        return Estimate(self.rows, self.calls + o.calls, self.tokens + o.tokens, self.dollars + o.dollars)

    def times(self, n: float) -> Estimate:
        return Estimate(self.rows, self.calls * n, self.tokens * n, self.dollars * n)

    def of(self, rows: float) -> Estimate:
        return Estimate(rows, self.calls, self.tokens, self.dollars)


@dataclass
class CostModel:
    rows: dict[str, float] = field(default_factory=dict)
    default_rows: float = 100.0
    filter_selectivity: float = 0.5
    join_selectivity: float = 0.1
    branching: float = 3.0
    recursion_rounds: float = 4.0
    tokens_in: float = 600.0
    tokens_out: float = 150.0
    per_input: float = 2e-6
    per_output: float = 1e-5
    distinct: float = 1.0
    selectivity: dict[str, float] = field(default_factory=dict)
    branching_of: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: {"proxy": 0.1})
    child_calls: float = 4.0
    child_tokens: float = 12_000.0

    def priced(self, n: float, factor: float = 1.0) -> Estimate:
        return Estimate(0.0, n, n * (self.tokens_in + self.tokens_out) * factor, n * (self.tokens_in * self.per_input + self.tokens_out * self.per_output) * factor)

    def child(self) -> Estimate:
        return Estimate(0.0, self.child_calls, self.child_tokens, self.child_tokens * (0.85 * self.per_input + 0.15 * self.per_output))

    def calls(self, fs: list[FunctionDef], n: float) -> Estimate:
        """n evaluations of each function."""
        out = Estimate()
        for f in fs:
            if f.kind == "recursive":
                out = out + self.child().times(n)
            elif f.kind == "tool":
                out = out + self.priced(n, 0.0)
            elif f.kind in ("scalar", "table"):
                out = out + self.priced(math.ceil(n / f.batch) if f.kind == "scalar" and f.batch > 1 else n, self.factors.get(f.alias, 1.0))
        return out

    def learn_rates(self, trace: list[dict]) -> bool:
        """Token rates from priced calls: an output token is worth five input tokens."""
        made = [c for c in trace if c["dollars"] > 0]
        weight = sum(c["input_tokens"] + 5 * c["output_tokens"] for c in made)
        if not weight:
            return False
        self.per_input = sum(c["dollars"] for c in made) / weight
        self.per_output = 5 * self.per_input
        return True


def calls_in(x: X) -> list[FunctionDef]:
    return [a.val for a in x.walk() if a.op == "call"]


def subplans(x: X) -> Iterator[Plan]:
    for a in x.walk():
        if isinstance(a.val, Plan):
            yield a.val


def band(x: X) -> float:
    """Share of rows that reach the predicate in score >= high OR (score >= low AND predicate)."""
    if x.op != "OR" or x.args[1].op != "AND":
        return 1.0
    high, low = x.args[0], x.args[1].args[0]
    if high.op == low.op == ">=" and high.args[1].op == low.args[1].op == "lit":
        return min(1.0, max(0.0, float(high.args[1].val) - float(low.args[1].val)))
    return 1.0


def is_equijoin(x: X) -> bool:
    return x.op == "=" and all(a.op == "col" for a in x.args)


def predicate(x: X | None, catalog: Catalog, m: CostModel, rows: float, join: bool = False, ctes: dict | None = None) -> Estimate:
    """Conjuncts from left to right on the rows that are left: pure ones narrow, calls are paid for each survivor."""
    out = Estimate()
    for c in conjuncts(x):
        for p in subplans(c):
            out = out + total(p, catalog, m, ctes).times(rows)
        fs = calls_in(c)
        if not fs:
            rows *= m.join_selectivity if join and is_equijoin(c) else m.filter_selectivity
            continue
        out = out + m.calls(fs, rows * band(c) * m.distinct)
        known = [m.selectivity[f.name] for f in fs if f.name in m.selectivity]
        rows *= math.prod(known) if known else m.filter_selectivity
    return out.of(max(rows, 0.0))


def exprs_cost(xs, catalog: Catalog, m: CostModel, n: float, ctes: dict | None = None) -> Estimate:
    out = Estimate()
    for x in xs:
        out = out + m.calls(calls_in(x), n)
        for p in subplans(x):
            out = out + total(p, catalog, m, ctes).times(n)
    return out


def own(p: Plan, kids: list[Estimate], catalog: Catalog, m: CostModel, ctes: dict) -> Estimate:
    """A node's own cost and its rows, given its inputs' rows."""
    rows = kids[0].rows if kids else 1.0
    op, i = p.op, p.info
    if op == "scan":
        return Estimate(m.rows.get(i["table"], m.default_rows))
    if op == "values":
        return Estimate(float(len(i["rows"])))
    if op == "cte":
        return Estimate(ctes.get(i["name"], m.default_rows))
    if op == "project":
        return exprs_cost(i["exprs"], catalog, m, rows * m.distinct, ctes).of(rows)
    if op == "filter":
        return predicate(i["pred"], catalog, m, rows, False, ctes)
    if op == "join":
        left, right = rows, kids[1].rows
        e = predicate(i["pred"], catalog, m, left * right, True, ctes) if i["pred"] is not None else Estimate(left * right)
        hit = max(min(e.rows / max(right, 1.0), left), left * m.filter_selectivity)
        return e.of({"cross": left * right, "inner": max(e.rows, 1.0), "left": max(e.rows, left), "semi": hit, "anti": max(left - hit, 0.0)}[i["kind"]])
    if op == "tablefunc":
        n = rows if p.inputs else 1.0
        f = i["def"]
        e = exprs_cost(i["args"], catalog, m, n, ctes)
        if f.kind in ("table", "recursive"):
            e = e + m.calls([f], n)
        return e.of(n * m.branching_of.get(f.name, m.branching))
    if op == "aggregate":
        e = exprs_cost((*i["groups"], *i["aggs"]), catalog, m, rows, ctes)
        return e.of(max(rows * 0.3, 1.0) if i["groups"] else 1.0)
    if op == "sort":
        return exprs_cost([k[0] for k in i["keys"]], catalog, m, rows, ctes).of(rows)
    if op == "limit":
        return Estimate(min(rows if i["limit"] is None else float(i["limit"]), max(rows - i["offset"], 0.0)))
    if op == "distinct":
        return Estimate(max(rows * 0.8, 1.0))
    if op == "union":
        n = sum(k.rows for k in kids)
        return Estimate(n if i["all"] else n * 0.8)
    return Estimate(kids[-1].rows)


def beam(p: Plan) -> int | None:
    """The limit that a recursive term puts on each round."""
    while p.op == "project":
        p = p.inputs[0]
    return p.info["limit"] if p.op == "limit" else None


def estimates(p: Plan, catalog: Catalog, m: CostModel, ctes: dict | None = None) -> dict[int, tuple[Estimate, Estimate]]:
    """By id of each node: its own estimate, and the total of its subtree."""
    out: dict[int, tuple[Estimate, Estimate]] = {}

    def visit(n: Plan, seen: dict) -> Estimate:
        if n.op == "with":
            seen, kids = dict(seen), []
            for name, c in zip(n.info["names"], n.inputs):
                kids.append(visit(c, seen))
                seen[name] = kids[-1].rows
            kids.append(visit(n.inputs[-1], seen))
            e = Estimate(kids[-1].rows)
        elif n.op == "recursive":
            e, kids = rounds(n, seen)
        else:
            kids = [visit(c, seen) for c in n.inputs]
            e = own(n, kids, catalog, m, seen)
        whole = e
        for c in n.inputs:
            whole = whole + out[id(c)][1]
        out[id(n)] = (e, whole.of(e.rows))
        return e

    def rounds(n: Plan, seen: dict) -> tuple[Estimate, list[Estimate]]:
        base, rec = n.inputs
        first = visit(base, seen)
        front, extra, whole = first.rows, Estimate(), first.rows
        k = max(1, int(n.info["max_rounds"] if n.info["max_rounds"] is not None else m.recursion_rounds))
        for r in range(k):
            if r and front < 0.5:
                break
            visit(rec, {**seen, n.info["name"]: front})
            e = out[id(rec)]
            if r:
                extra = extra + e[1]
            else:
                shown = {i: v for i, v in out.items()}
            front = e[0].rows
            whole += front
        out.update(shown)  # the node shows its first round; the others are added here
        return extra.of(whole), [first, out[id(rec)][0]]

    visit(p, dict(ctes or {}))
    return out


def total(p: Plan, catalog: Catalog, m: CostModel, ctes: dict | None = None) -> Estimate:
    return estimates(p, catalog, m, ctes)[id(p)][1]


def calls_and_dollars(p: Plan, catalog: Catalog, m: CostModel) -> tuple[float, float]:
    e = total(p, catalog, m)
    return e.calls, e.dollars


def weight(x: X) -> int:
    """For ordering conjuncts: free, tool, model call, child session; a subquery on top."""
    kinds = [f.kind for f in calls_in(x)]
    w = 100 if "recursive" in kinds else 10 if {"scalar", "table"} & set(kinds) else 1 if "tool" in kinds else 0
    subs = list(subplans(x))
    if any(has_call(e) for s in subs for n in s.walk() for e in n.exprs()):
        w = max(w, 10)
    return w + (5 if subs else 0)
