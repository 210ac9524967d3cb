"""Rewrites for plans with calls: join order, cascade, semi-join, cheap first, volatility fences."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from sqlume.algebra import cost
from sqlume.algebra.cost import CostModel, Estimate, calls_in, subplans, weight
from sqlume.catalog import Catalog
from sqlume.plans.logical import Plan, X, col, conjoin, conjuncts, has_call, rewrite

MAX_RELATIONS = 10
ROUNDS = 8


@dataclass
class Report:
    """What the planner did."""

    applied: list[str] = field(default_factory=list)
    alternatives: list[tuple[str, Estimate]] = field(default_factory=list)
    relations: int = 0
    orders: int = 0
    priced: int = 0
    pruned: int = 0


def volatile(x: X) -> bool:
    return any(f.volatility == "volatile" for f in calls_in(x))


def transform(p: Plan, fn) -> Plan:
    """Apply fn bottom up to every node, subqueries excepted."""
    return fn(replace(p, inputs=tuple(transform(i, fn) for i in p.inputs)))


def optimize(plan: Plan, catalog: Catalog, m: CostModel) -> tuple[Plan, Report]:
    report = Report()
    new = join_order(plan, catalog, m, report)
    if new is not None:
        plan = new
        report.applied.append("join-order")
    for _ in range(ROUNDS):
        changed = False
        for name, rule in (("cascade", cascade), ("semi-join", semi_join), ("cheap-first", cheap_first)):
            new = rule(plan, catalog, m)
            if new is not None:
                plan, changed = new, True
                if name not in report.applied:
                    report.applied.append(name)
        if not changed:
            break
    if any(volatile(x) for n in plan.walk() for x in n.exprs()):
        report.applied.append("fences")
    return plan, report


def cheap_first(plan: Plan, catalog: Catalog, m: CostModel) -> Plan | None:
    """Conjuncts by weight, stably, within the stretches between volatile ones."""
    changed = []

    def sort(x: X) -> X:
        out: list[X] = []
        run: list[X] = []
        for c in conjuncts(x):
            if volatile(c):
                out += sorted(run, key=weight) + [c]
                run = []
            else:
                run.append(c)
        out += sorted(run, key=weight)
        if out != conjuncts(x):
            changed.append(True)
            return conjoin(out)
        return x

    def at(n: Plan) -> Plan:
        if n.op in ("filter", "join") and n.info.get("pred") is not None:
            new = sort(n.info["pred"])
            if new is not n.info["pred"]:
                return replace(n, info={**n.info, "pred": new})
        return n

    new = transform(plan, at)
    return new if changed else None


def cascade(plan: Plan, catalog: Catalog, m: CostModel) -> Plan | None:
    """A predicate with a proxy becomes score >= high OR (score >= low AND predicate), where that is priced cheaper."""
    est = cost.estimates(plan, catalog, m)
    done = []

    def visit(n: Plan) -> Plan:
        if n.op == "filter" and not done:
            parts = conjuncts(n.info["pred"])
            for i, c in enumerate(parts):
                proxy = catalog.proxies.get(c.val.name) if c.op == "call" else None
                if proxy is None or volatile(n.info["pred"]):
                    continue
                scorer = catalog.functions[proxy.function]
                rows = est[id(n.inputs[0])][0].rows
                plain = m.calls([c.val], rows).dollars
                if m.calls([scorer], rows).dollars + m.calls([c.val], rows * (proxy.high - proxy.low)).dollars >= plain:
                    continue
                done.append(True)
                child = visit_inputs(n).inputs[0]
                # pure conjuncts stay below the scores
                pure = [p for p in parts if not has_call(p)]
                rest = [p for j, p in enumerate(parts) if j != i and has_call(p)]
                if pure:
                    child = Plan("filter", (child,), child.fields, {"pred": conjoin(pure)})
                k = len(child.fields)
                wide = (*child.fields, (f"score_{c.val.name}", "DOUBLE"))
                scored = Plan("project", (child,), wide, {"exprs": (*(col(j, child.fields) for j in range(k)), X("call", c.args, "DOUBLE", scorer))})
                s = X("col", (), "DOUBLE", k)
                ge = lambda v: X(">=", (s, X("lit", (), "DOUBLE", float(v))), "BOOLEAN")
                either = X("OR", (ge(proxy.high), X("AND", (ge(proxy.low), c), "BOOLEAN")), "BOOLEAN")
                kept = Plan("filter", (scored,), wide, {"pred": conjoin([either, *rest])})
                return Plan("project", (kept,), n.fields, {"exprs": tuple(col(j, wide) for j in range(k))})
        return visit_inputs(n)

    def visit_inputs(n: Plan) -> Plan:
        new = tuple(visit(i) for i in n.inputs)
        return n if all(a is b for a, b in zip(new, n.inputs)) else replace(n, inputs=new)

    new = visit(plan)
    return new if done else None


def semi_join(plan: Plan, catalog: Catalog, m: CostModel) -> Plan | None:
    """[NOT] EXISTS over a filtered relation, with calls, becomes a semi or anti join above the cheaper conjuncts."""
    done = []

    def at(n: Plan) -> Plan:
        if n.op != "filter":
            return n
        parts = conjuncts(n.info["pred"])
        for i, c in enumerate(parts):
            anti = c.op == "NOT" and c.args[0].op == "exists"
            e = c.args[0] if anti else c
            if e.op != "exists" or not has_call(e):
                continue
            body = e.val
            if body.op == "project":
                body = body.inputs[0]
            if body.op != "filter" or body.inputs[0].op not in ("scan", "cte", "values"):
                continue
            pred, right = body.info["pred"], body.inputs[0]
            if any(isinstance(a.val, Plan) for a in pred.walk()) or any(a.op == "outer" and a.val[0] != 1 for a in pred.walk()):
                continue
            k = len(n.inputs[0].fields)

            def move(y: X) -> X | None:
                if y.op == "outer":
                    return X("col", (), y.type, y.val[1])
                if y.op == "col":
                    return replace(y, val=y.val + k)
                return None

            done.append(True)
            w = weight(c)
            below = [p for j, p in enumerate(parts) if j != i and weight(p) <= w and not has_call(p)]
            above = [p for j, p in enumerate(parts) if j != i and p not in below]
            left = n.inputs[0]
            if below:
                left = Plan("filter", (left,), left.fields, {"pred": conjoin(below)})
            out = Plan("join", (left, right), left.fields, {"kind": "anti" if anti else "semi", "pred": rewrite(pred, move)})
            return Plan("filter", (out,), out.fields, {"pred": conjoin(above)}) if above else out
        return n

    new = transform(plan, at)
    return new if done else None


@dataclass
class _Best:
    est: Estimate
    tree: Plan
    order: tuple[int, ...]
    label: str


def _rank(e: Estimate) -> tuple[float, float]:
    return e.dollars, e.rows


def bushy_orders(n: int) -> int:
    """Join trees over n relations: n! times the Catalan number of n - 1."""
    return math.factorial(n) * math.comb(2 * n - 2, n - 1) // n


def join_order(plan: Plan, catalog: Catalog, m: CostModel, report: Report) -> Plan | None:
    """The first tree of inner and cross joins with a call predicate, reordered by dynamic programming over subsets."""
    done = []

    def visit(n: Plan) -> Plan:
        if not done:
            new = _reorder(n, catalog, m, report)
            if new is not None:
                done.append(True)
                return new
        kids = tuple(visit(i) for i in n.inputs)
        return n if all(a is b for a, b in zip(kids, n.inputs)) else replace(n, inputs=kids)

    new = visit(plan)
    return new if done else None


def _is_inner(p: Plan) -> bool:
    return p.op == "join" and p.info["kind"] in ("inner", "cross")


def _reorder(node: Plan, catalog: Catalog, m: CostModel, report: Report) -> Plan | None:
    root = node.inputs[0] if node.op == "filter" else node
    if not _is_inner(root):
        return None
    leaves: list[tuple[Plan, int]] = []
    preds: list[X] = []

    def gather(p: Plan, offset: int) -> None:
        if _is_inner(p):
            gather(p.inputs[0], offset)
            gather(p.inputs[1], offset + len(p.inputs[0].fields))
            preds.extend(rewrite(c, lambda y: replace(y, val=y.val + offset) if y.op == "col" else None) for c in conjuncts(p.info["pred"]))
        else:
            leaves.append((p, offset))

    gather(root, 0)
    if not 3 <= len(leaves) <= MAX_RELATIONS:
        return None
    if node.op == "filter":
        preds += conjuncts(node.info["pred"])
    owner = {off + k: i for i, (leaf, off) in enumerate(leaves) for k in range(len(leaf.fields))}
    terms: list[tuple[X, int]] = []
    for x in preds:
        if volatile(x) or any(a.op == "outer" for a in x.walk()) or any(True for _ in subplans(x)):
            return None
        terms.append((x, sum(1 << r for r in {owner[a.val] for a in x.walk() if a.op == "col"})))
    if not any(has_call(x) for x, _ in terms) or any(volatile(x) for leaf, _ in leaves for n in leaf.walk() for x in n.exprs()):
        return None
    written = cost.total(node, catalog, m)

    def positions(order: tuple[int, ...]) -> dict[int, int]:
        out: dict[int, int] = {}
        for r in order:
            leaf, off = leaves[r]
            for k in range(len(leaf.fields)):
                out[off + k] = len(out)
        return out

    def settle(tree: Plan, xs: list[X], order: tuple[int, ...], rows: float, join: bool) -> tuple[Plan, Estimate]:
        """Predicates put on a tree: pure ones into the join, calls in a filter above; and what that costs."""
        if not xs:
            return tree, Estimate(rows)
        to = positions(order)
        xs = sorted((rewrite(x, lambda y: replace(y, val=to[y.val]) if y.op == "col" else None) for x in xs), key=weight)
        est = cost.predicate(conjoin(xs), catalog, m, rows, join)
        pure = [x for x in xs if not has_call(x)]
        calls = [x for x in xs if has_call(x)]
        if join:
            if pure:
                tree = replace(tree, info={"kind": "inner", "pred": conjoin(pure)})
            if calls:
                tree = Plan("filter", (tree,), tree.fields, {"pred": conjoin(calls)})
            return tree, est.of(max(est.rows, 1.0))
        return Plan("filter", (tree,), tree.fields, {"pred": conjoin(xs)}), est

    n = len(leaves)
    full = (1 << n) - 1
    best: dict[int, _Best] = {}
    for i, (leaf, _) in enumerate(leaves):
        have = cost.total(leaf, catalog, m)
        tree, e = settle(leaf, [x for x, rels in terms if rels == 1 << i], (i,), have.rows, False)
        best[1 << i] = _Best((have + e).of(e.rows), tree, (i,), leaf.info.get("table") or leaf.info.get("name") or leaf.op)
    for s in sorted(range(1, full + 1), key=lambda s: (s.bit_count(), s)):
        if s.bit_count() < 2:
            continue
        top: _Best | None = None
        a = (s - 1) & s
        while a:
            b = s ^ a
            left, right = best[a], best[b]
            inputs = left.est + right.est
            if top is not None and _rank(inputs) >= _rank(top.est):
                report.pruned += 1
            else:
                report.priced += 1
                order = left.order + right.order
                fields = left.tree.fields + right.tree.fields
                cross = Plan("join", (left.tree, right.tree), fields, {"kind": "cross", "pred": None})
                own = [x for x, rels in terms if rels & ~s == 0 and rels & a and rels & b]
                tree, e = settle(cross, own, order, left.est.rows * right.est.rows, True)
                whole = (inputs + e).of(e.rows)
                if top is None or _rank(whole) < _rank(top.est):
                    top = _Best(whole, tree, order, f"({left.label} ⋈ {right.label})")
            a = (a - 1) & s
        best[s] = top
    chosen = best[full]
    tree = chosen.tree
    consts = [x for x, rels in terms if rels == 0]
    if consts:
        tree = Plan("filter", (tree,), tree.fields, {"pred": conjoin(consts)})
    to = positions(chosen.order)
    if any(i != j for i, j in to.items()):
        tree = Plan("project", (tree,), root.fields, {"exprs": tuple(X("col", (), t, to[i]) for i, (_, t) in enumerate(root.fields))})
    report.relations, report.orders = n, bushy_orders(n)
    report.alternatives = [("as written", written), (f"chosen: {chosen.label}", chosen.est)]
    return tree
