"""The call plan as text."""

from __future__ import annotations

from sqlume.algebra import cost
from sqlume.algebra.cost import CostModel, calls_in
from sqlume.algebra.rules import Report, volatile
from sqlume.catalog import Catalog, FunctionDef
from sqlume.plans.logical import Plan, X

_SIGNS = {"scalar": "λ", "table": "κ", "recursive": "ρ", "tool": "tool"}


def fragment(plan: Plan) -> str:
    """CQ for select-project-join, FO with negation or disjunction or aggregates, REC with recursion."""
    nodes = list(plan.walk())
    if any(n.op == "recursive" for n in nodes):
        return "REC"
    rich = {"OR", "NOT", "case", "agg"}
    subs = [s for n in nodes for x in n.exprs() for s in cost.subplans(x)]
    if any(fragment(s) == "REC" for s in subs):
        return "REC"
    if any(n.op in ("aggregate", "union") or n.op == "join" and n.info["kind"] in ("anti", "left") for n in nodes) or any(a.op in rich for n in nodes for x in n.exprs() for a in x.walk()):
        return "FO"
    return "CQ"


def _text(x: X) -> str:
    if x.op == "col":
        return f"#{x.val}"
    if x.op == "outer":
        return f"outer#{x.val[1]}"
    if x.op == "lit":
        return "NULL" if x.val is None else repr(x.val)
    if x.op in ("call", "fn"):
        return f"{x.val.name if isinstance(x.val, FunctionDef) else x.val}({', '.join(map(_text, x.args))})"
    if x.op == "agg":
        return f"{x.val[0]}({', '.join(map(_text, x.args)) or '*'})"
    if len(x.args) == 2 and x.op not in ("in", "case"):
        return f"({_text(x.args[0])} {x.op} {_text(x.args[1])})"
    return f"{x.op}({', '.join(map(_text, x.args))})"


def describe(p: Plan) -> str:
    i = p.info
    if p.op == "scan":
        return f"Scan {i['table']}"
    if p.op == "cte":
        return f"Cte {i['name']}"
    if p.op == "filter":
        return f"Filter {_text(i['pred'])}"
    if p.op == "join":
        return f"Join {i['kind']}" + (f" on {_text(i['pred'])}" if i["pred"] is not None else "")
    if p.op == "tablefunc":
        return f"Table {i['def'].name}({', '.join(map(_text, i['args']))})"
    if p.op == "recursive":
        k = cost.beam(p.inputs[1])
        return f"Recursive {i['name']} {'union all' if i['all'] else 'union'}" + (f", beam {k}" if k is not None else "")
    if p.op == "limit":
        return f"Limit {i['limit']}" + (f" offset {i['offset']}" if i["offset"] else "")
    return p.op.capitalize()


def _kinds(p: Plan) -> list[str]:
    out = [f"{_SIGNS[f.kind]} {f.alias}" if f.kind in ("scalar", "table") else _SIGNS[f.kind] for x in p.exprs() for f in calls_in(x) if f.kind in _SIGNS]
    if p.op == "tablefunc" and p.info["def"].kind in _SIGNS:
        f = p.info["def"]
        out.append(f"{_SIGNS[f.kind]} {f.alias}" if f.kind == "table" else _SIGNS[f.kind])
    return list(dict.fromkeys(out))


def render(plan: Plan, catalog: Catalog, m: CostModel, report: Report) -> str:
    est = cost.estimates(plan, catalog, m)
    whole = est[id(plan)][1]
    lines = [f"plan [{fragment(plan)}]: {whole.calls:g} calls, {whole.tokens:.0f} tokens, ${whole.dollars:.4f}"]

    def walk(p: Plan, depth: int) -> None:
        e = est[id(p)][0]
        calls = f", calls {e.calls:g}, tokens {e.tokens:.0f}, ${e.dollars:.4f}" if e.calls else ""
        kinds = f" [{', '.join(_kinds(p))}]" if _kinds(p) else ""
        fence = " volatile fence" if any(volatile(x) for x in p.exprs()) else ""
        lines.append(f"{'  ' * depth}{describe(p)}{kinds}{fence} (rows {e.rows:g}{calls})")
        for c in p.inputs:
            walk(c, depth + 1)

    walk(plan, 1)
    lines.append(f"rules: {', '.join(report.applied) or 'none'}")
    if report.relations:
        lines.append(f"plan space: {report.relations} relations, {report.orders} join orders, {report.priced} splits priced, {report.pruned} pruned")
        lines.append("alternatives:")
        lines += [f"  {name}: {e.calls:g} calls, ${e.dollars:.4f}" for name, e in report.alternatives]
    learned = [f"{n}: selectivity {v:.2f}" for n, v in m.selectivity.items()] + [f"{n}: {v:.1f} rows per call" for n, v in m.branching_of.items()]
    if learned:
        lines.append(f"learned: {'; '.join(learned)}")
    return "\n".join(lines)
