"""A session: tables, functions, settings, and statements run on Spark."""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlume.algebra import calibrate, cost, explain, rules
from sqlume.calls.budget import Budget
from sqlume.catalog import Catalog, FunctionDef, Proxy, builtin_functions
from sqlume.errors import BudgetError, SqlError, unknown
from sqlume.functions.builtins import AGGREGATES, BUILTINS, spark_type
from sqlume.operators import calls as call_ops
from sqlume.operators import fixpoint as loops
from sqlume.operators import tables as table_ops
from sqlume.plans import ast
from sqlume.plans.lexer import statements
from sqlume.plans.logical import Plan, X, col, conjoin, conjuncts, has_call, plan_calls
from sqlume.plans.lower import Lowering, dialect_type, shifted
from sqlume.plans.parser import parse
from sqlume.plans.resolve import Resolver
from sqlume.sources import files, tools
from sqlume.trace import Trace

_IDS = itertools.count()
SETTINGS = ("effort", "model.default", "max_tokens", "memo", "cache_prefix", "max_recursion_rounds", "budget.calls", "budget.tokens", "budget.dollars", "budget.depth")


#: Bytes of arguments and results of a CALL that stay on the driver before they go to a table, with their trace.
HELD_BYTES = 16 << 20
#: Folders of inserted rows are told apart, and ordered, by this key.
INSERT = "sqlume_insert"


class Runtime:
    """What lowering needs while a statement runs: calls, tools, recursion."""

    def __init__(self, session: Session) -> None:
        self.session, self.spark = session, session.spark
        self.temporary: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return loops.keep(df, name)

    # recursion

    def fixpoint(self, low: Lowering, plan: Plan) -> str:
        base, rec = plan.inputs
        name = plan.info["name"]
        cast = lambda df: df.selectExpr(*[f"CAST({c} AS {spark_type(t)}) AS c{i}" for i, (c, (_, t)) in enumerate(zip(df.columns, plan.fields))])
        start = cast(self.spark.sql(low.rel(base, [])))
        before = low.ctes.get(name)

        def step(delta: DataFrame) -> DataFrame:
            low.ctes[name] = (low.view(delta), plan.fields)
            return cast(self.spark.sql(low.rel(rec, [])))

        note = lambda cte, k, d, t: self.session.rounds.append({"cte": cte, "round": k, "delta_rows": d, "total_rows": t})
        out = loops.fixpoint(start, step, plan.info["all"], plan.info["max_rounds"], name, note)
        if before is None:
            low.ctes.pop(name, None)
        else:
            low.ctes[name] = before
        return low.view(out)

    # table functions

    def table_function(self, low: Lowering, p: Plan, outer: list) -> str:
        f: FunctionDef = p.info["def"]
        args, child = list(p.info["args"]), p.inputs[0] if p.inputs else None
        n, width = len(child.fields) if child else 0, len(f.returns)
        if f.form in ("series", "chunks"):
            if child is not None and any(map(has_call, args)):
                view, args = self.resolve_calls(low, child, args, outer)
                source, ctx = view, (lambda i: f"c{i}")
            elif child is not None:
                a = low._alias()
                source, ctx = f"({low.rel(child, outer)}) {a}", (lambda i: f"{a}.c{i}")
            else:
                source, ctx = f"(SELECT 1 AS one) {low._alias()}", None
            texts = [low.expr(x, ctx, outer) for x in args]
            keep = "".join(f"{ctx(i)} AS c{i}, " for i in range(n))
            t = low._alias()
            if f.form == "series":
                if child is None and all(x.op == "lit" and isinstance(x.val, int) for x in args):
                    a, b, s = [x.val for x in args] + [1] * (3 - len(args))
                    if s == 0:
                        raise SqlError("generate_series: the step is zero")
                    size = max(0, (b - a) // s + 1)
                    if size > table_ops.MAX_SERIES:
                        raise SqlError(f"generate_series: over {table_ops.MAX_SERIES} rows")
                    return f"SELECT id AS c0 FROM range({a}, {a + size * s}, {s})"
                return f"SELECT {keep}{t}.x AS c{n} FROM {source} LATERAL VIEW explode({table_ops.series(texts)}) {t} AS x"
            size, overlap = texts[1], texts[2] if len(texts) > 2 else "0L"
            return f"SELECT {keep}{t}.x.ordinal AS c{n}, {t}.x.text AS c{n + 1}, {t}.x.tokens AS c{n + 2} FROM {source} LATERAL VIEW explode(sqlume_chunks({texts[0]}, {size}, {overlap})) {t} AS x"
        answer: Callable[[tuple], list[tuple]] = lambda t: self.session.rows_of(f, t)
        schema = ", ".join(f"r{i} {spark_type(t)}" for i, (_, t) in enumerate(f.returns))
        if child is None:
            if any(x.op not in ("lit", "cast") for x in args):
                row = self.spark.sql("SELECT " + ", ".join(f"{low.expr(x, lambda i: '', outer)} AS a{i}" for i, x in enumerate(args))).first()
                values = tuple(row)
            else:
                values = tuple(x.val if x.op == "lit" else x.args[0].val for x in args)
            view = low.view(self.spark.createDataFrame(answer(values), schema) if width else None)
            return f"SELECT {', '.join(f'r{i} AS c{i}' for i in range(width))} FROM {view}"
        view, args = self.resolve_calls(low, child, args, outer)
        texts = [low.expr(x, lambda i: f"c{i}", outer) for x in args]
        cols = ", ".join(f"{x} AS a{i}" for i, x in enumerate(texts))
        need = self.spark.sql(f"SELECT DISTINCT {cols} FROM {view}")
        found, asked = [], 0
        parts: list[DataFrame] = []
        full = ", ".join([*(f"a{i} {spark_type(x.type if x.type != 'ANY' else 'TEXT')}" for i, x in enumerate(args)), schema])
        for t in need.toLocalIterator():
            t = tuple(t)
            if f.kind in ("table", "recursive") and any(v is None for v in t):
                continue
            rows = answer(t)
            asked += 1
            found += [(*t, *r) for r in rows]
            if len(found) >= call_ops.FLUSH:
                parts.append(loops.keep(self.spark.createDataFrame(found, full), "rows"))
                found = []
        if f.kind != "pure" and asked:
            total = len(found) + sum(p.count() for p in parts)
            self.session.learned.setdefault(("branching", f.name), []).append((total, asked))
        made = self.spark.createDataFrame(found, full)
        for part in parts:
            made = made.union(part)
        b = low._alias()
        right = low.view(made)
        on = " AND ".join(f"{x} <=> {b}.a{i}" for i, x in enumerate([t_.replace("c", "c") for t_ in texts]))
        return f"SELECT {', '.join(f'{view}.c{i} AS c{i}' for i in range(n))}{',' if n else ''} {', '.join(f'{b}.r{i} AS c{n + i}' for i in range(width))} FROM {view} JOIN {right} {b} ON {on}"

    # calls in expressions

    def resolve_calls(self, low: Lowering, child: Plan, exprs, outer: list) -> tuple[str, list[X]]:
        """A view of child with the answers of all calls as further columns, and the expressions that read them."""
        if outer and any(map(has_call, exprs)):
            raise SqlError("a model call inside a correlated subquery is supported in EXISTS only")
        kept = self.keep(self.spark.sql(low.rel(child, outer)), "input") if any(map(has_call, exprs)) else self.spark.sql(low.rel(child, outer))
        state = [kept, list(child.fields)]
        view = low.view(kept)
        box = {"view": view, "fields": list(child.fields)}
        out = [self._stage(low, box, x, None) for x in exprs]
        return box["view"], out

    def _stage(self, low: Lowering, box: dict, x: X, mask: X | None) -> X:
        """x with its calls replaced by columns, made only for rows where mask is true and x needs them."""
        if not has_call(x):
            return x
        both = lambda m: m if mask is None else X("AND", (mask, m), "BOOLEAN")
        if x.op in ("AND", "OR"):
            left = self._stage(low, box, x.args[0], mask)
            decided = X("IS FALSE" if x.op == "AND" else "IS TRUE", (left,), "BOOLEAN")
            right = self._stage(low, box, x.args[1], both(X("NOT", (decided,), "BOOLEAN")))
            return replace(x, args=(left, right))
        if x.op == "case":
            parts, rest = [], mask
            for i in range(0, len(x.args) - 1, 2):
                cond = self._stage(low, box, x.args[i], rest)
                hit = X("IS TRUE", (cond,), "BOOLEAN")
                here = hit if rest is None else X("AND", (rest, hit), "BOOLEAN")
                parts += [cond, self._stage(low, box, x.args[i + 1], here)]
                miss = X("NOT", (hit,), "BOOLEAN")
                rest = miss if rest is None else X("AND", (rest, miss), "BOOLEAN")
            return replace(x, args=(*parts, self._stage(low, box, x.args[-1], rest)))
        if isinstance(x.val, Plan):
            kept = self.keep(self.spark.sql(low.rel(x.val, [lambda i: f"c{i}"])), "subquery")
            name = f"call{next(_IDS)}"
            low.ctes[name] = (low.view(kept), x.val.fields)
            return replace(x, args=tuple(self._stage(low, box, a, mask) for a in x.args), val=Plan("cte", (), x.val.fields, {"name": name}))
        args = tuple(self._stage(low, box, a, mask) for a in x.args)
        if x.op != "call":
            return replace(x, args=args)
        return self._call(low, box, x.val, args, mask)

    def _call(self, low: Lowering, box: dict, f: FunctionDef, args: tuple, mask: X | None) -> X:
        view, fields = box["view"], box["fields"]
        ctx = lambda i: f"c{i}"
        texts = [low.expr(a, ctx, []) for a in args]
        where = [f"({t}) IS NOT NULL" for t in texts] + ([low.expr(mask, ctx, [])] if mask is not None else [])
        cols = ", ".join(f"{t} AS a{i}" for i, t in enumerate(texts)) or "1 AS a0"
        need = self.spark.sql(f"SELECT DISTINCT {cols} FROM {view}" + (f" WHERE {' AND '.join(where)}" if where else ""))
        need = need.orderBy(*need.columns)  # the same arguments make the same batches, which the memo knows
        if f.form == "shell":
            raise SqlError(f"{f.name} runs a shell command; shell is withheld in this session")
        made = call_ops.answers(self.spark, need, f, self.session.caller)
        right, b = low.view(made), low._alias()
        on = " AND ".join([f"({t}) <=> {b}.a{i}" for i, t in enumerate(texts)] + ([low.expr(mask, ctx, [])] if mask is not None else []))
        n = len(fields)
        out = self.spark.sql(f"SELECT {''.join(f'{view}.c{i} AS c{i}, ' for i in range(n))}{b}.r AS c{n} FROM {view} LEFT JOIN {right} {b} ON {on}")
        if f.returns == "BOOLEAN":
            self.session.learned.setdefault(("selectivity", f.body or f.name), []).append(made.selectExpr("coalesce(sum(CAST(r AS INT)), 0)", "count(r)").first())
        box["view"], box["fields"] = low.view(out), [*fields, (f.name, f.returns)]
        return X("col", (), f.returns, n)

    # joins with calls in their condition

    def join_calls(self, low: Lowering, p: Plan, outer: list) -> str:
        left, right = p.inputs
        kind, parts = p.info["kind"], conjuncts(p.info["pred"])
        pure, calls = conjoin([c for c in parts if not has_call(c)]), [c for c in parts if has_call(c)]
        n, m = len(left.fields), len(right.fields)
        if kind == "inner":
            pairs = Plan("join", (left, right), left.fields + right.fields, {"kind": "inner" if pure is not None else "cross", "pred": pure})
            return low.rel(Plan("filter", (pairs,), pairs.fields, {"pred": conjoin(calls)}), outer)
        # rows of the left side are told apart by a number
        numbered = self.keep(self.spark.sql(f"SELECT *, monotonically_increasing_id() AS c{n} FROM ({low.rel(left, outer)})"), "left")
        lname, rname = f"left{next(_IDS)}", f"right{next(_IDS)}"
        lfields = (*left.fields, ("id", "BIGINT"))
        low.ctes[lname] = (low.view(numbered), lfields)
        low.ctes[rname] = (low.view(self.keep(self.spark.sql(low.rel(right, outer)), "right")), right.fields)
        lplan, rplan = Plan("cte", (), lfields, {"name": lname}), Plan("cte", (), right.fields, {"name": rname})
        move = lambda x: shift_right(x, n)
        pred = move(pure) if pure is not None else None
        pairs = Plan("join", (lplan, rplan), lfields + right.fields, {"kind": "inner" if pred is not None else "cross", "pred": pred})
        cond = conjoin([move(c) for c in calls])
        lv = low.ctes[lname][0]
        names = ", ".join(f"{lv}.c{i} AS c{i}" for i in range(n))
        if kind == "left":
            hit = low.view(self.keep(self.spark.sql(low.rel(Plan("filter", (pairs,), pairs.fields, {"pred": cond}), outer)), "pairs"))
            cols = ", ".join([*(f"c{i}" for i in range(n)), *(f"c{n + 1 + i} AS c{n + i}" for i in range(m))])
            pads = ", ".join(f"CAST(NULL AS {spark_type(t)}) AS c{n + i}" for i, (_, t) in enumerate(right.fields))
            return f"SELECT {cols} FROM {hit} UNION ALL SELECT {names}, {pads} FROM {lv} LEFT ANTI JOIN {hit} h ON {lv}.c{n} = h.c{n}"
        # semi and anti: rounds of growing size for each undecided left row, as one match decides it
        found, lo, size = None, 1, 1
        undecided = lambda df: df if found is None else df.join(found, f"c{n}", "left_anti").select(*df.columns)
        if pred is not None:  # the pairs are those of the pure join
            order = ", ".join(f"c{n + 1 + i}" for i in range(m))
            rank = self.keep(self.spark.sql(f"SELECT *, row_number() OVER (PARTITION BY c{n} ORDER BY {order}) AS c{n + m + 1} FROM ({low.rel(pairs, outer)})"), "ranked")
            most = rank.selectExpr(f"coalesce(max(c{n + m + 1}), 0)").first()[0]
        else:  # any row may pair with any: each round has a stretch of the right side, and pairs for its calls only
            rows = self.spark.table(low.ctes[rname][0])
            rows = rows.orderBy(*rows.columns)
            most = rows.count()
        while lo <= most:
            if pred is not None:
                part, fields = undecided(rank.where(f"c{n + m + 1} BETWEEN {lo} AND {lo + size - 1}")), (*pairs.fields, ("rank", "BIGINT"))
            else:
                some = rows.offset(lo - 1).limit(size).toDF(*[f"c{n + 1 + i}" for i in range(m)])
                part, fields = undecided(self.spark.table(lv)).crossJoin(some), pairs.fields
            name = f"part{next(_IDS)}"
            low.ctes[name] = (low.view(part), fields)
            hits = self.spark.sql(low.rel(Plan("filter", (Plan("cte", (), fields, {"name": name}),), fields, {"pred": cond}), outer)).select(f"c{n}").distinct()
            hits = self.keep(hits, "hits")
            found = hits if found is None else found.union(hits)
            lo, size = lo + size, size * 4
        if found is None:
            return f"SELECT {names} FROM {lv}" + (" WHERE false" if kind == "semi" else "")
        h = low.view(found)
        return f"SELECT {names} FROM {lv} LEFT {'SEMI' if kind == 'semi' else 'ANTI'} JOIN {h} ON {lv}.c{n} = {h}.c{n}"

    def drop(self) -> None:
        for v in self.temporary:
            self.spark.catalog.dropTempView(v)
        self.temporary = []


class TableRows(dict):
    """Rows of a session's tables, each counted when a plan that reads it is priced, and once only."""

    def __init__(self, session: Session) -> None:
        super().__init__()
        self.session = session

    def get(self, name: str, default: float | None = None) -> float | None:
        return super().get(name) or (self.session._rows(name) if name in self.session.frames else default)


def shift_right(x: X, n: int) -> X:
    """Columns of a join's right side moved by one, for a row number between the sides."""
    from sqlume.plans.logical import rewrite

    return rewrite(x, lambda y: replace(y, val=y.val + 1) if y.op == "col" and y.val >= n else None)


class Session:
    """Runs statements of the dialect on a SparkSession.

    provider answers model calls, workspace bounds file tools, runner carries out delegation (agent, task, context,
    depth, budget) -> (answer, detail). Tables are views over DataFrames.
    """

    def __init__(self, spark: SparkSession, provider=None, workspace: str | None = None, runner=None, budget: Budget | None = None, concurrency: int = 8,
                 withheld: tuple[str, ...] = (), allow_shell: bool = False, depth: int = 0, memo: dict | None = None, env: tuple[str, ...] = (), skills: dict | None = None,
                 web: tools.Web | None = None, trace: Trace | None = None, parent: Session | None = None, task: str = "", role: str = "root") -> None:
        self.spark, self.runner, self.depth = spark, runner, depth
        self.id = uuid.uuid4().hex[:8]
        self.catalog = Catalog(functions={k: f for k, f in builtin_functions().items() if k not in withheld})
        self.withheld, self.allow_shell = set(withheld), allow_shell and "shell" not in withheld
        self.views: dict[str, tuple[str, list[str]]] = {}
        self.frames: dict[str, DataFrame] = {}
        self.budget = budget or Budget()
        self.memo: dict[str, str] = {} if memo is None else memo
        self.web, self.parent, self.task, self.role = web, parent, task, role
        self.trace = trace or Trace()
        self.calls, self.rounds, self.statements = (self.trace[n] for n in ("calls", "rounds", "statements"))
        self.made = 0
        if parent is None:
            self.trace["runs"].append({"run": self.trace.run, "started_at": time.time(), "task": task})
        self.trace["sessions"].append({"session": self.id, "run": self.trace.run, "parent": parent.id if parent else None, "depth": depth, "role": role, "started_at": time.time(), "task": task})
        self.servers: dict[str, tuple] = {}
        self.appended: dict[str, tuple[DataFrame, str]] = {}
        self.learned: dict[tuple, list] = {}
        self.calibrations: dict[tuple[str, str], tuple[float, float]] = {}
        self.settings: dict[str, object] = {}
        self.mail: list[tuple[str, str, str]] = []
        self.pending: dict[str, tuple[Session, Future]] = {}
        self._pool: ThreadPoolExecutor | None = None
        self.caller = call_ops.Caller(provider, self.budget, self.memo, self.calls, concurrency)
        self.workspace = files.Workspace(workspace, env, skills) if workspace else None
        self.answer: DataFrame | None = None
        table_ops.register(spark)

    # tables

    def register(self, name: str, df: DataFrame, json_columns: tuple[str, ...] = (), fields: tuple | None = None) -> None:
        """Make a DataFrame a table."""
        key = name.lower()
        view = f"sqlume_{self.id}_{next(_IDS)}"  # a namespace of its own for each session
        df.createOrReplaceTempView(view)
        types = [dialect_type(f.dataType) for f in df.schema.fields]
        own = fields or tuple((f.name, "JSON" if f.name in json_columns else t) for f, t in zip(df.schema.fields, types))
        have = {"BIGINT": "bigint", "DOUBLE": "double", "TEXT": "string", "BOOLEAN": "boolean", "VECTOR": "array<float>"}
        columns = [f"CAST(`{f.name}` AS {spark_type(t)})" if t in have and f.dataType.simpleString() != have[t] else f"`{f.name}`" for f, t in zip(df.schema.fields, types)]
        self.views[key], self.catalog.tables[key], self.frames[key] = (view, columns), own, df
        self.appended.pop(key, None)

    def load(self, name: str, path: str) -> None:
        """A CSV or JSON file of the workspace as a table with inferred types."""
        ws = self._workspace()
        text = ws._text(path)
        records = files.csv_records(text) if path.lower().endswith(".csv") else files.json_records(text)
        fields, rows = files.typed(records)
        schema = ", ".join(f"`{n}` {spark_type(t)}" for n, t in fields)
        self.register(name, self.spark.createDataFrame(rows, schema), fields=tuple(fields))

    def context(self, text: str) -> None:
        """The table ctx: a row for each paragraph."""
        self.register("ctx", self.spark.createDataFrame(files.paragraphs(text), "ordinal long, text string"))

    def _workspace(self) -> files.Workspace:
        if self.workspace is None:
            raise SqlError("this session has no workspace")
        return self.workspace

    # statements

    def sql(self, text: str) -> DataFrame | None:
        """Run a script; gives the last statement's relation. Stops at the first error, and at FINAL."""
        out = None
        for s in statements(text):
            out = self._run(parse(s), s)
            if self.answer is not None:
                break
        return out

    def plan(self, q: ast.Query) -> Plan:
        rounds = self.settings.get("max_recursion_rounds")
        return Resolver(self.catalog, int(rounds) if rounds is not None else None).query(q)

    def cost_model(self) -> cost.CostModel:
        model = cost.CostModel()
        model.rows = TableRows(self)
        for (what, name), seen in self.learned.items():
            hits, n = sum(s[0] for s in seen), sum(s[1] for s in seen)
            if n >= 3:
                if what == "selectivity":
                    for f in self.catalog.functions.values():
                        if (f.body or f.name) == name:
                            model.selectivity[f.name] = min(0.99, max(0.01, hits / n))
                else:
                    model.branching_of[name] = hits / n
        return model

    def _rows(self, name: str) -> float:
        rows = self.settings.setdefault("_rows", {})
        if name not in rows:
            rows[name] = float(self.frames[name].count())
        return rows[name]

    def optimized(self, plan: Plan) -> tuple[Plan, rules.Report]:
        if not plan_calls(plan):
            return plan, rules.Report()
        return rules.optimize(plan, self.catalog, self.cost_model())

    def query(self, q: ast.Query, gate: bool = True) -> DataFrame:
        plan, report = self.optimized(self.plan(q))
        if gate and plan_calls(plan):
            model = self.cost_model()
            e = cost.total(plan, self.catalog, model)
            self.explained = explain.render(plan, self.catalog, model, report)
            self.budget.check(e.calls, e.dollars)
        return Lowering(self.spark, self.views, Runtime(self)).frame(plan)

    def _run(self, s, text: str) -> DataFrame | None:
        """One statement, traced: what it is, when it ran, what its calls spent, and how it failed."""
        self.trace.spill(self.spark)
        self.statement = f"{self.id}-{self.made}"
        self.statements.append({"n": self.made, "sql": text, "kind": type(s).__name__, "session": self.id, "statement": self.statement, "started_at": time.time()})
        self.made += 1
        before, error = (self.budget.used_calls, self.budget.used_tokens, self.budget.used_dollars), None
        try:
            return self._dispatch(s)
        except Exception as e:
            error = str(e)
            raise
        finally:
            calls, tokens, dollars = self.budget.used_calls - before[0], self.budget.used_tokens - before[1], self.budget.used_dollars - before[2]
            self.trace["statement_ends"].append({"statement": self.statement, "finished_at": time.time(), "calls": int(calls), "tokens": int(tokens), "dollars": float(dollars), "error": error, "explain": self.explained})

    def _dispatch(self, s) -> DataFrame | None:
        self.explained = None
        if isinstance(s, ast.Query):
            return self.query(s)
        if isinstance(s, ast.Final):
            plan = self.plan(s.query)
            if any(n.op == "tablefunc" and n.info["def"].kind == "recursive" for n in plan.walk()):
                raise SqlError("FINAL cannot delegate: CREATE TABLE ... AS SELECT the answers first, then FINAL from that table")
            self.answer = self.query(s.query)
            self.trace["final"].append({"session": self.id, "rows": self.answer.count()})
            return self.answer
        if isinstance(s, ast.CreateTable):
            return self._create(s)
        if isinstance(s, ast.Insert):
            return self._insert(s)
        if isinstance(s, ast.Drop):
            key = s.name.lower()
            if key not in self.views:
                if s.if_exists:
                    return None
                raise unknown("table", s.name, self.views)
            self.spark.catalog.dropTempView(self.views.pop(key)[0])
            del self.catalog.tables[key], self.frames[key]
            self.appended.pop(key, None)
            self.settings.get("_rows", {}).pop(key, None)
            return None
        if isinstance(s, ast.Set):
            return self._set(s)
        if isinstance(s, ast.Explain):
            return self._explain(s)
        if isinstance(s, ast.CreateFunction):
            return self._function(s)
        if isinstance(s, ast.CreateAgent):
            if s.name in self.catalog.agents and not s.replace:
                raise SqlError(f"agent {s.name} exists; CREATE OR REPLACE AGENT changes it")
            self.catalog.agents[s.name] = s
            return None
        if isinstance(s, ast.CallTool):
            return self._call_tool(s)
        if isinstance(s, ast.Calibrate):
            return self._calibrate(s)
        raise SqlError("unsupported statement")

    def _create(self, s: ast.CreateTable) -> None:
        key = s.name.lower()
        if key in self.views:
            if s.if_not_exists:
                return None
            raise SqlError(f"table {s.name} exists")
        if s.query is not None:
            plan, _ = self.optimized(self.plan(s.query))
            self.budget.check(*cost.calls_and_dollars(plan, self.catalog, self.cost_model())) if plan_calls(plan) else None
            df = loops.keep(Lowering(self.spark, self.views, Runtime(self)).frame(_named(plan)), "table")
            names = [n for n, _ in plan.fields]
            if len({n.lower() for n in names}) < len(names):
                raise SqlError("CREATE TABLE AS needs distinct column names")
            self.register(s.name, df.toDF(*names), fields=tuple((n, "TEXT" if t == "ANY" else t) for n, t in plan.fields))
        else:
            schema = ", ".join(f"`{n}` {spark_type(t)}" for n, t, _ in s.columns)
            self.register(s.name, self.spark.createDataFrame([], schema), fields=tuple((n, t) for n, t, _ in s.columns))
        return None

    def _insert(self, s: ast.Insert) -> None:
        key = s.table.lower()
        if key not in self.views:
            raise unknown("table", s.table, self.views)
        fields = self.catalog.tables[key]
        names = [n.lower() for n, _ in fields]
        cols = [c.lower() for c in s.columns] or names
        for c in cols:
            if c not in names:
                raise unknown("column", c, names)
        plan, _ = self.optimized(self.plan(s.query))
        if len(plan.fields) != len(cols):
            raise SqlError(f"INSERT gives {len(plan.fields)} values for {len(cols)} columns")
        new = Lowering(self.spark, self.views, Runtime(self)).frame(_named(plan))
        old = self.frames[key]
        exprs = [f"CAST({new.columns[cols.index(n)]} AS {f.dataType.simpleString()}) AS `{f.name}`" if n in cols else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for n, f in zip(names, old.schema.fields)]
        # only the new rows are written: to a folder of their own beside the table's first rows
        base, path = self.appended.get(key) or (old, f"{loops.shared_dir(self.spark)}/insert-{uuid.uuid4().hex}")
        new.selectExpr(*exprs).write.parquet(f"{path}/{INSERT}={time.time_ns()}")
        self.register(s.table, base.union(self.spark.read.parquet(path).select(*[f"`{c}`" for c in old.columns])), fields=fields)
        self.appended[key] = (base, path)
        self.settings.get("_rows", {}).pop(key, None)
        return None

    def in_order(self, name: str) -> DataFrame:
        """A small table's rows in the order of their INSERTs, those of its creation first."""
        key = name.lower()
        if key not in self.appended:
            return self.frames[key]
        base, path = self.appended[key]
        later = self.spark.read.parquet(path)
        at = later.metadataColumn("_metadata")
        later = later.orderBy(INSERT, at["file_name"], at["row_index"]).select(*[f"`{c}`" for c in base.columns])
        rows = [tuple(r) for r in base.collect()] + [tuple(r) for r in later.collect()]
        return self.spark.createDataFrame(rows, base.schema).coalesce(1)

    def _set(self, s: ast.Set) -> None:
        if s.key not in SETTINGS:
            raise unknown("setting", s.key, SETTINGS)
        self.settings[s.key] = s.value
        if s.key == "memo":
            self.caller.use_memo = str(s.value).lower() in ("on", "true", "1")
        elif s.key.startswith("budget."):
            setattr(self.budget, s.key.removeprefix("budget."), int(s.value) if s.key == "budget.depth" else float(s.value))
        return None

    def _explain(self, s: ast.Explain) -> DataFrame:
        inner = s.statement
        q = inner if isinstance(inner, ast.Query) else getattr(inner, "query", None)
        if not isinstance(q, ast.Query):
            raise SqlError("EXPLAIN takes a query, or a statement around one")
        plan, report = self.optimized(self.plan(q))
        text = explain.render(plan, self.catalog, self.cost_model(), report)
        if s.analyze:
            before = len(self.calls)
            rows = Lowering(self.spark, self.views, Runtime(self)).frame(_named(plan)).count()
            made = [c for c in self.calls[before:] if not c["memo"]]
            text += f"\nactual: {rows} rows, {len(made)} calls, {sum(c['input_tokens'] + c['output_tokens'] for c in made)} tokens, ${sum(c['dollars'] for c in made):.4f}"
        elif not plan_calls(plan) and not any(n.op == "recursive" for n in plan.walk()):
            df = Lowering(self.spark, self.views, Runtime(self)).frame(_named(plan))
            text += "\n\n" + df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in text.split("\n")], "plan string")

    def _function(self, s: ast.CreateFunction) -> None:
        if s.name in BUILTINS or s.name in AGGREGATES or s.name in builtin_functions():
            raise SqlError(f"{s.name} is built in")
        if s.name in self.catalog.functions and not s.replace:
            raise SqlError(f"function {s.name} exists; CREATE OR REPLACE FUNCTION changes it")
        if s.kind == "shell" and "shell" in self.withheld:
            raise SqlError("shell is withheld in this session")
        if s.kind == "prompt":
            if s.returns == "VECTOR":
                raise SqlError("a prompt function cannot return VECTOR")
            import re

            for hole in re.findall(r"\{(\w+)\}", s.body):
                if hole not in {n for n, _ in s.args}:
                    raise SqlError(f"the placeholder {{{hole}}} is no argument of {s.name}")
        kind = {"prompt": "scalar", "sql": "pure", "shell": "tool"}[s.kind]
        self.catalog.functions[s.name] = FunctionDef(s.name, s.args, s.returns, kind, s.volatility, s.model, s.batch if s.kind == "prompt" else 1, None, s.body, s.kind, s.query)
        self.catalog.proxies.pop(s.name, None)
        if s.proxy:
            scorer = self.catalog.functions.get(s.proxy)
            if scorer is None:
                raise unknown("function", s.proxy, self.catalog.functions)
            if scorer.returns != "DOUBLE" or s.returns != "BOOLEAN":
                raise SqlError("PROXY takes a scorer that RETURNS DOUBLE, for a function that RETURNS BOOLEAN")
            low, high = s.thresholds or self.calibrations.get((s.body, s.proxy)) or (0.2, 0.8)
            self.catalog.proxies[s.name] = Proxy(s.proxy, low, high)
        return None

    def _call_tool(self, s: ast.CallTool) -> DataFrame:
        have = tools.TOOLS | {n: (types, least, columns) for n, (_, _, types, least, columns) in self.servers.items()}
        if s.tool in self.withheld or s.tool not in have:
            raise unknown("tool", s.tool, [t for t in have if t not in self.withheld])
        types, least, columns = have[s.tool]
        if not least <= len(s.args) <= len(types):
            raise SqlError(f"{s.tool} takes {least} to {len(types)} arguments")
        source = s.source.body if s.source is not None else None
        items = tuple((a, f"a{i}") for i, a in enumerate(s.args))
        q = ast.Query(ast.Select(items, ast.Derived(s.source, "q") if source is not None else None))
        if s.tool == "web_fetch" and s.tool not in self.servers and hasattr(self.web, "fetch_all"):
            return self._fetch_all(self.query(q))
        schema = ", ".join(f"`{n}` {spark_type(t)}" for n, t in columns)
        rows: list[tuple] = []
        parts: list[DataFrame] = []
        held = made = 0
        for r in self.query(q).toLocalIterator():  # in row order, one at a time
            new = self._tool(s.tool, list(r))
            rows += new
            held += sum(map(tools.row_bytes, [r, *new]))
            if held > HELD_BYTES:
                parts.append(self._kept_rows(rows, schema, made))
                self.trace["tool_calls"].spill(self.spark, 0)
                made, rows, held = made + len(rows), [], 0
        if not parts:
            return self.spark.createDataFrame(rows, schema)
        whole = self._kept_rows(rows, schema, made)
        for part in parts:
            whole = whole.union(part)
        return whole.orderBy("_at").drop("_at")

    def _kept_rows(self, rows: list[tuple], schema: str, first: int) -> DataFrame:
        """Rows as a table in the shared folder, numbered from first."""
        return loops.keep(self.spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], f"_at long, {schema}"), "called")

    def _fetch_all(self, urls: DataFrame) -> DataFrame:
        """web_fetch of each row where the pages are a table: the executors make the rows, once, and their trace."""
        urls = loops.keep(urls.toDF("url").select(F.monotonically_increasing_id().alias("at"), F.col("url").cast("string")), "urls")  # numbered in row order
        statement = getattr(self, "statement", "")
        refused = tools.refused_urls(self.web, urls).orderBy("at").first()
        if refused is not None:
            self.trace["tool_calls"].append({"statement": statement, "tool": "web_fetch", "args": json.dumps([refused.url], ensure_ascii=False), "bytes_out": 0, "elapsed_ms": 0, "error": refused.error})
            raise SqlError(refused.error)
        made = loops.keep(tools.fetched_pages(self.web, urls), "fetched")
        self.trace["tool_calls"].frames.append(made.select(F.lit(statement).alias("statement"), F.lit("web_fetch").alias("tool"), "args", "bytes_out", "elapsed_ms", "error"))
        missing = made.where("error IS NOT NULL").orderBy("at").select("error").first()
        if missing is not None:
            raise SqlError(missing.error)
        return made.orderBy("at").select("url", "status", "text", "tokens")

    def _tool(self, name: str, args: list) -> list[tuple]:
        """The rows of one call of a tool, traced."""
        began, rows, error = time.time(), [], None
        try:
            if name in self.servers:
                rows = self._serve(name, args)
            elif name == "send":
                rows = [(args[0], self._send(args[0], args[1]))]
            elif name in ("web_fetch", "web_search"):
                rows = tools.web(self.web, name, args)
            else:
                rows = tools.run(self._workspace(), name, args, self.allow_shell)
            return rows
        except Exception as e:
            error = str(e)
            raise
        finally:
            self.trace["tool_calls"].append({"statement": getattr(self, "statement", ""), "tool": name, "args": json.dumps(args, ensure_ascii=False), "bytes_out": sum(map(tools.row_bytes, rows)), "elapsed_ms": int(1000 * (time.time() - began)), "error": error})

    def _send(self, to: str, text: str) -> bool:
        """Mail to the parent or to a child by its handle; without a parent to this session itself."""
        other = (self.parent or self) if to == "parent" else self.pending[to][0] if to in self.pending else None
        if other is None:
            raise SqlError(f"send: there is no session {to}")
        other.mail.append((self.id, str(len(other.mail)), text))
        return True

    def connect(self, name: str, server: tools.Server) -> None:
        """Tools of a server as ``name_tool``: those it marks read-only are table functions, others run by CALL.

        Arguments go by place, required ones first; each text that a tool returns is a row.
        """
        for t in server.tools():
            required = [a for a in t["args"] if a in t.get("required", ())]
            order = required + sorted(a for a in t["args"] if a not in required)
            full, columns = f"{name}_{t['name']}", (("text", "TEXT"),)
            self.servers[full] = (server, (t["name"], order), tuple("TEXT" for _ in order), len(required), columns)
            if t.get("read_only"):
                self.catalog.functions[full] = FunctionDef(full, tuple((a, "TEXT") for a in order), columns, "tool", "stable", least=len(required), form="source")

    def _serve(self, name: str, args: list) -> list[tuple]:
        server, (tool, order), *_ = self.servers[name]
        return [(t,) for t in server.call(tool, {a: v for a, v in zip(order, args) if v is not None})]

    def _calibrate(self, s: ast.Calibrate) -> DataFrame:
        f, proxy = self.catalog.functions.get(s.name), self.catalog.proxies.get(s.name)
        if f is None or proxy is None:
            raise SqlError(f"CALIBRATE needs a prompt function with a PROXY; {s.name} is none")
        scorer = self.catalog.functions[proxy.function]
        rows = [tuple(r) for r in self.query(replace(s.query, limit=min(s.sample, s.query.limit or s.sample))).collect()]
        rows = [r for r in rows if all(v is not None for v in r)]
        scores = self.caller.scalar(scorer, rows)
        verdicts = self.caller.scalar(f, rows)
        pick = calibrate.thresholds(list(zip(scores, verdicts)), s.recall, s.precision)
        self.calibrations[f.body, proxy.function] = (pick.low, pick.high)
        self.catalog.proxies[s.name] = Proxy(proxy.function, pick.low, pick.high)
        row = (s.name, proxy.function, pick.low, pick.high, len(rows), pick.accepted, pick.asked, pick.rejected)
        return self.spark.createDataFrame([row], "function string, proxy string, low double, high double, sample long, accepted long, asked long, rejected long")

    # rows of tools and table calls

    def rows_of(self, f: FunctionDef, args: tuple) -> list[tuple]:
        if f.name == "expand":
            text = self.caller.ask("worker", f"{args[0]}\nAnswer with a JSON array of at most {args[1]} strings.", "expand")
            return [(x,) for x in call_ops.parse_items(text, int(args[1]))]
        if f.name == "inbox":
            return list(self.mail)
        if f.kind == "recursive":
            return self._delegate(f, args)
        if f.name in self.servers:
            return self._tool(f.name, list(args))
        return getattr(self._workspace(), f.name)(*args)

    def _delegate(self, f: FunctionDef, args: tuple) -> list[tuple]:
        if f.name == "await":
            if args[0] not in self.pending:
                raise SqlError(f"await: there is no child {args[0]} of this session")
            return [self.pending.pop(args[0])[1].result()]
        agent, task, context = (None, args[0], args[1] if len(args) > 1 else None) if f.name == "rlm" else (args[0], args[1], args[2] if len(args) > 2 else None)
        if agent is not None and agent.lower() not in self.catalog.agents:
            raise unknown("agent", agent, self.catalog.agents)
        child, role, part = self._new_child(agent, task, context)
        if f.name == "spawn_async":
            handle = uuid.uuid4().hex[:12]
            self._pool = self._pool or ThreadPoolExecutor(self.caller.concurrency)
            self.pending[handle] = (child, self._pool.submit(self._carry_out, child, role, task, part))
            return [(handle, child.id)]
        answer, detail, name = self._carry_out(child, role, task, part)
        return [(answer, detail)] if f.name == "rlm" else [(answer, detail, name)]

    def _new_child(self, agent: str | None, task: str, context: str | None) -> tuple[Session, object, Budget]:
        """A child session at one depth more, with the tools of its role, on a slice of the budget. It sees no table of its parent."""
        if self.runner is None:
            raise SqlError("rlm and spawn need a running harness; give the session a runner")
        if self.depth + 1 > self.budget.depth:
            raise SqlError(f"delegation stops at depth {self.budget.depth}")
        role = self.catalog.agents.get(agent.lower()) if agent else None
        part = self.budget.slice()
        part.depth = self.budget.depth
        if role is not None:
            part = part.narrowed({k: v for k, v in role.budget if k in ("calls", "tokens", "dollars", "depth")})
        withheld = self.withheld | ({t for t, d in builtin_functions().items() if d.kind == "tool" and t not in role.tools} | {t for t in tools.TOOLS if t not in role.tools} if role is not None and role.tools is not None else set())
        child = Session(self.spark, self.caller.provider, str(self.workspace.root) if self.workspace else None, self.runner, part, self.caller.concurrency, tuple(withheld), self.allow_shell, self.depth + 1, self.memo,
                        web=self.web, trace=self.trace, parent=self, task=task, role=agent or "rlm")
        child.caller.answers = self.caller.answers
        if context is not None:
            child.context(context)
        return child, role, part

    def _carry_out(self, child: Session, role, task: str, part: Budget) -> tuple:
        """The child's answer, its detail as JSON, and its id; what it spends is charged here."""
        outcome, turns = "error", 0
        try:
            answer, detail = self.runner(child, role, task)
            outcome, turns = "final" if child.answer is not None or answer is not None else "turns_exhausted", int(detail.get("turns", 0))
            return answer, json.dumps(detail), child.id
        except BudgetError:
            outcome = "budget_exhausted"
            raise
        finally:
            child.close(outcome, turns)
            self.budget.settle(-int(part.used_calls), part.used_tokens, part.used_dollars)

    def close(self, outcome: str = "final", turns: int = 0) -> None:
        """Wait for the children that nobody awaited, and note the session's end."""
        for _, future in list(self.pending.values()):
            future.exception()
        if self._pool is not None:
            self._pool.shutdown()
        b = self.budget
        self.trace["session_ends"].append({"session": self.id, "finished_at": time.time(), "outcome": outcome, "turns": turns, "calls": int(b.used_calls), "tokens": int(b.used_tokens), "dollars": float(b.used_dollars)})

    # tables about the session itself

    def system(self, name: str) -> DataFrame:
        """trace_runs, trace_sessions, trace_statements, trace_calls, trace_tool_calls, trace_rounds, trace_final, memo, estimates, calibrations or columns as a DataFrame."""
        traces = ("runs", "sessions", "statements", "calls", "tool_calls", "rounds", "final")
        if name.removeprefix("trace_") in traces and name.startswith("trace_"):
            return self.trace.frame(self.spark, name.removeprefix("trace_"))
        if name == "columns":
            rows = [(t, i, c, k) for t, fields in self.catalog.tables.items() for i, (c, k) in enumerate(fields)]
            return self.spark.createDataFrame(rows, "table_name string, column_index int, column_name string, data_type string")
        if name == "memo":
            return self.spark.createDataFrame(list(self.memo.items()), "fingerprint string, response string")
        if name == "estimates":
            rows = [(k, n, sum(s[0] for s in v) / max(1, sum(s[1] for s in v)), sum(s[1] for s in v)) for (k, n), v in self.learned.items()]
            return self.spark.createDataFrame(rows, "kind string, name string, value double, observations long")
        if name == "calibrations":
            return self.spark.createDataFrame([(*k, *v) for k, v in self.calibrations.items()], "template string, proxy string, low double, high double")
        raise unknown("system table", name, (*(f"trace_{t}" for t in traces), "memo", "estimates", "calibrations", "columns"))


def _named(plan: Plan) -> Plan:
    """The plan with column names that are distinct."""
    return replace(plan, fields=tuple((f"c{i}", t) for i, (_, t) in enumerate(plan.fields)))
