"""From plans to Spark: pure parts become one Spark SQL text that Catalyst optimises as a whole.

Model calls, recursion and tools run between such parts: their input is computed, they are carried out by the
operators in :mod:`sqlume.operators`, and their result enters the text around them as a view.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sqlume.errors import SqlError
from sqlume.functions.builtins import BUILTINS, cast, divide, render, spark_type, string
from sqlume.plans.logical import Plan, X, conjoin, conjuncts, has_call, max_outer, plan_calls, rewrite

Context = Callable[[int], str]
_IDS = itertools.count()


def dialect_type(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "TEXT"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return "VECTOR"
    return t.simpleString().upper()  # kept native


def spark_schema(fields) -> str:
    return ", ".join(f"c{i} {spark_type(t) if t != 'ANY' else 'STRING'}" for i, (_, t) in enumerate(fields)) or "c0 STRING"


class Lowering:
    """Lowers the plans of one statement. runtime carries out calls, tools and recursion."""

    def __init__(self, spark: SparkSession, views: dict[str, str], runtime) -> None:
        self.spark, self.views, self.runtime = spark, views, runtime
        self.ctes: dict[str, tuple[str, tuple]] = {}  # name -> view

    # entry points

    def frame(self, plan: Plan) -> DataFrame:
        """A lazy DataFrame with the plan's column names."""
        df = self.spark.sql(self.text(plan))
        return df.toDF(*[n for n, _ in plan.fields]) if plan.fields else df

    def text(self, plan: Plan) -> str:
        return self.rel(plan, [])

    def view(self, df: DataFrame) -> str:
        name = f"sqlume_v{next(_IDS)}"
        df.createOrReplaceTempView(name)
        self.runtime.temporary.append(name)
        return name

    def _alias(self) -> str:
        return f"q{next(_IDS)}"

    # relations: SELECT texts whose columns are c0, c1, ...

    def rel(self, p: Plan, outer: list[Context]) -> str:
        return getattr(self, f"_{p.op}")(p, outer)

    def _scan(self, p: Plan, outer: list[Context]) -> str:
        view, columns = self.views[p.info["table"]]
        return f"SELECT {', '.join(f'{sql} AS c{i}' for i, sql in enumerate(columns)) or '1 AS c0'} FROM {view}"

    def _values(self, p: Plan, outer: list[Context]) -> str:
        rows = p.info["rows"]
        if not p.fields:
            return "SELECT 1 AS c0"
        none: Context = lambda i: f"c{i}"
        texts = []
        for r in rows:
            cells = [f"CAST({self.expr(x, none, outer)} AS {spark_type(t)})" if t != "ANY" else self.expr(x, none, outer) for x, (_, t) in zip(r, p.fields)]
            texts.append(f"({', '.join(cells)})")
        if any(max_outer(x) or isinstance(y.val, Plan) for r in rows for x in r for y in x.walk()):
            return " UNION ALL ".join("SELECT " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(self._split(t))) for t in texts)
        return f"SELECT * FROM VALUES {', '.join(texts)} AS {self._alias()}({', '.join(f'c{i}' for i in range(len(p.fields)))})"

    @staticmethod
    def _split(row: str) -> list[str]:
        out, depth, start, quote = [], 0, 1, False
        for k, ch in enumerate(row):
            if ch == "'" and row[k - 1] != "\\":
                quote = not quote
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")":
                depth -= 1
            if not quote and (ch == "," and depth == 1 or k == len(row) - 1):
                out.append(row[start:k])
                start = k + 1
        return out

    def _cte(self, p: Plan, outer: list[Context]) -> str:
        view, fields = self.ctes[p.info["name"]]
        return f"SELECT {', '.join(f'c{i}' for i in range(len(fields)))} FROM {view}"

    def _with(self, p: Plan, outer: list[Context]) -> str:
        before = dict(self.ctes)
        for name, plan in zip(p.info["names"], p.inputs):
            if plan.op == "recursive":
                view = self.runtime.fixpoint(self, plan)
            elif plan_calls(plan):
                view = self.view(self.runtime.keep(self.spark.sql(self.rel(plan, outer)), name))
            else:
                view = self.view(self.spark.sql(self.rel(plan, outer)))
            self.ctes[name] = (view, plan.fields)
        out = self.rel(p.inputs[-1], outer)
        self.ctes = before
        return out

    def _recursive(self, p: Plan, outer: list[Context]) -> str:
        view = self.runtime.fixpoint(self, p)
        return f"SELECT * FROM {view}"

    def _project(self, p: Plan, outer: list[Context]) -> str:
        exprs, child = p.info["exprs"], p.inputs[0]
        if any(map(has_call, exprs)):
            view, exprs = self.runtime.resolve_calls(self, child, exprs, outer)
            source, ctx = view, (lambda i: f"c{i}")
        else:
            a = self._alias()
            source, ctx = f"({self.rel(child, outer)}) {a}", (lambda i: f"{a}.c{i}")
            if p.info.get("strip") and child.op in ("sort", "limit"):
                # sorting is kept by the projection above it
                return f"SELECT {', '.join(f'{self.expr(x, ctx, outer)} AS c{i}' for i, x in enumerate(exprs))} FROM {source}"
        return f"SELECT {', '.join(f'{self.expr(x, ctx, outer)} AS c{i}' for i, x in enumerate(exprs)) or '1 AS c0'} FROM {source}"

    def _filter(self, p: Plan, outer: list[Context]) -> str:
        pred, child = p.info["pred"], p.inputs[0]
        names = ", ".join(f"c{i}" for i in range(len(child.fields))) or "1 AS c0"
        if has_call(pred):
            # conjuncts without calls first, then the others one after the other on the rows that are left
            parts = conjuncts(pred)
            pure = conjoin([c for c in parts if not has_call(c)])
            below = Plan("filter", (child,), child.fields, {"pred": pure}) if pure is not None else child
            view, (pred,) = self.runtime.resolve_calls(self, below, [conjoin([c for c in parts if has_call(c)])], outer)
            return f"SELECT {names} FROM {view} WHERE {self.expr(pred, lambda i: f'c{i}', outer)}"
        a = self._alias()
        return f"SELECT {names} FROM ({self.rel(child, outer)}) {a} WHERE {self.expr(pred, lambda i: f'{a}.c{i}', outer)}"

    def _join(self, p: Plan, outer: list[Context]) -> str:
        left, right = p.inputs
        kind, pred = p.info["kind"], p.info["pred"]
        if pred is not None and has_call(pred):
            return self.runtime.join_calls(self, p, outer)
        a, b, n = self._alias(), self._alias(), len(left.fields)
        ctx: Context = lambda i: f"{a}.c{i}" if i < n else f"{b}.c{i - n}"
        word = {"inner": "JOIN", "left": "LEFT JOIN", "cross": "CROSS JOIN", "semi": "LEFT SEMI JOIN", "anti": "LEFT ANTI JOIN"}[kind]
        own = range(n if kind in ("semi", "anti") else n + len(right.fields))
        cols = ", ".join(f"{ctx(i)} AS c{i}" for i in own) or "1 AS c0"
        on = f" ON {self.expr(pred, ctx, outer)}" if pred is not None else " ON true" if kind != "cross" else ""
        if pred is not None and kind == "inner" and any(isinstance(x.val, Plan) for x in pred.walk()):
            return f"SELECT {cols} FROM ({self.rel(left, outer)}) {a} CROSS JOIN ({self.rel(right, outer)}) {b} WHERE {self.expr(pred, ctx, outer)}"
        return f"SELECT {cols} FROM ({self.rel(left, outer)}) {a} {word} ({self.rel(right, outer)}) {b}{on}"

    def _tablefunc(self, p: Plan, outer: list[Context]) -> str:
        return self.runtime.table_function(self, p, outer)

    def _aggregate(self, p: Plan, outer: list[Context]) -> str:
        child, groups, aggs = p.inputs[0], p.info["groups"], p.info["aggs"]
        if any(map(has_call, (*groups, *aggs))):
            view, exprs = self.runtime.resolve_calls(self, child, [*groups, *aggs], outer)
            groups, aggs = exprs[: len(groups)], exprs[len(groups) :]
            source, ctx = view, (lambda i: f"c{i}")
        else:
            a = self._alias()
            source, ctx = f"({self.rel(child, outer)}) {a}", (lambda i: f"{a}.c{i}")
        cols = [self.expr(g, ctx, outer) for g in groups]
        items = [f"{c} AS c{i}" for i, c in enumerate(cols)] + [f"{self.aggregate(x, ctx, outer)} AS c{len(cols) + i}" for i, x in enumerate(aggs)]
        by = f" GROUP BY {', '.join(cols)}" if cols else ""
        if cols and all(g.op == "lit" for g in groups):
            by = " GROUP BY " + ", ".join(str(i + 1) for i in range(len(cols)))
        elif any(g.op == "lit" for g in groups):
            by = " GROUP BY " + ", ".join(str(i + 1) for i in range(len(cols)))
        return f"SELECT {', '.join(items)} FROM {source}{by}"

    def aggregate(self, x: X, ctx: Context, outer: list[Context]) -> str:
        name, distinct, n, order = x.val
        args = [self.expr(a, ctx, outer) for a in x.args]
        d = "DISTINCT " if distinct else ""
        if name == "count" and not n:
            return "count(*)"
        if name == "avg":
            return f"avg({d}CAST({args[0]} AS DOUBLE))"
        if name == "string_agg":
            value, sep = render(args[0], x.args[0].type), args[1]
            if order and distinct:
                flip = "" if not order[0][0] else "sort_desc"
                inner = f"array_sort(array_agg(DISTINCT {value}))" if not flip else f"sort_array(array_agg(DISTINCT {value}), false)"
                return f"(CASE WHEN count({value}) > 0 THEN array_join({inner}, first({sep})) END)"
            keys = ", ".join(self._order(a, o) for a, o in zip(args[n:], order))
            if x.args[1].op == "lit":
                return f"listagg({d}{value}, {sep})" + (f" WITHIN GROUP (ORDER BY {keys})" if keys else "")
            within = f" WITHIN GROUP (ORDER BY {keys})" if keys else ""
            return f"listagg({d}{value} , '\\u0001'){within}"
        return f"{name}({d}{args[0]})"

    @staticmethod
    def _order(sql: str, o: tuple[bool, bool]) -> str:
        return f"{sql} {'DESC' if o[0] else 'ASC'} NULLS {'FIRST' if o[1] else 'LAST'}"

    def _sort(self, p: Plan, outer: list[Context]) -> str:
        child, keys = p.inputs[0], p.info["keys"]
        names = ", ".join(f"c{i}" for i in range(len(child.fields)))
        if any(has_call(k[0]) for k in keys):
            view, exprs = self.runtime.resolve_calls(self, child, [k[0] for k in keys], outer)
            source, ctx = view, (lambda i: f"c{i}")
            keys = [(x, *k[1:]) for x, k in zip(exprs, keys)]
        else:
            a = self._alias()
            source, ctx = f"({self.rel(child, outer)}) {a}", (lambda i: f"{a}.c{i}")
        return f"SELECT {names} FROM {source} ORDER BY {', '.join(self._order(self.expr(k, ctx, outer), o) for k, *o in keys)}"

    def _limit(self, p: Plan, outer: list[Context]) -> str:
        n, skip = p.info["limit"], p.info["offset"]
        child = p.inputs[0]
        tail = (f" LIMIT {n}" if n is not None else "") + (f" OFFSET {skip}" if skip else "")
        if child.op == "sort" or child.op == "project" and child.info.get("strip"):
            if child.op == "project":  # keep ORDER BY and LIMIT in one SELECT, below the projection
                inner = self.rel(child.inputs[0], outer) + tail
                a = self._alias()
                return f"SELECT {', '.join(f'{a}.c{i}' for i in range(len(p.fields)))} FROM ({inner}) {a}"
            return self.rel(child, outer) + tail
        names = ", ".join(f"c{i}" for i in range(len(child.fields))) or "*"
        return f"SELECT {names} FROM ({self.rel(child, outer)}) {self._alias()}{tail}"

    def _distinct(self, p: Plan, outer: list[Context]) -> str:
        return f"SELECT DISTINCT * FROM ({self.rel(p.inputs[0], outer)}) {self._alias()}"

    def _union(self, p: Plan, outer: list[Context]) -> str:
        parts = []
        for i in p.inputs:
            a = self._alias()
            cols = ", ".join(f"CAST({a}.c{k} AS {spark_type(t)}) AS c{k}" if have != t and t != "ANY" else f"{a}.c{k} AS c{k}" for k, ((_, t), (_, have)) in enumerate(zip(p.fields, i.fields)))
            parts.append(f"SELECT {cols} FROM ({self.rel(i, outer)}) {a}")
        return (" UNION ALL " if p.info["all"] else " UNION ").join(parts)

    # expressions

    def expr(self, x: X, ctx: Context, outer: list[Context]) -> str:
        go = lambda y: self.expr(y, ctx, outer)
        op = x.op
        if op == "col":
            return ctx(x.val)
        if op == "outer":
            depth, i = x.val
            return outer[-depth](i)
        if op == "lit":
            v = x.val
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, int):
                return f"{v}L" if v >= 0 else f"(-{-v}L)" if v > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)"
            if isinstance(v, float):
                return f"double('{v!r}')" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D" if v >= 0 else f"({v!r}D)"
            return string(v)
        if op == "fn":
            args = [go(a) for a in x.args]
            if BUILTINS[x.val].takes and any(w == "TEXT" and a.type == "JSON" for w, a in zip(BUILTINS[x.val].takes, x.args)):
                pass  # JSON is held as text
            return BUILTINS[x.val].sql(args, [a.type for a in x.args])
        if op == "cast":
            return cast(go(x.args[0]), x.args[0].type, x.type)
        if op == "case":
            a = x.args
            as_type = (lambda y: f"CAST({go(y)} AS DOUBLE)" if x.type == "DOUBLE" and y.type == "BIGINT" else go(y))
            whens = " ".join(f"WHEN {go(a[i]) if a[i].type != 'ANY' else 'CAST(NULL AS BOOLEAN)'} THEN {as_type(a[i + 1])}" for i in range(0, len(a) - 1, 2))
            return f"(CASE {whens} ELSE {as_type(a[-1])} END)"
        if op == "in":
            return f"({go(x.args[0])} IN ({', '.join(go(a) for a in x.args[1:])}))"
        if op in ("exists", "inquery", "scalar"):
            inner = self.rel(x.val, [*outer, ctx])
            if op == "exists":
                return f"EXISTS ({inner})"
            if op == "scalar":
                return f"({inner})"
            return f"({go(x.args[0])} IN ({inner}))"
        if op in ("AND", "OR"):
            return f"({go(x.args[0])} {op} {go(x.args[1])})"
        if op == "NOT":
            if x.args[0].op == "inquery":
                return f"({go(x.args[0].args[0])} NOT IN ({self.rel(x.args[0].val, [*outer, ctx])}))"
            return f"(NOT {go(x.args[0])})"
        if op in ("IS NULL", "IS TRUE", "IS FALSE"):
            return f"({go(x.args[0])} {op})"
        if op in ("=", "<>", "<", "<=", ">", ">="):
            a, b = (go(y) for y in x.args)
            if x.val == "never":
                return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {'false' if op == '=' else 'true'} END)"
            return f"({a} {op} {b})"
        if op in ("LIKE", "ILIKE"):
            a, b = (go(y) for y in x.args)
            if op == "ILIKE":
                a, b = f"lower({a})", f"lower({b})"
            return f"({a} LIKE {b} ESCAPE '\\u0001')"
        if op == "||":
            a, b = (render(go(y), y.type) for y in x.args)
            return f"({a} || {b})"
        if op == "NEG":
            return f"(- {go(x.args[0])})"
        if op == "/":
            a, b = (f"CAST({go(y)} AS DOUBLE)" if y.type != "DOUBLE" else go(y) for y in x.args)
            return divide(a, b)
        if op == "%":
            a, b = (go(y) for y in x.args)
            if x.type == "BIGINT":
                return f"try_mod({a}, {b})"
            a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            return f"(CASE WHEN {b} = 0 THEN double('nan') ELSE {a} % {b} END)"
        if op in ("+", "-", "*"):
            return f"({go(x.args[0])} {op} {go(x.args[1])})"
        raise SqlError(f"a model call cannot be used here ({op})")


def shifted(x: X, by: int) -> X:
    """Columns moved to the right."""
    return rewrite(x, lambda y: replace(y, val=y.val + by) if y.op == "col" else None)
