"""From syntax to plans: names, types, aggregates, and what the dialect refuses."""

from __future__ import annotations

from dataclasses import replace

from sqlume.catalog import Catalog, FunctionDef
from sqlume.errors import SqlError, unknown
from sqlume.functions.builtins import AGGREGATES, BUILTINS, common, first_typed
from sqlume.plans import ast
from sqlume.plans.logical import Plan, X, col, rewrite

_NUM = ("BIGINT", "DOUBLE")


class Scope:
    """Columns that expressions see, and the scopes around them."""

    def __init__(self, columns: list[tuple[str | None, str, str]], parent: Scope | None = None) -> None:
        self.columns, self.parent = columns, parent

    def find(self, name: str, table: str | None) -> X:
        scope, depth = self, 0
        while scope is not None:
            hits = [i for i, (t, c, _) in enumerate(scope.columns) if c.lower() == name.lower() and (table is None or t is not None and t.lower() == table.lower())]
            if len(hits) > 1:
                raise SqlError(f"column {name} is ambiguous; qualify it with its table")
            if hits:
                kind = scope.columns[hits[0]][2]
                return X("outer", (), kind, (depth, hits[0])) if depth else X("col", (), kind, hits[0])
            scope, depth = scope.parent, depth + 1
        seen = []
        scope = self
        while scope is not None:
            seen += [c for _, c, _ in scope.columns]
            scope = scope.parent
        raise unknown("column", f"{table}.{name}" if table else name, seen)


def _label(e) -> str:
    if isinstance(e, ast.Col):
        return e.name
    if isinstance(e, ast.Func):
        return e.name
    if isinstance(e, ast.Cast):
        return _label(e.arg)
    if isinstance(e, ast.Lit):
        return "NULL" if e.value is None else str(e.value)
    return "expr" if not isinstance(e, ast.Case) else "case"


class Resolver:
    def __init__(self, catalog: Catalog, max_rounds: int | None = None) -> None:
        self.catalog, self.max_rounds = catalog, max_rounds

    # queries

    def query(self, q: ast.Query, outer: Scope | None = None, ctes: dict | None = None) -> Plan:
        ctes = dict(ctes or {})
        bound: list[tuple[str, Plan]] = []
        loops: list = []
        for c in q.ctes:
            if c.name.lower() in {n for n, _ in bound}:
                raise SqlError(f"the name {c.name} is given twice in WITH")
            if q.recursive and _mentions(c.query, c.name):
                if loops:
                    raise SqlError("one recursive CTE in a query; move the other into its own statement")
                plan = self._recursive(c, outer, ctes)
                loops.append(c.name)
            else:
                plan = self.query(c.query, outer, ctes)
            plan = _renamed(plan, c.columns)
            ctes[c.name.lower()] = plan.fields
            bound.append((c.name.lower(), plan))
        body = self._body(q, outer, ctes)
        return Plan("with", (*(p for _, p in bound), body), body.fields, {"names": tuple(n for n, _ in bound)}) if bound else body

    def _body(self, q: ast.Query, outer: Scope | None, ctes: dict) -> Plan:
        b = q.body
        if isinstance(b, ast.Select):
            plan = self._select(b, q.order, outer, ctes)
        else:
            if isinstance(b, ast.Query):
                plan = self.query(b, outer, ctes)
            elif isinstance(b, ast.Values):
                plan = self._values(b, outer, ctes)
            else:
                plan = self._union(b, outer, ctes)
            if q.order:
                scope = Scope([(None, n, t) for n, t in plan.fields], outer)
                keys = [(self._order_key(o.expr, plan.fields, scope, ctes), o.desc, o.nulls_first) for o in q.order]
                plan = Plan("sort", (plan,), plan.fields, {"keys": tuple(keys)})
        if q.limit is not None or q.offset:
            plan = Plan("limit", (plan,), plan.fields, {"limit": q.limit, "offset": q.offset})
        return plan

    def _order_key(self, e, fields, scope: Scope, ctes: dict) -> X:
        if isinstance(e, ast.Lit) and isinstance(e.value, int) and not isinstance(e.value, bool):
            if not 1 <= e.value <= len(fields):
                raise SqlError(f"ORDER BY {e.value}: there are {len(fields)} columns")
            return col(e.value - 1, fields)
        return self.expr(e, scope, ctes)

    def _values(self, v: ast.Values, outer: Scope | None, ctes: dict) -> Plan:
        scope = Scope([], outer)
        rows = [[self.expr(e, scope, ctes) for e in r] for r in v.rows]
        types = [common([r[i].type for r in rows]) for i in range(len(rows[0]))]
        for r in rows:
            for x, t in zip(r, types):
                if x.type not in (t, "ANY") and not (x.type in _NUM and t in _NUM):
                    raise SqlError(f"VALUES mixes {t} and {x.type} in a column")
        return Plan("values", (), tuple((f"col{i}", t) for i, t in enumerate(types)), {"rows": tuple(map(tuple, rows))})

    def _union(self, u: ast.Union, outer: Scope | None, ctes: dict) -> Plan:
        inputs = [self._body(ast.Query(i) if not isinstance(i, ast.Query) else i, outer, ctes) if not isinstance(i, ast.Query) else self.query(i, outer, ctes) for i in u.inputs]
        if len({len(i.fields) for i in inputs}) > 1:
            raise SqlError("UNION takes queries of as many columns")
        fields = []
        for k, (name, _) in enumerate(inputs[0].fields):
            kinds = [i.fields[k][1] for i in inputs]
            known = {t for t in kinds if t != "ANY"}
            if len(known) > 1 and not known <= set(_NUM):
                raise SqlError(f"UNION mixes {' and '.join(sorted(known))} in column {name}")
            fields.append((name, common(kinds)))
        return Plan("union", tuple(inputs), tuple(fields), {"all": u.all})

    def _recursive(self, c: ast.Cte, outer: Scope | None, ctes: dict) -> Plan:
        q = c.query
        if not isinstance(q.body, ast.Union) or len(q.body.inputs) != 2 or q.ctes:
            raise SqlError(f"recursive CTE {c.name} takes the form base UNION [ALL] recursive term")
        base_q, rec_q = q.body.inputs
        if _mentions(base_q, c.name):
            raise SqlError(f"the first part of recursive CTE {c.name} cannot refer to it")
        if q.order and q.limit is None:
            raise SqlError("ORDER BY in a recursive CTE needs LIMIT: together they keep the best rows of each round")
        as_query = lambda x: x if isinstance(x, ast.Query) else ast.Query(x)
        base = _renamed(self.query(as_query(base_q), outer, ctes), c.columns)
        inner = {**ctes, c.name.lower(): base.fields}
        term = as_query(rec_q)
        if q.order or q.limit is not None:
            term = replace(term, order=q.order, limit=q.limit, offset=q.offset) if isinstance(term.body, ast.Select) and term.limit is None else ast.Query(term, (), False, q.order, q.limit, q.offset)
        rec = self.query(term, outer, inner)
        if len(rec.fields) != len(base.fields):
            raise SqlError(f"recursive CTE {c.name}: both parts must have as many columns")
        fields = tuple((n, common([t, r])) for (n, t), (_, r) in zip(base.fields, rec.fields))
        return Plan("recursive", (base, rec), fields, {"name": c.name.lower(), "all": q.body.all, "max_rounds": self.max_rounds})

    # SELECT

    def _select(self, s: ast.Select, order: tuple, outer: Scope | None, ctes: dict) -> Plan:
        if s.source is None:
            plan, scope = Plan("values", (), (), {"rows": ((),)}), Scope([], outer)
        else:
            plan, columns = self._source(s.source, outer, ctes)
            scope = Scope(columns, outer)
        if s.where is not None:
            plan = Plan("filter", (plan,), plan.fields, {"pred": self._boolean(s.where, scope, ctes, "WHERE")})
        items: list[tuple[object, str]] = []
        exprs: list[X] = []
        for e, alias in s.items:
            if isinstance(e, ast.Star):
                hit = [i for i, (t, _, _) in enumerate(scope.columns) if e.table is None or t is not None and t.lower() == e.table.lower()]
                if not hit:
                    raise unknown("table", e.table or "*", [t for t, _, _ in scope.columns if t])
                for i in hit:
                    items.append((None, scope.columns[i][1]))
                    exprs.append(X("col", (), scope.columns[i][2], i))
            else:
                items.append((e, alias or _label(e)))
                exprs.append(self.expr(e, scope, ctes, aggs=True))
        keys: list[tuple[X | int, bool, bool]] = []
        names = [n.lower() for _, n in items]
        for o in order:
            e = o.expr
            if isinstance(e, ast.Lit) and isinstance(e.value, int) and not isinstance(e.value, bool):
                if not 1 <= e.value <= len(items):
                    raise SqlError(f"ORDER BY {e.value}: there are {len(items)} columns")
                keys.append((e.value - 1, o.desc, o.nulls_first))
            elif isinstance(e, ast.Col) and e.table is None and e.name.lower() in names:
                keys.append((names.index(e.name.lower()), o.desc, o.nulls_first))
            else:
                alias_of = {n: x for (src, n), x in zip(items, exprs)}
                keys.append((self.expr(e, scope, ctes, aggs=True, aliases=alias_of), o.desc, o.nulls_first))
        groups: list[X] = []
        for g in s.group:
            if isinstance(g, ast.Lit) and isinstance(g.value, int) and not isinstance(g.value, bool):
                if not 1 <= g.value <= len(exprs):
                    raise SqlError(f"GROUP BY {g.value}: there are {len(exprs)} columns")
                groups.append(exprs[g.value - 1])
            elif isinstance(g, ast.Col) and g.table is None and g.name.lower() in names and not any(c.lower() == g.name.lower() for _, c, _ in scope.columns):
                groups.append(exprs[names.index(g.name.lower())])
            else:
                groups.append(self.expr(g, scope, ctes))
            if any(a.op == "agg" for a in groups[-1].walk()):
                raise SqlError("GROUP BY takes no aggregates")
        having = None
        if s.having is not None:
            alias_of = {n: x for (src, n), x in zip(items, exprs)}
            having = self.expr(s.having, scope, ctes, aggs=True, aliases=alias_of)
            if having.type not in ("BOOLEAN", "ANY"):
                raise SqlError("HAVING takes a condition")
        every = [*exprs, *(k for k, _, _ in keys if isinstance(k, X)), *([having] if having is not None else [])]
        aggs: list[X] = []
        for x in every:
            for a in x.walk():
                if a.op == "agg" and a not in aggs:
                    aggs.append(a)
        if s.having is not None and not (aggs or groups):
            raise SqlError("HAVING needs GROUP BY or an aggregate; WHERE filters rows")
        if groups or aggs:
            fields = tuple((f"g{i}", g.type) for i, g in enumerate(groups)) + tuple((f"a{i}", a.type) for i, a in enumerate(aggs))
            source_columns = scope.columns
            plan = Plan("aggregate", (plan,), fields, {"groups": tuple(groups), "aggs": tuple(aggs)})

            def lift(x: X) -> X:
                def at(y: X) -> X | None:
                    if y in groups:
                        return X("col", (), y.type, groups.index(y))
                    if y.op == "agg":
                        return X("col", (), y.type, len(groups) + aggs.index(y))
                    if y.op == "col":
                        raise SqlError(f"column {source_columns[y.val][1]} must appear in GROUP BY or in an aggregate")
                    return None

                return rewrite(x, at)

            exprs = [lift(x) for x in exprs]
            keys = [(lift(k) if isinstance(k, X) else k, d, n) for k, d, n in keys]
            if having is not None:
                plan = Plan("filter", (plan,), plan.fields, {"pred": lift(having)})
        hidden = [k for k, _, _ in keys if isinstance(k, X)]
        if hidden and s.distinct:
            bad = [h for h in hidden if h not in exprs]
            if bad:
                raise SqlError("ORDER BY with SELECT DISTINCT takes selected columns only")
            keys = [(exprs.index(k) if isinstance(k, X) else k, d, n) for k, d, n in keys]
            hidden = []
        fields = tuple((n, x.type) for (_, n), x in zip(items, exprs))
        wide = fields + tuple((f"k{i}", h.type) for i, h in enumerate(hidden))
        plan = Plan("project", (plan,), wide, {"exprs": (*exprs, *hidden)})
        if s.distinct:
            plan = Plan("distinct", (plan,), plan.fields)
        if keys:
            at, sort = len(fields), []
            for k, d, n in keys:
                if isinstance(k, X):
                    sort.append((col(at, wide), d, n))
                    at += 1
                else:
                    sort.append((col(k, wide), d, n))
            plan = Plan("sort", (plan,), wide, {"keys": tuple(sort), "visible": len(fields)})
        return plan if not hidden else Plan("project", (plan,), fields, {"exprs": tuple(col(i, wide) for i in range(len(fields))), "strip": True})

    # FROM

    def _source(self, s, outer: Scope | None, ctes: dict) -> tuple[Plan, list]:
        if isinstance(s, ast.Table):
            key = s.name.lower()
            if key in ctes:
                plan = Plan("cte", (), ctes[key], {"name": key})
            elif key in self.catalog.tables:
                plan = Plan("scan", (), self.catalog.tables[key], {"table": key})
            else:
                raise unknown("table", s.name, [*ctes, *self.catalog.tables])
            plan = _renamed(plan, s.columns)
            return plan, [(s.alias or s.name, n, t) for n, t in plan.fields]
        if isinstance(s, ast.Derived):
            plan = _renamed(self.query(s.query, outer, ctes), s.columns)
            return plan, [(s.alias, n, t) for n, t in plan.fields]
        if isinstance(s, ast.TableFunc):
            return self._table_func(s, None, [], outer, ctes)
        left, lcols = self._source(s.left, outer, ctes)
        if isinstance(s.right, ast.TableFunc):
            return self._table_func(s.right, left, lcols, outer, ctes)
        right, rcols = self._source(s.right, outer, ctes)
        columns = lcols + rcols
        pred = None
        if s.on is not None:
            pred = self._boolean(s.on, Scope(columns, outer), ctes, "ON")
        fields = left.fields + right.fields
        return Plan("join", (left, right), fields, {"kind": s.kind, "pred": pred}), columns

    def _table_func(self, s: ast.TableFunc, left: Plan | None, lcols: list, outer: Scope | None, ctes: dict) -> tuple[Plan, list]:
        f = self.catalog.functions.get(s.name)
        if f is None:
            raise unknown("table function", s.name, [n for n, d in self.catalog.functions.items() if d.is_table])
        if not f.is_table:
            raise SqlError(f"{s.name} is a scalar function; call it in SELECT")
        if f.volatility == "volatile":
            raise SqlError(f"{s.name} is volatile; run it with CALL {s.name}(...)")
        scope = Scope(lcols, outer)
        args = tuple(self._args(f, [self.expr(a, scope, ctes) for a in s.args]))
        fields = _renamed_fields(f.returns, s.columns)
        base = left.fields if left is not None else ()
        plan = Plan("tablefunc", (left,) if left is not None else (), base + fields, {"def": f, "args": args})
        return plan, lcols + [(s.alias or s.name, n, t) for n, t in fields]

    def _args(self, f: FunctionDef, args: list[X]) -> list[X]:
        least = f.least if f.least is not None else len(f.args)
        if not least <= len(args) <= len(f.args):
            raise SqlError(f"{f.name} takes {least}{'' if least == len(f.args) else f' to {len(f.args)}'} arguments, not {len(args)}")
        out = []
        for x, (name, kind) in zip(args, f.args):
            if kind == "DOUBLE" and x.type == "BIGINT":
                x = X("cast", (x,), "DOUBLE")
            if x.type not in (kind, "ANY") and not {x.type, kind} <= {"TEXT", "JSON"}:
                raise SqlError(f"{f.name}: argument {name} is {kind}, not {x.type}")
            out.append(x)
        return out

    # expressions

    def _boolean(self, e, scope: Scope, ctes: dict, where: str) -> X:
        x = self.expr(e, scope, ctes)
        if x.type not in ("BOOLEAN", "ANY"):
            raise SqlError(f"{where} takes a condition, not {x.type}")
        return x

    def expr(self, e, scope: Scope, ctes: dict, aggs: bool = False, aliases: dict | None = None) -> X:
        go = lambda y: self.expr(y, scope, ctes, aggs, aliases)
        if isinstance(e, ast.Lit):
            v = e.value
            return X("lit", (), "ANY" if v is None else "BOOLEAN" if isinstance(v, bool) else "BIGINT" if isinstance(v, int) else "DOUBLE" if isinstance(v, float) else "TEXT", v)
        if isinstance(e, ast.Col):
            if aliases and e.table is None and not any(c.lower() == e.name.lower() for _, c, _ in scope.columns):
                for n, x in aliases.items():
                    if n.lower() == e.name.lower():
                        return x
            return scope.find(e.name, e.table)
        if isinstance(e, ast.Op):
            return self._op(e, [go(a) for a in e.args])
        if isinstance(e, ast.InList):
            x, items = go(e.arg), [go(i) for i in e.items]
            kind = common([x.type, *(i.type for i in items)])
            for i in items:
                if i.type not in ("ANY", x.type) and x.type != "ANY" and not {i.type, x.type} <= set(_NUM):
                    raise SqlError(f"IN compares {x.type} with {i.type}")
            return _not(X("in", (x, *items), "BOOLEAN", kind), e.negated)
        if isinstance(e, (ast.InQuery, ast.Exists, ast.Scalar)):
            plan = self.query(e.query, scope, ctes)
            if isinstance(e, ast.Exists):
                return X("exists", (), "BOOLEAN", plan)
            if len(plan.fields) != 1:
                raise SqlError("a subquery in an expression has one column")
            if isinstance(e, ast.Scalar):
                return X("scalar", (), plan.fields[0][1], plan)
            return _not(X("inquery", (go(e.arg),), "BOOLEAN", plan), e.negated)
        if isinstance(e, ast.Case):
            parts: list[X] = []
            for c, v in e.whens:
                c = go(c)
                if c.type not in ("BOOLEAN", "ANY"):
                    raise SqlError("CASE WHEN takes a condition")
                parts += [c, go(v)]
            other = go(e.other) if e.other is not None else X("lit")
            values = [*parts[1::2], other]
            return X("case", (*parts, other), common([v.type for v in values]))
        if isinstance(e, ast.Cast):
            return X("cast", (go(e.arg),), e.type)
        if isinstance(e, ast.Func):
            return self._func(e, scope, ctes, aggs, aliases)
        raise SqlError("* is for SELECT and COUNT")

    def _op(self, e: ast.Op, a: list[X]) -> X:
        n = e.name
        types = [x.type for x in a]
        if n in ("AND", "OR", "NOT", "IS TRUE", "IS FALSE"):
            if any(t not in ("BOOLEAN", "ANY") for t in types):
                raise SqlError(f"{n} takes conditions, not {', '.join(types)}")
            return X(n, tuple(a), "BOOLEAN")
        if n == "IS NULL":
            return X(n, tuple(a), "BOOLEAN")
        if n in ("=", "<>", "<", "<=", ">", ">="):
            known = {t for t in types if t != "ANY"}
            odd = len(known) == 2 and not known <= set(_NUM) and all(t in ("BOOLEAN", "BIGINT", "DOUBLE", "TEXT", "JSON", "VECTOR") for t in known)
            if odd and n not in ("=", "<>"):
                raise SqlError(f"cannot compare {types[0]} with {types[1]}")
            return X(n, tuple(a), "BOOLEAN", "never" if odd else None)
        if n in ("LIKE", "ILIKE"):
            if any(t not in ("TEXT", "ANY") for t in types):
                raise SqlError(f"{n} takes TEXT, not {', '.join(types)}")
            return X(n, tuple(a), "BOOLEAN")
        if n == "||":
            return X(n, tuple(a), "TEXT")
        if any(t not in (*_NUM, "ANY") for t in types):
            raise SqlError(f"{'-' if n == 'NEG' else n} takes numbers, not {', '.join(types)}")
        kind = "DOUBLE" if n == "/" or "DOUBLE" in types else "BIGINT"
        return X(n, tuple(a), kind)

    def _func(self, e: ast.Func, scope: Scope, ctes: dict, aggs: bool, aliases: dict | None) -> X:
        if e.name in AGGREGATES:
            if not aggs:
                raise SqlError(f"{e.name} is an aggregate; it goes into SELECT, HAVING or ORDER BY")
            args = [self.expr(a, scope, ctes, False, aliases) for a in e.args]
            if e.order and e.name != "string_agg":
                raise SqlError(f"ORDER BY inside {e.name} is not supported")
            if e.star and e.name != "count" or not e.star and len(args) != (2 if e.name == "string_agg" else 1):
                raise SqlError(f"{e.name} takes {'two arguments' if e.name == 'string_agg' else 'one argument'}")
            if any(isinstance(x.val, Plan) for a in args for x in a.walk()):
                raise SqlError("a subquery inside an aggregate is not supported")
            t = args[0].type if args else "BIGINT"
            if e.name in ("sum", "avg") and t not in (*_NUM, "ANY"):
                raise SqlError(f"{e.name} takes numbers, not {t}")
            if e.name in ("bool_and", "bool_or") and t not in ("BOOLEAN", "ANY"):
                raise SqlError(f"{e.name} takes BOOLEAN, not {t}")
            kind = {"count": "BIGINT", "avg": "DOUBLE", "string_agg": "TEXT", "bool_and": "BOOLEAN", "bool_or": "BOOLEAN"}.get(e.name, t)
            order = tuple((self.expr(o.expr, scope, ctes), o.desc, o.nulls_first) for o in e.order)
            return X("agg", tuple(args) + tuple(o[0] for o in order), kind, (e.name, e.distinct, len(args), tuple(o[1:] for o in order)))
        if e.star or e.distinct or e.order:
            raise SqlError(f"{e.name} is not an aggregate")
        args = [self.expr(a, scope, ctes, aggs, aliases) for a in e.args]
        if e.name in BUILTINS:
            b = BUILTINS[e.name]
            if not b.least <= len(args) <= b.most:
                raise SqlError(f"{e.name} takes {b.least}{'' if b.least == b.most else f' to {b.most}'} arguments, not {len(args)}")
            for i, x in enumerate(args):
                want = b.takes[min(i, len(b.takes) - 1)] if b.takes else ""
                if want and x.type != "ANY" and x.type != want and not (want == "DOUBLE" and x.type == "BIGINT") and not (want in ("JSON", "TEXT") and x.type in ("JSON", "TEXT")):
                    raise SqlError(f"{e.name}: argument {i + 1} is {want}, not {x.type}")
            types = [x.type for x in args]
            if not b.takes and e.name in ("greatest", "least", "coalesce") and len({t for t in types if t != "ANY"} - ({"BIGINT"} if "DOUBLE" in types else set())) > 1:
                raise SqlError(f"{e.name} mixes {' and '.join(sorted(set(types)))}")
            return X("fn", tuple(args), b.returns if isinstance(b.returns, str) else b.returns(types), e.name)
        f = self.catalog.functions.get(e.name)
        if f is None:
            raise unknown("function", e.name, [*BUILTINS, *AGGREGATES, *self.catalog.functions])
        if f.is_table:
            raise SqlError(f"{e.name} is a table function; write FROM {e.name}(...) or CROSS JOIN LATERAL {e.name}(...)")
        if f.volatility == "volatile":
            raise SqlError(f"{e.name} is volatile; declare it IMMUTABLE or STABLE to use it in a query")
        args = self._args(f, args)
        if f.form == "sql":
            inner = Scope([(None, n, t) for n, t in f.args])
            if isinstance(f.query, ast.Query):
                if f.args:
                    plan = self.query(f.query, inner, {})
                    return X("scalar", (), plan.fields[0][1], _bind(plan, args)) if len(plan.fields) == 1 else self._one_column()
                plan = self.query(f.query, None, {})
                return X("scalar", (), plan.fields[0][1], plan)
            body = self.expr(f.query, inner, {})
            return X("cast", (rewrite(body, lambda y: args[y.val] if y.op == "col" else None),), f.returns)
        return X("call", tuple(args), f.returns, f)

    def _one_column(self) -> X:
        raise SqlError("a SQL function's query has one column")


def _bind(plan: Plan, args: list[X], depth: int = 1) -> Plan:
    """A SQL function's body with its arguments, which are columns one query further out, put in."""

    def deeper(x: X) -> X:
        return rewrite(x, lambda y: X("outer", (), y.type, (y.val[0] + depth, y.val[1])) if y.op == "outer" else X("outer", (), y.type, (depth, y.val)) if y.op == "col" else None)

    def at(y: X) -> X | None:
        if y.op == "outer" and y.val[0] == depth:
            return deeper(args[y.val[1]])
        if isinstance(y.val, Plan):
            return replace(y, args=tuple(rewrite(a, at) for a in y.args), val=_bind(y.val, args, depth + 1))
        return None

    info = {k: (rewrite(v, at) if isinstance(v, X) else tuple(rewrite(x, at) for x in v) if k in ("exprs", "args", "groups", "aggs") else tuple((rewrite(x, at), *r) for x, *r in v) if k == "keys"
                else tuple(tuple(rewrite(x, at) for x in r) for r in v) if k == "rows" else v) for k, v in plan.info.items()}
    return replace(plan, inputs=tuple(_bind(p, args, depth) for p in plan.inputs), info=info)


def _not(x: X, negated: bool) -> X:
    return X("NOT", (x,), "BOOLEAN") if negated else x


def _renamed_fields(fields, names) -> tuple:
    if len(names) > len(fields):
        raise SqlError(f"{len(names)} column names for {len(fields)} columns")
    return tuple((names[i] if i < len(names) else n, t) for i, (n, t) in enumerate(fields))


def _renamed(plan: Plan, names) -> Plan:
    return replace(plan, fields=_renamed_fields(plan.fields, names)) if names else plan


def _mentions(q, name: str) -> bool:
    """Whether a query's FROM clauses, at any depth, name a table."""
    if isinstance(q, ast.Table):
        return q.name.lower() == name.lower()
    if isinstance(q, (tuple, list)):
        return any(_mentions(x, name) for x in q)
    if hasattr(q, "__dataclass_fields__"):
        return any(_mentions(getattr(q, f), name) for f in q.__dataclass_fields__)
    return False
