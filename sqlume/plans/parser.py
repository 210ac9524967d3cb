"""Recursive-descent parser of the dialect. What the dialect lacks is refused with a hint."""

from __future__ import annotations

from sqlume.errors import SqlError
from sqlume.plans import ast
from sqlume.plans.lexer import Token, tokens

TYPES = {
    **dict.fromkeys("INT INTEGER BIGINT INT64 INT8 INT4 INT2 SMALLINT TINYINT".split(), "BIGINT"),
    **dict.fromkeys("DOUBLE FLOAT FLOAT4 FLOAT8 FLOAT64 REAL".split(), "DOUBLE"),
    **dict.fromkeys("TEXT VARCHAR STRING CHAR CHARACTER".split(), "TEXT"),
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "JSON": "JSON", "VECTOR": "VECTOR",
}
_RESERVED = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS WITH VALUES CASE WHEN THEN ELSE END "
    "AND OR NOT IN IS NULL LIKE ILIKE BETWEEN EXISTS DISTINCT BY LATERAL QUALIFY WINDOW FETCH FOR TRUE FALSE SEMI ANTI ASOF CLUSTER SORT DISTRIBUTE PREWHERE CONNECT TABLESAMPLE PIVOT UNPIVOT".split())


class Parser:
    def __init__(self, sql: str) -> None:
        self.sql, self.toks, self.at = sql, tokens(sql), 0

    # token helpers

    @property
    def tok(self) -> Token:
        return self.toks[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.at + k, len(self.toks) - 1)]

    def take(self) -> Token:
        t = self.tok
        self.at += 1
        return t

    def is_word(self, *words: str) -> bool:
        return self.tok.word in words and bool(self.tok.word)

    def word(self, *words: str) -> bool:
        """Take the words if they come next."""
        if all(self.peek(k).word == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def op(self, *texts: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in texts:
            return self.take().text
        return None

    def need(self, text: str) -> None:
        if not (self.op(text) if not text.isalpha() else self.word(text)):
            raise SqlError(f"expected {text} before {self.tok.text or 'the end'!r}")

    def name(self, what: str = "a name") -> str:
        t = self.tok
        if t.kind == "quoted":
            return str(self.take().value)
        if t.kind == "name" and t.word not in _RESERVED:
            return self.take().text
        raise SqlError(f"expected {what} before {t.text or 'the end'!r}")

    def string(self) -> str:
        if self.tok.kind != "str":
            raise SqlError(f"expected a string before {self.tok.text or 'the end'!r}")
        return str(self.take().value)

    def number(self) -> float:
        sign = -1 if self.op("-") else 1
        if self.tok.kind != "num":
            raise SqlError(f"expected a number before {self.tok.text or 'the end'!r}")
        return sign * float(self.take().text)

    def count(self, what: str) -> int:
        if self.tok.kind != "num" or not self.tok.text.isdigit():
            raise SqlError(f"{what} takes a non-negative integer literal")
        return int(self.take().text)

    def end(self) -> None:
        self.op(";")
        if self.tok.kind != "end":
            raise SqlError(f"unexpected {self.tok.text!r}")

    # statements

    def statement(self):
        s = self._statement()
        self.end()
        return s

    def _statement(self):
        if self.is_word("SELECT", "WITH", "VALUES") or self.tok.text == "(":
            return self.query()
        if self.word("EXPLAIN"):
            analyze = self.word("ANALYZE")
            rest = self.sql[self.tok.at :]
            return ast.Explain(self._statement(), analyze, rest)
        if self.word("FINAL"):
            return self.final()
        if self.word("CREATE"):
            replace = self.word("OR", "REPLACE")
            if self.word("FUNCTION"):
                return self.create_function(replace)
            if self.word("AGENT"):
                return self.create_agent(replace)
            if replace:
                raise SqlError("CREATE OR REPLACE is for FUNCTION and AGENT; drop the table first")
            if self.word("TABLE"):
                return self.create_table()
            raise SqlError(f"CREATE {self.tok.text} is not supported; CREATE TABLE, FUNCTION or AGENT are")
        if self.word("INSERT"):
            return self.insert()
        if self.word("DROP"):
            if not self.word("TABLE"):
                raise SqlError(f"DROP {self.tok.text} is not supported; DROP TABLE is")
            if_exists = self.word("IF", "EXISTS")
            name = self.name("a table")
            if self.tok.text == ",":
                raise SqlError("DROP TABLE takes one table; write one statement for each")
            return ast.Drop(name, if_exists)
        if self.word("SET"):
            key = self.name("a setting")
            while self.op("."):
                key += "." + self.name()
            self.need("=")
            t = self.take()
            value = t.value if t.kind in ("str", "quoted") else float(t.text) if t.kind == "num" else t.text
            if t.kind == "num" and t.text.isdigit():
                value = int(t.text)
            return ast.Set(key.lower(), value)
        if self.word("CALL"):
            tool = self.name("a tool")
            self.need("(")
            args = self.exprs_until(")")
            return ast.CallTool(tool.lower(), args, self.query() if self.word("FROM") else None)
        if self.word("CALIBRATE"):
            name, given = self.name("a function"), {}
            while self.is_word("SAMPLE", "RECALL", "PRECISION"):
                key = self.take().word.lower()
                given[key] = self.count("SAMPLE") if key == "sample" else self.number()
            self.need("FROM")
            return ast.Calibrate(name.lower(), self.query(), **given)
        if self.is_word("UPDATE", "DELETE", "MERGE", "TRUNCATE"):
            raise SqlError(f"{self.tok.word} is not supported: tables are append-only; CREATE TABLE ... AS SELECT a new one")
        raise SqlError(f"unsupported statement {self.tok.text!r}")

    def final(self):
        if self.word("FROM"):
            self.need("(")
            q = self.query()
            self.need(")")
            return ast.Final(q)
        if self.is_word("SELECT", "WITH", "VALUES"):
            return ast.Final(self.query())
        self.need("(")
        if self.is_word("SELECT", "WITH", "VALUES"):
            q = self.query()
            self.need(")")
            return ast.Final(q)
        e = self.expr()
        self.need(")")
        return ast.Final(ast.Query(ast.Select(((e, "answer"),), None)))

    def create_table(self):
        if_not = self.word("IF", "NOT", "EXISTS")
        name = self.name("a table")
        if self.word("AS"):
            return ast.CreateTable(name, (), self.query(), if_not)
        self.need("(")
        cols = []
        while True:
            if self.is_word("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                self._skip_constraint()
            else:
                col, kind, nullable = self.name("a column"), self.type(), True
                while self.tok.text not in (",", ")"):
                    if self.word("NOT", "NULL") or self.word("PRIMARY", "KEY"):
                        nullable = False
                    elif self.tok.text == "(":
                        self._skip_parens()
                    elif self.tok.kind == "end":
                        raise SqlError("a column list is not closed")
                    else:
                        self.take()
                cols.append((col, kind, nullable))
            if not self.op(","):
                break
        self.need(")")
        return ast.CreateTable(name, tuple(cols), None, if_not)

    def _skip_parens(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            t = self.take()
            if t.kind == "end":
                raise SqlError("a bracket is not closed")
            depth += (t.text == "(") - (t.text == ")")

    def _skip_constraint(self) -> None:
        while self.tok.text not in (",", ")") and self.tok.kind != "end":
            self._skip_parens() if self.tok.text == "(" else self.take()

    def insert(self):
        self.need("INTO")
        name, cols = self.name("a table"), ()
        if self.tok.text == "(" and self.peek().word not in ("SELECT", "WITH", "VALUES"):
            self.need("(")
            names = [self.name("a column")]
            while self.op(","):
                names.append(self.name("a column"))
            self.need(")")
            cols = tuple(names)
        return ast.Insert(name, cols, self.query())

    def create_function(self, replace: bool):
        name = self.name("a function").lower()
        self.need("(")
        args = []
        while not self.op(")"):
            args.append((self.name("an argument"), self.type()))
            self.op(",")
        self.need("RETURNS")
        returns, query = self.type(), None
        self.need("AS")
        if self.word("PROMPT"):
            kind, body = "prompt", self.string()
        elif self.word("SHELL"):
            kind, body = "shell", self.string()
        else:
            self.need("SQL")
            self.need("(")
            start = self.tok.at
            query = self.query() if self.is_word("SELECT", "WITH", "VALUES") else self.expr()
            kind, body = "sql", self.sql[start : self.tok.at]
            self.need(")")
        opts: dict = {}
        while self.tok.kind == "name":
            if self.word("MODEL"):
                opts["model"] = self.string()
            elif self.word("BATCH"):
                opts["batch"] = self.count("BATCH")
                if opts["batch"] < 1:
                    raise SqlError("BATCH takes a positive count")
            elif self.is_word("IMMUTABLE", "STABLE", "VOLATILE"):
                opts["volatility"] = self.take().word.lower()
            elif self.word("PROXY"):
                opts["proxy"] = self.name("a scorer").lower()
                if self.word("THRESHOLDS"):
                    self.need("(")
                    low = self.number()
                    self.need(",")
                    opts["thresholds"] = (low, self.number())
                    self.need(")")
            else:
                raise SqlError(f"unexpected {self.tok.text!r} in CREATE FUNCTION")
        if kind != "prompt" and opts.keys() & {"model", "batch", "proxy"}:
            raise SqlError("MODEL, BATCH and PROXY are for prompt functions")
        opts.setdefault("volatility", {"prompt": "immutable", "sql": "stable", "shell": "volatile"}[kind])
        return ast.CreateFunction(name, tuple(args), returns, kind, body, replace=replace, query=query, **opts)

    def create_agent(self, replace: bool):
        name, opts = self.name("an agent").lower(), {}
        while self.tok.kind == "name":
            if self.word("MODEL"):
                opts["model"] = self.string()
            elif self.word("EFFORT"):
                opts["effort"] = self.string()
            elif self.word("TOOLS"):
                self.need("(")
                tools = []
                while not self.op(")"):
                    tools.append(self.name("a tool").lower())
                    self.op(",")
                opts["tools"] = tuple(tools)
            elif self.word("BUDGET"):
                self.need("(")
                parts = []
                while not self.op(")"):
                    parts.append((self.name("a limit").lower(), self.number()))
                    self.op(",")
                opts["budget"] = tuple(parts)
            elif self.word("PROMPT"):
                opts["prompt"] = self.string()
            else:
                raise SqlError(f"unexpected {self.tok.text!r} in CREATE AGENT")
        return ast.CreateAgent(name, replace=replace, **opts)

    def type(self) -> str:
        t = self.take()
        kind = TYPES.get(t.word)
        if kind is None:
            raise SqlError(f"unsupported type {t.text}; BOOLEAN, BIGINT, DOUBLE, TEXT, JSON and VECTOR are")
        self.word("PRECISION") if t.word == "DOUBLE" else self.word("VARYING") if t.word.startswith("CHAR") else None
        if kind == "TEXT" and self.tok.text == "(":
            self._skip_parens()
        return kind

    # queries

    def query(self):
        ctes, recursive = [], False
        if self.word("WITH"):
            recursive = self.word("RECURSIVE")
            while True:
                name, cols = self.name("a name"), ()
                if self.op("("):
                    cols = [self.name("a column")]
                    while self.op(","):
                        cols.append(self.name("a column"))
                    self.need(")")
                self.need("AS")
                self.need("(")
                ctes.append(ast.Cte(name, tuple(cols), self.query()))
                self.need(")")
                if not self.op(","):
                    break
        body = self.set_expr()
        order: tuple = ()
        if self.word("ORDER", "BY"):
            if self.is_word("ALL"):
                raise SqlError("ORDER BY ALL is not supported; name the columns")
            order = self.order_list()
        limit, offset = None, 0
        while self.is_word("LIMIT", "OFFSET"):
            if self.take().word == "LIMIT":
                if self.word("ALL"):
                    continue
                limit = self.count("LIMIT")
                if self.op(","):
                    offset, limit = limit, self.count("LIMIT")
                if self.is_word("BY"):
                    raise SqlError("LIMIT BY is not supported")
            else:
                offset = self.count("OFFSET")
                self.word("ROWS") or self.word("ROW")
        if self.is_word("FETCH", "FOR"):
            raise SqlError(f"{self.tok.word} is not supported; LIMIT is")
        return ast.Query(body, tuple(ctes), recursive, order, limit, offset)

    def order_list(self) -> tuple:
        out = []
        while True:
            e = self.expr()
            desc = self.word("DESC") or (self.word("ASC") and False)
            first = desc
            if self.word("NULLS"):
                first = self.word("FIRST")
                if not first:
                    self.need("LAST")
            out.append(ast.Order(e, desc, first))
            if not self.op(","):
                return tuple(out)

    def set_expr(self):
        left = self.set_term()
        while self.is_word("UNION", "INTERSECT", "EXCEPT"):
            if not self.word("UNION"):
                raise SqlError(f"{self.tok.word} is not supported; use {'IN or EXISTS' if self.tok.word == 'INTERSECT' else 'NOT IN or NOT EXISTS'}")
            all_ = self.word("ALL")
            if not all_:
                self.word("DISTINCT")
            right = self.set_term()
            if isinstance(left, ast.Union) and left.all == all_:
                left = ast.Union((*left.inputs, right), all_)
            else:
                left = ast.Union((left, right), all_)
        return left

    def set_term(self):
        if self.op("("):
            q = self.query()
            self.need(")")
            return q
        if self.word("VALUES"):
            rows = []
            while True:
                self.need("(")
                rows.append(self.exprs_until(")"))
                if not self.op(","):
                    break
            if len({len(r) for r in rows}) > 1:
                raise SqlError("VALUES rows differ in length")
            return ast.Values(tuple(rows))
        if not self.word("SELECT"):
            raise SqlError(f"expected SELECT before {self.tok.text or 'the end'!r}")
        return self.select()

    def select(self):
        distinct = self.word("DISTINCT")
        if distinct and self.is_word("ON"):
            raise SqlError("DISTINCT ON is not supported; GROUP BY with MIN or MAX is")
        if not distinct:
            self.word("ALL")
        if self.is_word("TOP"):
            raise SqlError("TOP is not supported; LIMIT is")
        items = [self.select_item()]
        while self.op(","):
            items.append(self.select_item())
        if self.is_word("INTO"):
            raise SqlError("SELECT INTO is not supported; CREATE TABLE ... AS SELECT is")
        source = self.source() if self.word("FROM") else None
        where = self.expr() if self.word("WHERE") else None
        group: tuple = ()
        if self.word("GROUP", "BY"):
            if self.is_word("ALL", "ROLLUP", "CUBE", "GROUPING"):
                raise SqlError(f"GROUP BY {self.tok.word} is not supported; list the columns, and UNION ALL for totals")
            group = [self.expr()]
            while self.op(","):
                group.append(self.expr())
            group = tuple(group)
            if self.is_word("WITH"):
                raise SqlError("GROUP BY ... WITH ROLLUP is not supported")
        having = self.expr() if self.word("HAVING") else None
        if self.is_word("QUALIFY", "WINDOW", "CLUSTER", "SORT", "DISTRIBUTE", "PREWHERE", "CONNECT"):
            raise SqlError(f"{self.tok.word} is not supported")
        return ast.Select(tuple(items), source, where, group, having, distinct)

    def select_item(self):
        if self.op("*"):
            self._no_exclude()
            return ast.Star(), None
        if self.tok.kind in ("name", "quoted") and self.peek().text == "." and self.peek(2).text == "*":
            table = self.name()
            self.at += 2
            self._no_exclude()
            return ast.Star(table), None
        e = self.expr()
        if self.word("AS"):
            t = self.tok
            return e, (self.take().text if t.kind == "name" else self.name("an alias"))
        if self.tok.kind == "quoted" or self.tok.kind == "name" and self.tok.word not in _RESERVED and self.tok.word not in ("INTO",):
            return e, self.name()
        return e, None

    def _no_exclude(self) -> None:
        if self.is_word("EXCLUDE", "EXCEPT", "REPLACE", "RENAME"):
            raise SqlError(f"SELECT * {self.tok.word} is not supported; list the columns")

    def source(self):
        left = self.joined()
        while self.op(","):
            right = self.joined()
            left = ast.Join("cross", left, right)
        return left

    def joined(self):
        left = self.relation()
        while True:
            if self.is_word("RIGHT", "FULL", "NATURAL", "SEMI", "ANTI", "ASOF"):
                hint = {"RIGHT": "swap the sides and use LEFT JOIN", "FULL": "UNION ALL a LEFT JOIN and the unmatched rows", "NATURAL": "write ON", "SEMI": "use EXISTS", "ANTI": "use NOT EXISTS"}
                raise SqlError(f"{self.tok.word} JOIN is not supported; {hint.get(self.tok.word, 'use a plain JOIN')}")
            if self.word("CROSS", "JOIN"):
                right = self.relation()
                if self.is_word("ON", "USING"):
                    raise SqlError("CROSS JOIN takes no condition; use JOIN ... ON")
                left = ast.Join("cross", left, right)
                continue
            if self.word("LEFT"):
                self.word("OUTER")
                if self.is_word("SEMI", "ANTI"):
                    raise SqlError(f"{self.tok.word} JOIN is not supported; use {'EXISTS' if self.tok.word == 'SEMI' else 'NOT EXISTS'}")
                self.need("JOIN")
                kind = "left"
            elif self.word("INNER", "JOIN") or self.word("JOIN"):
                kind = "inner"
            else:
                return left
            right = self.relation()
            lateral = isinstance(right, ast.TableFunc) and right.lateral
            if lateral:
                if kind == "left":
                    raise SqlError("LEFT JOIN LATERAL is not supported; CROSS JOIN LATERAL is")
                if self.word("ON"):
                    raise SqlError("JOIN LATERAL takes no ON; filter in WHERE")
                left = ast.Join("cross", left, right)
                continue
            if self.is_word("USING"):
                raise SqlError("USING is not supported; write ON a.x = b.x")
            if not self.word("ON"):
                raise SqlError("JOIN needs ON; CROSS JOIN has no condition")
            left = ast.Join(kind, left, right, self.expr())

    def relation(self):
        lateral = self.word("LATERAL")
        if self.op("("):
            if self.is_word("SELECT", "WITH", "VALUES") or self.tok.text == "(":
                save = self.at
                try:
                    q = self.query()
                    self.need(")")
                except SqlError:
                    self.at = save
                else:
                    if lateral:
                        raise SqlError("a LATERAL subquery is not supported; LATERAL takes a table function")
                    alias, cols = self.alias()
                    return ast.Derived(q, alias, cols)
                q = self.query() if self.is_word("SELECT", "WITH", "VALUES") else None
            inner = self.source()
            self.need(")")
            if self.is_word("AS") or self.tok.kind == "name" and self.tok.word not in _RESERVED:
                raise SqlError("a parenthesised join takes no alias")
            return inner
        name = self.name("a table")
        if name.upper() == "UNNEST":
            raise SqlError("UNNEST is not supported")
        while self.op("."):
            name = self.name()
        if self.op("("):
            args = self.exprs_until(")")
            if self.word("WITH", "ORDINALITY"):
                raise SqlError("WITH ORDINALITY is not supported")
            alias, cols = self.alias()
            return ast.TableFunc(name.lower(), args, alias, cols, lateral)
        if lateral:
            raise SqlError("LATERAL takes a table function")
        alias, cols = self.alias()
        if self.is_word("TABLESAMPLE", "PIVOT", "UNPIVOT"):
            raise SqlError(f"{self.tok.word} is not supported")
        return ast.Table(name, alias, cols)

    def alias(self) -> tuple[str | None, tuple]:
        alias = None
        if self.word("AS"):
            alias = self.name("an alias")
        elif self.tok.kind == "quoted" or self.tok.kind == "name" and self.tok.word not in _RESERVED:
            alias = self.name()
        cols: list[str] = []
        if alias is not None and self.op("("):
            cols.append(self.name("a column"))
            while self.op(","):
                cols.append(self.name("a column"))
            self.need(")")
        return alias, tuple(cols)

    # expressions

    def exprs_until(self, close: str) -> tuple:
        out = []
        if self.op(close):
            return ()
        while True:
            out.append(self.expr())
            if self.tok.text in ("=>", ":") or self.tok.text == "=" and self.peek().text == ">":
                raise SqlError("named arguments are not supported; give them by position")
            if not self.op(","):
                break
        self.need(close)
        return tuple(out)

    def expr(self):
        left = self.and_()
        while self.word("OR"):
            left = ast.Op("OR", (left, self.and_()))
        return left

    def and_(self):
        left = self.not_()
        while self.word("AND"):
            left = ast.Op("AND", (left, self.not_()))
        return left

    def not_(self):
        if self.word("NOT"):
            return ast.Op("NOT", (self.not_(),))
        return self.comparison()

    def comparison(self):
        left = self.concat()
        while True:
            if op := self.op("=", "<>", "!=", "<", "<=", ">", ">="):
                if self.is_word("ANY", "ALL", "SOME"):
                    raise SqlError(f"{self.tok.word} is not supported; use IN or EXISTS")
                left = ast.Op("<>" if op == "!=" else op, (left, self.concat()))
                continue
            if self.word("IS"):
                neg = self.word("NOT")
                if self.word("NULL"):
                    e = ast.Op("IS NULL", (left,))
                elif self.is_word("TRUE", "FALSE"):
                    e = ast.Op(f"IS {self.take().word}", (left,))
                else:
                    raise SqlError("IS takes NULL, TRUE or FALSE")
                left = ast.Op("NOT", (e,)) if neg else e
                continue
            neg = self.is_word("NOT") and self.peek().word in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR")
            if neg:
                self.take()
            if self.word("BETWEEN"):
                self.word("SYMMETRIC")
                lo = self.concat()
                self.need("AND")
                hi = self.concat()
                e = ast.Op("AND", (ast.Op(">=", (left, lo)), ast.Op("<=", (left, hi))))
                left = ast.Op("NOT", (e,)) if neg else e
            elif self.word("IN"):
                self.need("(")
                if self.is_word("SELECT", "WITH", "VALUES"):
                    q = self.query()
                    self.need(")")
                    left = ast.InQuery(left, q, neg)
                else:
                    left = ast.InList(left, self.exprs_until(")"), neg)
            elif self.is_word("LIKE", "ILIKE"):
                word = self.take().word
                if self.is_word("ANY", "ALL", "SOME"):
                    raise SqlError(f"{word} {self.tok.word} is not supported; OR the patterns")
                e = ast.Op(word, (left, self.concat()))
                if self.is_word("ESCAPE"):
                    raise SqlError("LIKE ... ESCAPE is not supported: patterns have no escape character")
                left = ast.Op("NOT", (e,)) if neg else e
            elif neg or self.is_word("SIMILAR"):
                raise SqlError("SIMILAR TO is not supported; LIKE is")
            else:
                return left

    def concat(self):
        left = self.additive()
        while True:
            if self.op("||"):
                left = ast.Op("||", (left, self.additive()))
            elif self.tok.text in ("->", "->>"):
                raise SqlError(f"{self.tok.text} is not supported; json_extract and json_extract_string are")
            else:
                return left

    def additive(self):
        left = self.term()
        while op := self.op("+", "-"):
            left = ast.Op(op, (left, self.term()))
        return left

    def term(self):
        left = self.unary()
        while op := self.op("*", "/", "%"):
            left = ast.Op(op, (left, self.unary()))
        return left

    def unary(self):
        if self.op("-"):
            if self.tok.kind == "num" and self.peek().text != "::":
                e = self.primary()
                return ast.Lit(-e.value) if isinstance(e, ast.Lit) else ast.Op("NEG", (e,))
            return ast.Op("NEG", (self.unary(),))
        if self.op("+"):
            return self.unary()
        e = self.primary()
        while self.op("::"):
            e = ast.Cast(e, self.type())
        return e

    def primary(self):
        t = self.tok
        if t.kind == "num":
            self.take()
            if t.text.isdigit():
                n = int(t.text)
                return ast.Lit(n if n < 1 << 63 else float(n))
            return ast.Lit(float(t.text))
        if t.kind == "str":
            self.take()
            return ast.Lit(t.value)
        if self.op("("):
            if self.is_word("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.need(")")
                return ast.Scalar(q)
            e = self.expr()
            if self.tok.text == ",":
                raise SqlError("row values are not supported")
            self.need(")")
            return e
        if t.kind == "name":
            if (w := t.word) in ("NULL", "TRUE", "FALSE"):
                self.take()
                return ast.Lit({"NULL": None, "TRUE": True, "FALSE": False}[w])
            if w == "CASE":
                return self.case()
            if w == "EXISTS" and self.peek().text == "(":
                self.take()
                self.need("(")
                q = self.query()
                self.need(")")
                return ast.Exists(q)
            if w in ("CAST", "TRY_CAST", "TRIM", "SUBSTRING", "SUBSTR", "CEIL", "CEILING", "FLOOR", "POSITION", "EXTRACT") and self.peek().text == "(":
                return self.keyword_call(w)
            if w in ("DATE", "TIME", "TIMESTAMP", "INTERVAL") and self.peek().kind == "str":
                raise SqlError(f"{w} literals are not supported")
            if w == "ARRAY" and self.peek().text == "[":
                raise SqlError("ARRAY is not supported")
        if t.kind not in ("name", "quoted") or t.word in _RESERVED and not (t.word in ("LEFT", "RIGHT") and self.peek().text == "("):
            raise SqlError(f"unexpected {t.text or 'end'!r}")
        self.take()
        name = str(t.value) if t.kind == "quoted" else t.text
        if self.op("("):
            return self.function(name.lower())
        if self.op("."):
            return ast.Col(self.name("a column"), name)
        return ast.Col(name)

    def function(self, name: str):
        if self.op("*"):
            self.need(")")
            out = ast.Func(name, (), star=True)
        elif self.op(")"):
            out = ast.Func(name, ())
        else:
            distinct = self.word("DISTINCT")
            if not distinct:
                self.word("ALL")
            args = [self.expr()]
            while self.op(","):
                args.append(self.expr())
            order = self.order_list() if self.word("ORDER", "BY") else ()
            self.need(")")
            out = ast.Func(name, tuple(args), distinct, order)
        if self.is_word("OVER"):
            raise SqlError("window functions are not supported")
        if self.is_word("FILTER") and self.peek().text == "(":
            raise SqlError("FILTER is not supported; aggregate a CASE")
        if self.is_word("WITHIN"):
            raise SqlError("WITHIN GROUP is not supported; write ORDER BY inside string_agg")
        if self.is_word("IGNORE", "RESPECT") and self.peek().word == "NULLS":
            raise SqlError("IGNORE NULLS is not supported")
        return out

    def case(self):
        self.take()
        operand = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.word("WHEN"):
            c = self.expr()
            self.need("THEN")
            whens.append((ast.Op("=", (operand, c)) if operand is not None else c, self.expr()))
        if not whens:
            raise SqlError("CASE needs WHEN")
        other = self.expr() if self.word("ELSE") else None
        self.need("END")
        return ast.Case(tuple(whens), other)

    def keyword_call(self, w: str):
        self.take()
        self.need("(")
        if w == "TRY_CAST":
            raise SqlError("TRY_CAST is not supported; CAST is")
        if w in ("POSITION", "EXTRACT"):
            raise SqlError(f"{w} is not supported" + ("; strpos is" if w == "POSITION" else ""))
        if w == "CAST":
            e = self.expr()
            self.need("AS")
            kind = self.type()
            self.need(")")
            return ast.Cast(e, kind)
        if w == "TRIM":
            side = self.take().word if self.is_word("LEADING", "TRAILING", "BOTH") else "BOTH"
            self.word("FROM")
            e = self.expr()
            if self.tok.text == "," or self.is_word("FROM"):
                raise SqlError("TRIM with characters is not supported")
            self.need(")")
            return ast.Func({"LEADING": "ltrim", "TRAILING": "rtrim", "BOTH": "trim"}[side], (e,))
        if w in ("SUBSTRING", "SUBSTR"):
            args = [self.expr()]
            if self.word("FROM"):
                args.append(self.expr())
                if self.word("FOR"):
                    args.append(self.expr())
            elif self.word("FOR"):
                args += [ast.Lit(1), self.expr()]
            else:
                while self.op(","):
                    args.append(self.expr())
            self.need(")")
            return ast.Func("substr", tuple(args))
        args = self.exprs_until(")")
        return ast.Func({"CEILING": "ceil"}.get(w, w.lower()), args)


def parse(sql: str):
    """The syntax tree of one statement."""
    return Parser(sql).statement()
