"""Generated queries over generated tables, against DuckDB."""

import math

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sqlume.session import Session

INTS, DOUBLES = st.one_of(st.none(), st.integers(-100, 100)), st.one_of(st.none(), st.integers(-1000, 1000).map(lambda n: n / 4))
TEXTS, BOOLS = st.one_of(st.none(), st.sampled_from(["", "a", "b", "ab", "Ab", "%", "x_y", "ß", "zz", " a"])), st.one_of(st.none(), st.booleans())
ROWS = st.lists(st.tuples(INTS, DOUBLES, TEXTS, BOOLS), max_size=12)


@st.composite
def number(draw, t, depth=2):
    if depth == 0 or draw(st.booleans()):
        return draw(st.sampled_from([f"{t}.c0", f"{t}.c1", "3", "-2.5", "0"]))
    a, b = draw(number(t, depth - 1)), draw(number(t, depth - 1))
    return draw(st.sampled_from([f"({a} + {b})", f"({a} - {b})", f"({a} * {b})", f"COALESCE({a}, {b})", f"ABS({a})", f"CASE WHEN {a} > {b} THEN {a} ELSE {b} END", f"LENGTH({t}.c2)"]))


@st.composite
def predicate(draw, t, depth=2):
    if depth and draw(st.booleans()):
        a, b = draw(predicate(t, depth - 1)), draw(predicate(t, depth - 1))
        return draw(st.sampled_from([f"({a} AND {b})", f"({a} OR {b})", f"(NOT {a})"]))
    a, b = draw(number(t)), draw(number(t))
    return draw(st.sampled_from([f"({a} {op} {b})" for op in ("=", "<>", "<", ">=")] + [f"{t}.c3", f"({t}.c2 IS NULL)", f"({t}.c2 LIKE '%a%')", f"({t}.c2 ILIKE 'A_')", f"({a} BETWEEN -5 AND 50)", f"({t}.c0 IN (1, 2, NULL))", f"({t}.c3 IS TRUE)", f"(({a} > {b}) IS NOT FALSE)"]))


@st.composite
def query(draw):
    p, q, n = draw(predicate("t0")), draw(predicate("t1")), draw(number("t0"))
    return draw(st.sampled_from([
        f"SELECT t0.c0 AS a, {n} AS b, {p} AS c FROM t0", f"SELECT DISTINCT t0.c2 AS a, t0.c3 AS b FROM t0 WHERE {p}", f"SELECT t0.c0 AS a, t1.c2 AS b FROM t0 JOIN t1 ON t0.c0 = t1.c0 AND {q}",
        f"SELECT t0.c2 AS a, t1.c1 AS b FROM t0 LEFT JOIN t1 ON t0.c2 = t1.c2 AND {q} WHERE {p}", f"SELECT t0.c3 AS a, COUNT(*) AS b, MIN({n}) AS c, MAX(t0.c2) AS d, COUNT(DISTINCT t0.c0) AS e FROM t0 WHERE {p} GROUP BY t0.c3 HAVING COUNT(*) > 1",
        "SELECT t0.c0 AS a FROM t0 UNION SELECT t1.c0 FROM t1", f"SELECT t0.c0 AS a FROM t0 WHERE EXISTS (SELECT 1 FROM t1 WHERE t1.c0 = t0.c0 AND {q})", f"SELECT t0.c1 AS a FROM t0 WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.c2 = t0.c2 AND {q})",
        f"SELECT t0.c0 AS a FROM t0 WHERE t0.c0 NOT IN (SELECT t1.c0 FROM t1 WHERE {q})", f"SELECT t0.c0 AS a, (SELECT MAX(t1.c1) FROM t1 WHERE t1.c0 = t0.c0) AS b FROM t0 WHERE {p}", f"WITH w AS (SELECT t0.c0, t0.c1, t0.c2, t0.c3 FROM t0 WHERE {p}) SELECT t1.c0 AS a, w.c2 AS b FROM t1 CROSS JOIN w",
    ]))


def plain(rows):
    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        return "nan" if math.isnan(v) else f"{float(v):.9g}"

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def sides(spark):
    return Session(spark), duckdb.connect()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture, HealthCheck.data_too_large], derandomize=True)
@given(ROWS, ROWS, query())
def test_same_rows(sides, left, right, sql):
    ours, theirs = sides
    for name, rows in (("t0", left), ("t1", right)):
        ours.register(name, ours.spark.createDataFrame(rows, "c0 long, c1 double, c2 string, c3 boolean"))
        theirs.execute(f"CREATE OR REPLACE TABLE {name} (c0 BIGINT, c1 DOUBLE, c2 VARCHAR, c3 BOOLEAN)")
        if rows:
            theirs.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
    assert plain(ours.sql(sql).collect()) == plain(theirs.execute(sql).fetchall())
