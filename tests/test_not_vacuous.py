"""No registered query is empty, or keeps everything, by accident."""

import duckdb
import pytest

from sqlume import queries, session_queries

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Empty on purpose: groups of no rows, and NOT IN a list that holds a null.
EMPTY = {"group_agg_empty", "not_in_null"}
#: Filters that must keep some rows of a table and drop some.
SPLIT = {"call_in_join": "nation", "semi_join_refute": "nation", "cascade_filter": "part", "prompt_filter": "part", "call_or_pure": "part", "scalar_subquery": "orders", "not_exists_anti": "customer", "exists_semi": "customer", "in_subquery": "part", "grep_of_files": "nation"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted({**queries.ORACLES, **session_queries.ORACLES}))
def test_results_have_rows(db, name):
    n = db.execute(f"SELECT COUNT(*) FROM ({ {**queries.ORACLES, **session_queries.ORACLES}[name] })").fetchone()[0]
    assert (n == 0) == (name in EMPTY)
    if name in SPLIT:
        assert 0 < n < db.execute(f"SELECT COUNT(*) FROM {SPLIT[name]}").fetchone()[0]


def test_truth_values_of_calls_are_both(db):
    for name, column in (("prompt_project_typed", "b"), ("builtin_calls", "b"), ("call_in_left_join", "r_name IS NULL")):
        assert {r[0] for r in db.execute(f"SELECT DISTINCT {column} FROM ({queries.ORACLES[name]})").fetchall()} == {True, False}


def test_every_query_has_sql_but_those_that_cannot():
    missing = {n for n in {**queries.QUERIES, **session_queries.QUERIES} if n not in {**queries.ORACLES, **session_queries.ORACLES}}
    assert missing == {"elo_ratings"}
