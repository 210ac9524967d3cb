"""Registered queries that run over whole tables, against brute force."""

import random

import duckdb
import pytest

from sqlume import queries

DATA = "/root/testdata/sf0.001"


def brute_chunks(text, size, overlap):
    out, at = [], 0
    while text:
        end = at + size
        if end >= len(text):
            return [*out, text[at:]]
        tail = text[end - size // 5 : end]
        end -= len(tail) - tail.rindex("\n") - 1 if "\n" in tail else 0
        out.append(text[at:end])
        at = end - overlap
    return out


def test_chunks_of_documents_with_newlines(spark, tmp_path):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("aßあ \r\n", (40, 5, 5, 10, 1, k), k=n)) for k in (0, 0.1, 1, 9) for n in (1, 499, 500, 501, 950, 4000)]
    texts += [None, "", "\n", "x" * 400 + "\n" + "y" * 700, "x" * 399 + "\n" + "y" * 700, "x" * 499 + "\n" + "y" * 700, "x" * 500 + "\n" + "y" * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["chunks_documents"](spark, str(tmp_path)).collect())
    want = [(i, k, len(c), -(-len(c) // 4)) for i, t in enumerate(texts) for k, c in enumerate(brute_chunks(t, 500, 50))]
    assert got == want and {i for i, *_ in got} == {i for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("name,table", [("order_nulls_all_rows", "part"), ("order_hidden_column_all_rows", "customer"), ("call_in_order_all_rows", "nation")])
def test_all_rows_in_order(spark, name, table):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = [tuple(r) for r in queries.QUERIES[name](spark, DATA).collect()]
    assert got == db.execute(queries.ORACLES[name]).fetchall()
    assert len(got) == db.execute(f"SELECT COUNT(*) FROM {table}").fetchone()[0]


def test_delegation_runs_for_every_nation(spark):
    names = [r.n_name for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["delegation_all_nations"](spark, DATA).collect())
    assert got == sorted((n, f"1 {n}") for n in names) and len(got) == 25
