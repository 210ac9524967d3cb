"""Calls made by executors: the same answers, counted and reserved, known ones not asked again."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle

from sqlume.calls.budget import Budget
from sqlume.calls.providers import Reply
from sqlume.errors import BudgetError
from sqlume.session import Session

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests


class Counting:
    """Answers how long an argument is; can be sent to executors."""

    portable = True

    def complete(self, alias, prompt):
        items = json.loads(prompt[prompt.index("items: ") + 7 :])
        return Reply(json.dumps({"answers": [{"item": i["item"], "answer": len(i["args"]["x"])} for i in items]}), 10, 2, 0.5)


def session(spark, rows=500, **options):
    s = Session(spark, Counting(), **options)
    s.register("t", spark.createDataFrame([(i, f"w{i % 100}" if i % 50 else None) for i in range(rows)], "k long, x string").repartition(5))
    s.sql("CREATE FUNCTION size_of(x TEXT) RETURNS BIGINT AS PROMPT 'How long is {x}?' BATCH 7")
    return s


def test_answers_are_those_of_the_rule_and_calls_are_batched_and_traced(spark):
    s = session(spark)
    got = {r.k: r.n for r in s.sql("SELECT k, size_of(x) AS n FROM t").collect()}
    assert got == {i: len(f"w{i % 100}") if i % 50 else None for i in range(500)}
    calls = s.system("trace_calls").count()
    assert 98 / 7 <= calls <= 98 / 7 + 8 + 1 and s.budget.used_calls == calls and s.budget.used_dollars == 0.5 * calls and s.budget.used_tokens == 12 * calls
    assert {r.k for r in s.sql("SELECT k FROM t WHERE size_of(x) = 2").collect()} == {i for i in range(500) if i % 50 and i % 100 < 10}
    assert s.system("trace_calls").count() == calls  # all were known
    s.register("u", spark.createDataFrame([("w1",), ("other",)], "x string"))
    assert sorted((r.x, r.n) for r in s.sql("SELECT x, size_of(x) AS n FROM u").collect()) == [("other", 5), ("w1", 2)] and s.system("trace_calls").count() == calls + 1


def test_a_budget_is_held_before_any_call(spark):
    with pytest.raises(BudgetError, match=re.compile("budget")):
        session(spark, budget=Budget(calls=3)).sql("SELECT k, size_of(x) AS n FROM t")


def test_no_argument_row_passes_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    s = session(spark)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: 1 / 0)
    assert s.sql("SELECT k, size_of(x) AS n FROM t").count() == 500
