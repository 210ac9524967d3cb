"""Model calls: how many are made, and what comes back."""

import json
import re

import pytest

from sqlume.algebra import calibrate
from sqlume.calls.budget import Budget
from sqlume.calls.providers import Recording, Replay, Router, Ruled, Scripted
from sqlume.errors import BudgetError, SqlError
from sqlume.operators import calls as ops
from sqlume.session import Session

RULES = {
    "relevant": lambda a: int(a["t"].split()[1]) % 4 == 0, "supports": lambda a: a["a"].split()[1] == a["b"].split()[1], "relevance_score": lambda a: (0.9, 0.1, 0.5, 0.1)[int(a["t"].split()[1]) % 4],
    "proxy10": lambda a: int(a["x"].split()[1]) / 10, "oracle10": lambda a: int(a["x"].split()[1]) >= 4 and a["x"] != "row 7", "bad": lambda a: "?",
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def demo(spark):
    def make(n=20, batch="BATCH 1", proxy=""):
        s = Session(spark, Ruled(RULES))
        s.register("papers", spark.createDataFrame([(i, f"paper {i}") for i in range(n)], "id long, title string"))
        s.register("claims", spark.createDataFrame([(i, i, f"claim {i}") for i in range(n)], "id long, paper_id long, text string"))
        s.register("evidence", spark.createDataFrame([(i, f"snippet {i}") for i in range(n)], "claim_id long, snippet string"))
        s.sql(f"CREATE FUNCTION relevance_score(t TEXT) RETURNS DOUBLE AS PROMPT '{{t}}' MODEL 'proxy' {batch}; CREATE FUNCTION relevant(t TEXT) RETURNS BOOLEAN AS PROMPT '{{t}}?' {batch} {proxy}; "
              f"CREATE FUNCTION supports(a TEXT, b TEXT) RETURNS BOOLEAN AS PROMPT '{{a}} {{b}}' {batch}")
        return s

    return make


def planned(s, sql):
    from sqlume.algebra import cost
    from sqlume.plans.parser import parse

    plan = s.plan(parse(sql))
    new, report = s.optimized(plan)
    return cost.total(plan, s.catalog, s.cost_model()).calls, cost.total(new, s.catalog, s.cost_model()).calls, report


THREE = "SELECT p.title, c.text, e.snippet FROM papers p, claims c, evidence e WHERE supports(c.text, e.snippet) AND relevant(p.title) AND p.id = c.paper_id AND c.id = e.claim_id"


def test_join_order_needs_far_fewer_calls(demo):
    s = demo()
    before, after, report = planned(s, THREE)
    assert before >= 10 * after and "join-order" in report.applied and report.orders == 12 and report.relations == 3
    got = rows(s.sql(THREE))
    assert got == [(f"paper {i}", f"claim {i}", f"snippet {i}") for i in (0, 12, 16, 4, 8)] and s.caller.provider.calls <= 20 + 20


def test_join_order_prices_splits_of_subsets(demo):
    s = demo()
    rels = ", ".join(f"papers p{i}" for i in range(1, 8))
    chain = " AND ".join(f"p{i}.id = p{i + 1}.id" for i in range(1, 7))
    _, _, report = planned(s, f"SELECT p1.title FROM {rels} WHERE {chain} AND relevant(p1.title) AND supports(p3.title, p7.title)")
    assert report.relations == 7 and report.orders == 665_280 and 100 <= report.priced + report.pruned <= 1_932


def test_cascade_asks_only_in_the_band(demo):
    s = demo(100, proxy="PROXY relevance_score THRESHOLDS (0.2, 0.8)")
    _, after, report = planned(s, "SELECT title FROM papers WHERE relevant(title)")
    assert after == pytest.approx(160) and report.applied == ["cascade"]
    s = demo(20, proxy="PROXY relevance_score THRESHOLDS (0.2, 0.8)")
    got = rows(s.sql("SELECT title FROM papers WHERE relevant(title)"))
    assert s.caller.provider.calls == 25 and got == sorted((f"paper {i}",) for i in (0, 4, 8, 12, 16))


def test_beam_costs_its_frontier(spark):
    from sqlume.algebra import cost
    from sqlume.plans.parser import parse

    s = Session(spark)
    s.register("possibilities", spark.createDataFrame([(str(i),) for i in range(10)], "candidate string"))
    sql = "WITH RECURSIVE f(h, d) AS (SELECT candidate, 0 FROM possibilities UNION ALL SELECT e.item, f.d + 1 FROM f CROSS JOIN LATERAL expand(f.h, 4) AS e WHERE f.d < 3{}) SELECT h FROM f"
    m = s.cost_model()
    m.branching, m.recursion_rounds = 4.0, 3.0
    assert cost.total(s.plan(parse(sql.format(" ORDER BY e.item LIMIT 5"))), s.catalog, m).calls == 20
    m.recursion_rounds = 4.0
    assert cost.total(s.plan(parse(sql.format(""))), s.catalog, m).calls > 100


def test_batches_distinct_and_null(spark):
    class Batch(Ruled):
        pass

    s = Session(spark, Batch({"f": lambda a: a["n"].upper()}), concurrency=1)
    s.register("items", spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "id long, name string"))
    s.sql("CREATE FUNCTION f(n TEXT) RETURNS TEXT AS PROMPT '{n}' BATCH 2")
    assert rows(s.sql("SELECT id, f(name) FROM items")) == [(1, "A"), (2, "B"), (3, "A"), (4, None), (5, "C")]
    assert s.caller.provider.calls == 2  # three distinct values that are not null
    s.sql("SELECT f(name) FROM items").collect()
    assert sum(not c["memo"] for c in s.calls) == 2 and sum(c["memo"] for c in s.calls) == 2


def test_missing_answers_are_asked_again_then_singly(spark):
    def reply(prompt):
        items = json.loads(prompt[prompt.index("items: ") + 7:])
        return json.dumps({"answers": [{"item": i["item"], "answer": len(i["args"]["n"])} for i in items if len(items) == 1 or i["args"]["n"] != "bb"]})

    s = Session(spark, Scripted(default=reply), concurrency=1)
    s.register("t", spark.createDataFrame([("a",), ("bb",), ("ccc",)], "n string"))
    s.sql("CREATE FUNCTION size(n TEXT) RETURNS BIGINT AS PROMPT '{n}'")
    assert rows(s.sql("SELECT n, size(n) FROM t")) == [("a", 1), ("bb", 2), ("ccc", 3)]
    assert s.caller.provider.calls == 2


def test_calls_only_where_needed(demo):
    s = demo()
    s.sql("SELECT CASE WHEN id < 3 THEN relevant(title) ELSE false END AS r FROM papers").collect()
    assert s.caller.provider.calls == 3
    s = demo()
    assert len(s.sql("SELECT id FROM papers WHERE id < 15 OR relevant(title)").collect()) == 16 and s.caller.provider.calls == 5
    s = demo()
    assert len(s.sql("SELECT id FROM papers WHERE relevant(title) AND id < 6").collect()) == 2 and s.caller.provider.calls == 6


def test_semi_and_anti_join_stop_early(demo):
    s = demo()
    got = s.sql("SELECT id FROM papers p WHERE p.id < 5 AND EXISTS (SELECT 1 FROM claims c WHERE supports(c.text, p.title))").collect()
    assert len(got) == 5
    _, _, report = planned(s, "SELECT id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE supports(c.text, p.title))")
    assert "semi-join" in report.applied and s.caller.provider.calls < 5 * 20 + 1


def test_budget_is_reserved_and_gates(demo):
    s = demo()
    s.sql("SET budget.calls = 5")
    with pytest.raises(BudgetError):
        s.sql("SELECT id FROM papers WHERE relevant(title)").collect()
    assert s.caller.provider.calls == 0
    with pytest.raises(BudgetError):
        Budget(calls=1).reserve(2)
    child = Budget(calls=10, depth=2).slice().narrowed({"calls": 3})
    assert child.calls == 3 and child.depth == 1


def test_calibration(spark):
    pick = calibrate.thresholds([(n / 10, n >= 4 and n != 7) for n in range(1, 11)])
    assert (pick.low, pick.high) == (0.4, 0.8)
    s = Session(spark, Ruled(RULES))
    s.register("t", spark.createDataFrame([(f"row {i}",) for i in range(1, 11)], "x string").coalesce(1))
    s.sql("CREATE FUNCTION proxy10(x TEXT) RETURNS DOUBLE AS PROMPT '{x}' MODEL 'proxy'; CREATE FUNCTION oracle10(x TEXT) RETURNS BOOLEAN AS PROMPT '{x}?' PROXY proxy10")
    got = s.sql("CALIBRATE oracle10 SAMPLE 10 FROM SELECT x FROM t").first()
    assert (got.low, got.high) == (0.4, 0.8) and s.catalog.proxies["oracle10"].high == 0.8


def test_builtins_expand_and_delegation(spark):
    def runner(child, role, task):
        return f"{child.depth}:{task}", {"turns": 1}

    s = Session(spark, Scripted([("list", '["x", "y", "z"]'), ("true?", '{"answer": true}'), ("obj", '```json\n{"a": 1}\n```')], "plain"), runner=runner)
    assert rows(s.sql("SELECT llm('hi'), llm_bool('true?'), llm_json('obj', '{\"a\": \"number\"}')")) == [("plain", True, '{"a":1}')]
    s.sql("CREATE TABLE q AS SELECT 'list them' AS h")
    assert rows(s.sql("SELECT e.item FROM q CROSS JOIN LATERAL expand(q.h, 2) AS e")) == [("x",), ("y",)]
    assert rows(s.sql("SELECT r.answer, r.detail FROM q CROSS JOIN LATERAL rlm(q.h) r")) == [("1:list them", '{"turns": 1}')]
    s.sql("CREATE AGENT scout MODEL 'worker' TOOLS (files) BUDGET (calls 4) PROMPT 'look'")
    handle = s.sql("SELECT handle FROM spawn_async('scout', 'go') a").first()[0]
    assert s.sql(f"SELECT answer FROM await('{handle}') a").first()[0] == "1:go"
    with pytest.raises(SqlError, match="FINAL"):
        s.sql("FINAL SELECT answer FROM rlm('x') r")


def test_providers_and_parsing():
    tape = Recording(Scripted(default="a"))
    tape.complete("worker", "p")
    assert Replay(tape.tape).complete("worker", "p").text == "a"

    class Down:
        def complete(self, alias, prompt):
            raise OSError

    assert Router({"worker": [Down(), Scripted(default="b")]}).complete("judge", "p").text == "b"
    assert ops.parse_items("- a\n2) b\n* c", 2) == ["a", "b"] and ops.parse_items('{"n": 1, "items": ["x"]}', 5) == ["x"]
    assert ops.parse_bool("Yes, it is") and not ops.parse_bool('{"answer": false}')
    with pytest.raises(ValueError):
        ops.coerce("3.5", "BIGINT")


def test_functions_are_checked(spark):
    s = Session(spark)
    for bad, why in (("CREATE FUNCTION f(a TEXT) RETURNS TEXT AS PROMPT '{b}'", "placeholder"), ("CREATE FUNCTION upper(a TEXT) RETURNS TEXT AS PROMPT '{a}'", "built in"), ("CREATE FUNCTION f(a TEXT) RETURNS VECTOR AS PROMPT '{a}'", "VECTOR")):
        with pytest.raises(SqlError, match=re.escape(why)):
            s.sql(bad)
    s.sql("CREATE FUNCTION v(a TEXT) RETURNS TEXT AS PROMPT '{a}' VOLATILE")
    with pytest.raises(SqlError, match="volatile"):
        s.sql("SELECT v('x')")
    s.sql("CREATE FUNCTION twice(n BIGINT) RETURNS BIGINT AS SQL (n * 2); CREATE FUNCTION biggest() RETURNS BIGINT AS SQL (SELECT MAX(x) FROM (VALUES (1), (5)) v(x))")
    assert rows(s.sql("SELECT twice(4), biggest()")) == [(8, 5)]
