"""Ratings of long sequences of attempts: those of a plain fold, with no task that takes a pack's attempts row by row."""

import random

from sqlume import evals


def brute(rows):
    """rows: (pack, seq, solver, task, solved), in any order; ties by solver, task and outcome, nulls first, but for a null seq."""
    first = lambda v: (v is not None, v if v is not None else 0)
    out = {}
    for pack, _, s, t, ok in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, *((v is not None, v or "") for v in r[2:4]), first(r[4]))):
        a, b = out.setdefault((pack, "solver", s), [1500.0, 0]), out.setdefault((pack, "task", t), [1500.0, 0])
        gap = float(bool(ok)) - 1 / (1 + 10 ** ((b[0] - a[0]) / 400))
        ka, kb = evals.step(a[1]), evals.step(b[1])
        a[0], b[0], a[1], b[1] = a[0] + ka * gap, b[0] - kb * gap, a[1] + 1, b[1] + 1
    return {(*k, *v) for k, v in out.items()}


SCHEMA = "pack string, seq long, solver string, task string, solved boolean"


def test_ratings_are_those_of_a_plain_fold(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["big", "big", "big", "small", None]), None if rnd.random() < 0.001 else rnd.randrange(20_000), rnd.choice(["a", "b", "ä", "", None]), rnd.choice([*map(str, range(50)), None]), rnd.choice([True, False, None])) for _ in range(40_000)]
    rows += [(f"p{i}", i, "one", "only", True) for i in range(200)]
    got = evals.ratings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len({tuple(r)[:3] for r in got})
    assert evals.ratings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_without_packs_and_with_columns_of_other_names(spark):
    rows = [(i, i % 3, f"t{i % 5}", i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, "n long, who long, what string, won long")
    got = {tuple(r) for r in evals.ratings(df, "who", "what", "n", "won").collect()}
    assert got == brute([("", n, str(s), t, bool(ok)) for n, s, t, ok in rows])


def test_no_task_reads_a_large_part_of_a_packs_attempts(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id AS seq", "concat('s', id % 3) AS solver", "concat('t', id % 7) AS task", "id % 2 = 0 AS solved").repartition(8)
    spark.sparkContext.setJobGroup("ratings", "")
    assert evals.ratings(df).count() == 10
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup("ratings"):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            reads = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]
            most = max([most, *reads])
    assert 0 < most < n / 3
