"""Answers judged, runs reported: oracles, ratings, solve rates, learning curves and cost frontiers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.operators.ranks import ranked, rolling


# oracles


def exact(answer: DataFrame, expected: DataFrame) -> bool:
    """Equal as bags of rows, whatever the column names; numbers compare as numbers."""
    if len(answer.columns) != len(expected.columns):
        return False

    def plain(df: DataFrame) -> DataFrame:
        numeric = {"int", "bigint", "smallint", "tinyint", "float", "double"}
        return df.select(*[(F.col(f"`{c}`").cast("double") if t in numeric or t.startswith("decimal") else F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])

    a, b = plain(answer), plain(expected)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def number(answer: object, expected: float, tolerance: float = 0.0) -> bool:
    try:
        return abs(float(str(answer).replace(",", "")) - expected) <= tolerance + 1e-9
    except ValueError:
        return False


def satisfies(clauses: Iterable[Iterable[int]], assignment: dict[int, bool]) -> bool:
    """Whether every clause (of signed variables) holds."""
    return all(any(assignment.get(abs(v), False) == (v > 0) for v in c) for c in clauses)


def counting(answer: float, expected: float) -> float:
    """Credit for a count: 0.75 to the power of its error."""
    return 0.75 ** abs(answer - expected)


def covers(answer: str, terms: Iterable[str], share: float = 0.5) -> bool:
    """Whether an answer holds at least this share of the expected terms."""
    terms = [t.lower() for t in terms]
    return not terms or sum(t in answer.lower() for t in terms) / len(terms) >= share


# ratings


#: Attempts after which a rating moves by no more than this.
SETTLED, LEAST = 30, 16.0


def step(attempts: int) -> float:
    """How far a rating moves: less with each stage of attempts."""
    return 48.0 if attempts < 10 else 32.0 if attempts < SETTLED else LEAST


def expected(solver: float, task: float) -> float:
    return 1 / (1 + 10 ** ((task - solver) / 400))


def ratings(attempts: DataFrame, solver: str = "solver", task: str = "task", order: str = "seq", solved: str = "solved", start: float = 1500.0) -> DataFrame:
    """Ratings (kind, name, rating, attempts) after a sequence of attempts in which solver and task meet.

    A rating depends on all before it, so the fold is sequential; independent streams are kept apart by the column
    ``pack``, where there is one, and folded side by side. The attempts are sorted over many tasks (ties by solver, task
    and outcome) and packed into compressed blocks; the task that folds a pack sorts and reads blocks only, and holds
    the ratings.
    """
    if "pack" not in attempts.columns:
        attempts = attempts.withColumn("pack", F.lit(""))
    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("pack"), F.col(order).asc_nulls_last(), F.col(solver), F.col(task), F.col(solved)]
    dealt = attempts.select("pack", order, solver, task, solved).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(
        "pack", F.spark_partition_id().alias("part"), F.col(solver).cast("string").alias("solver"), F.col(task).cast("string").alias("task"), F.coalesce(F.col(solved).cast("boolean"), F.lit(False)).alias("solved"))
    blocks = dealt.selectExpr("CAST(pack AS STRING) AS pack", "part", "solver", "task", "solved").mapInArrow(_blocks, "pack string, part int, at long, attempts binary")
    return blocks.repartition(n, "pack").sortWithinPartitions("pack", "part", "at").mapInArrow(_folds(start), "pack string, kind string, name string, rating double, attempts long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a pack's attempts (pack, part, solver, task, solved), in order, as compressed blocks: a row for each (pack, part, at, attempts)."""
    at = 0
    for b in batches:
        ends = pc.run_end_encode(b["pack"]).run_ends.to_pylist() if b.num_rows else []
        rows = []
        for i, j in zip([0, *ends], ends):
            run = pa.RecordBatch.from_arrays([b["solver"].slice(i, j - i).dictionary_encode("encode"), b["task"].slice(i, j - i).dictionary_encode("encode"), b["solved"].slice(i, j - i)], ["solver", "task", "solved"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(run)
            rows.append((b["pack"][i].as_py(), b["part"][i].as_py(), at, out.getvalue().to_pybytes()))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["pack", "part", "at", "attempts"])


def _folds(start: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ratings of each pack from its blocks in order."""

    def ended(pack: str | None, rated: tuple[dict, dict]) -> Iterator[pa.RecordBatch]:
        rows = [(pack, kind, name, *v) for kind, of in zip(("solver", "task"), rated) for name, v in sorted(of.items(), key=lambda x: (x[0] is not None, x[0] or ""))]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))], ["pack", "kind", "name", "rating", "attempts"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, rated = None, ({}, {})
        for batch in batches:
            for now, block in zip(batch["pack"], batch["attempts"]):
                now = now.as_py()
                if now != pack:
                    yield from ended(pack, rated)
                    pack, rated = now, ({}, {})
                *named, solved = pa.ipc.open_stream(block.as_buffer()).read_next_batch().columns
                held = [[of.setdefault(name, [start, 0]) for name in c.dictionary.to_pylist()] for of, c in zip(rated, named)]
                won = solved.cast(pa.int8()).to_numpy().tolist()
                for a, b, ok in zip(*(map(h.__getitem__, c.indices.to_numpy().tolist()) for h, c in zip(held, named)), won):
                    x, i = a
                    y, j = b
                    gap = ok - 1 / (1 + 10 ** ((y - x) / 400))  # expected(), without a call for each attempt
                    a[0] = x + (LEAST if i >= SETTLED else step(i)) * gap
                    b[0] = y - (LEAST if j >= SETTLED else step(j)) * gap
                    a[1] = i + 1
                    b[1] = j + 1
        yield from ended(pack, rated)

    return fold


def pick(tasks: DataFrame, solver_rating: float) -> DataFrame:
    """The curriculum's next task: the one whose chance of being solved is nearest to a half; ties by name."""
    p = 1 / (1 + F.pow(F.lit(10.0), (F.col("rating") - F.lit(solver_rating)) / 400))
    return tasks.where("kind = 'task'").withColumn("p", p).orderBy(F.abs(F.col("p") - 0.5), "name").limit(1)


def dial(level: int, rate: float) -> int:
    """Difficulty of generated tasks: up where most are solved, down where few are."""
    return level + 1 if rate > 0.7 else max(1, level - 1) if rate < 0.3 else level


# reports over evals(run, pack, mode, seq, task, solved, calls, tokens, dollars, wall_ms)


def report(evals: DataFrame) -> DataFrame:
    """Accuracy, calls, tokens, dollars and seconds per task, by pack and mode."""
    return evals.groupBy("pack", "mode").agg(
        F.count("*").alias("tasks"), F.sum(F.col("solved").cast("long")).alias("solved"), F.avg(F.col("solved").cast("double")).alias("accuracy"), F.avg("calls").alias("calls_per_task"),
        F.avg("tokens").alias("tokens_per_task"), F.avg("dollars").alias("dollars_per_task"), F.avg(F.col("wall_ms") / 1000).alias("seconds_per_task"))


def learning_curve(evals: DataFrame, window: int = 10) -> DataFrame:
    """Rolling solve rate over the last tasks of each run."""
    return rolling(evals.select("run", "seq", "solved"), ["run"], ["seq"], window, F.col("solved").cast("double"), "rate").select("run", "seq", "rate")


def pareto(evals: DataFrame) -> DataFrame:
    """Modes that no other beats on both dollars per task and accuracy, cheapest first. Reports have few rows."""
    r = report(evals)
    better = r.select(*[F.col(c).alias(f"o_{c}") for c in ("dollars_per_task", "accuracy")])
    worse = (F.col("o_dollars_per_task") <= F.col("dollars_per_task")) & (F.col("o_accuracy") >= F.col("accuracy")) & ((F.col("o_dollars_per_task") < F.col("dollars_per_task")) | (F.col("o_accuracy") > F.col("accuracy")))
    return r.join(better, worse, "left_anti").orderBy("dollars_per_task", "pack", "mode")


def bench_runs(evals: DataFrame) -> DataFrame:
    """A row for each run of a pack in a mode: how many tasks, how many solved, what they cost, first and last."""
    return evals.groupBy("run", "pack", "mode").agg(
        F.count("*").alias("tasks"), F.sum(F.col("solved").cast("int")).alias("solved"), F.sum("dollars").alias("dollars"), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("finished_at"))


def board(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """tasks(id, ...) with status, attempts, last_run and last_detail from attempts(task, run, solved, detail, seq)."""
    last = attempts.groupBy(F.col("task").alias("id")).agg(F.count("*").alias("attempts"), F.max_by("run", "seq").alias("last_run"), F.max_by("detail", "seq").alias("last_detail"), F.max("solved").alias("any_solved"))
    status = F.when(F.col("attempts").isNull(), "open").when(F.col("last_detail") == "needs_review", "needs_review").when(F.col("any_solved"), "solved").otherwise("failed")
    return tasks.join(last, "id", "left").withColumn("status", status).withColumn("attempts", F.coalesce("attempts", F.lit(0))).drop("any_solved")


def trace_tasks(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row for each attempt with what is known of its task."""
    t, a = board(tasks, attempts).alias("t"), attempts.alias("a")
    return a.join(t, F.col("a.task") == F.col("t.id")).select(
        "a.task", "t.kind", "t.generator", "t.source", "t.dial", "t.difficulty", "t.status", "a.run", "a.solver", F.when(F.col("a.solved"), 1.0).otherwise(0.0).alias("solved"), "a.calls", "a.dollars", "a.depth", "a.recorded_at")


def generator_state(attempts: DataFrame, step: float = 0.1, start: float = 0.3, block: int = 10) -> DataFrame:
    """Each generator's dial after its attempts(generator, seq, solved): up where over 0.7 of a block of attempts are solved, down where under 0.3 are."""
    tried = ranked(attempts.select("generator", "seq", "solved"), ["generator"], ["seq"], "at").withColumn("block", F.floor(F.col("at") / block))
    each = tried.groupBy("generator", "block").agg(F.count("*").alias("n"), F.sum(F.col("solved").cast("int")).alias("k"))
    rate = F.col("k") / F.col("n")
    move = F.when(F.col("n") < block, 0).when(rate > 0.7, 1).when(rate < 0.3, -1).otherwise(0)
    out = each.groupBy("generator").agg(F.sum("n").alias("tried"), F.sum("k").alias("solved"), F.sum(move).alias("moves"))
    return out.select("generator", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.lit(start) + step * F.col("moves"), 6))).alias("dial"), (F.col("solved") / F.col("tried")).alias("solve_rate"), "tried", "solved")


def adopt(candidate: list[tuple[bool, float]], baseline: list[tuple[bool, float]]) -> bool:
    """A replay's gate: as many tasks solved, at no more cost."""
    solved = lambda xs: sum(ok for ok, _ in xs)
    cost = lambda xs: math.fsum(c for _, c in xs)
    return solved(candidate) >= solved(baseline) and cost(candidate) <= cost(baseline) + 1e-12
