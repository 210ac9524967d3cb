"""Runs: a task carried out by a solver in a session, turn by turn, with the tables that outlive a run.

``turns``, ``conversations`` and ``memory`` are Parquet folders below the store, which runs append to and later runs
read. ``plan`` is an ordinary table that a solver may create; its last row for each step counts.
"""

from __future__ import annotations

import subprocess
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlume.errors import BudgetError, SqlError
from sqlume.operators.fixpoint import shared_dir
from sqlume.output import render_table
from sqlume.session import INSERT, Session

TABLES = {
    "turns": "run string, n long, sql string, result string",
    "conversations": "conversation string, run string, n long, role string, text string, ts double",
    "memory": "key string, value string",
}
STATUSES = ("todo", "doing", "done")
#: Beyond SHOWN turns the transcript has the results of the last LATEST only; the rest is named by its row.
SHOWN, LATEST = 16, 8
MAX_TURNS = 64


class Store:
    """Folders of rows that runs append to."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        for name in TABLES:
            self.add(name, [])

    def add(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.parquet(f"{self.path}/{name}/{INSERT}={time.time_ns()}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop(INSERT)


@dataclass
class Outcome:
    """How a run ended: final, turns_exhausted, budget_exhausted or error."""

    run: str
    outcome: str
    answer: DataFrame | None
    turns: int
    detail: str = ""


class Run:
    """What a solver works with: turn() runs a script and gives its result as text; transcript is what it has seen."""

    def __init__(self, session: Session, store: Store, check: str | None = None) -> None:
        self.session, self.store, self.check = session, store, check
        self.seen: list[tuple[str, str]] = []

    def turn(self, sql: str, rows: int = 20) -> str:
        if len(self.seen) >= MAX_TURNS:
            raise SqlError(f"a run has at most {MAX_TURNS} turns")
        kept = self.session.answer
        try:
            out = self.session.sql(sql)
            if self.session.answer is not None and kept is None and (problem := self._refused()):
                self.session.answer, result = None, problem
            else:
                result = render_table(out, rows) if out is not None else "done"
        except BudgetError:
            raise
        except SqlError as e:
            result = f"error: {e}"
        self.seen.append((sql, result))
        self.store.add("turns", [(self.session.trace.run, len(self.seen), sql, result)])
        return result

    def _refused(self) -> str | None:
        """What the finish check says against an answer."""
        if self.check is None:
            return None
        done = subprocess.run(["sh", "-c", self.check], cwd=self.session._workspace().root, capture_output=True, text=True, timeout=600, check=False)
        return None if done.returncode == 0 else f"error: the check refuses FINAL: {(done.stdout + done.stderr)[-2000:]}"

    def transcript(self) -> list[tuple[str, str]]:
        """(sql, result) of all turns, old results as one line that names their row of turns."""
        n = len(self.seen)
        run = self.session.trace.run
        return [(q, r if n <= SHOWN or i >= n - LATEST else f"[turns: run {run}, n {i + 1}]") for i, (q, r) in enumerate(self.seen)]

    def plan(self) -> list[tuple[str, str]]:
        """Steps and their last status, in the order in which they first came."""
        if "plan" not in self.session.views:
            return []
        rows = [tuple(r) for r in self.session.in_order("plan").select("step", "status").collect()]
        bad = {s for _, s in rows} - set(STATUSES)
        if bad:
            raise SqlError(f"plan: a status is one of {', '.join(STATUSES)}, not {sorted(map(str, bad))[0]}")
        last: dict[str, str] = {}
        for step, status in rows:
            last[step] = status
        return list(last.items())


class Harness:
    """Runs tasks on a store. solver(run, task) works through run.turn() until it has given a FINAL."""

    def __init__(self, spark: SparkSession, store: Store | None = None, **options) -> None:
        self.spark, self.store, self.options = spark, store or Store(spark), {"memo": {}} | options  # runs share what calls have answered

    def run(self, task: str, solver: Callable[[Run, str], None], context: str | None = None, check: str | None = None, conversation: str | None = None, load: dict[str, str] | None = None) -> Outcome:
        session = Session(self.spark, task=task, **self.options)
        for name in TABLES:
            session.register(name, self.store.table(name))
        session.appended["memory"] = (self.spark.createDataFrame([], TABLES["memory"]), f"{self.store.path}/memory")  # INSERT INTO memory lasts
        for name, path in (load or {}).items():
            session.load(name, path)
        if context is not None:
            session.context(context)
        run, outcome, detail = Run(session, self.store, check), "final", ""
        try:
            solver(run, task)
            outcome = "final" if session.answer is not None else "turns_exhausted"
        except BudgetError as e:
            outcome, detail = "budget_exhausted", str(e)
        except Exception as e:  # noqa: BLE001  a solver's failure ends its run, not the harness
            outcome, detail = "error", str(e)
        session.close(outcome, len(run.seen))
        self.last = session
        if conversation is not None:
            answer = render_table(session.answer) if session.answer is not None else outcome
            n = self.store.table("conversations").where(F.col("conversation") == conversation).count()
            self.store.add("conversations", [(conversation, session.trace.run, n + i, role, text, time.time()) for i, (role, text) in enumerate((("user", task), ("assistant", answer)))])
        return Outcome(session.trace.run, outcome, session.answer, len(run.seen), detail)

    def memory(self) -> DataFrame:
        """The keys of memory, each with its last value."""
        return self.spark.read.parquet(f"{self.store.path}/memory").groupBy("key").agg(F.max_by("value", INSERT).alias("value"))

    def results(self) -> DataFrame:
        """Turns by run, in order, with how many a run has had."""
        return self.store.table("turns").withColumn("of", F.count("*").over(Window.partitionBy("run")))
