"""Traces of runs: event rows kept on the driver up to a bound, beyond it as Parquet in the shared folder."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from sqlume.operators.fixpoint import shared_dir

#: Rows of one log that stay on the driver between statements.
KEPT_ROWS = 10_000

SCHEMAS = {
    "runs": "run string, started_at double, task string",
    "sessions": "session string, run string, parent string, depth int, role string, started_at double, task string",
    "session_ends": "session string, finished_at double, outcome string, turns int, calls long, tokens long, dollars double",
    "statements": "n long, sql string, kind string, session string, statement string, started_at double",
    "statement_ends": "statement string, finished_at double, calls long, tokens long, dollars double, error string, explain string",
    "calls": "function string, alias string, fingerprint string, memo boolean, ok boolean, input_tokens long, output_tokens long, dollars double, ms long",
    "tool_calls": "statement string, tool string, args string, bytes_out long, elapsed_ms long, error string",
    "rounds": "cte string, round long, delta_rows long, total_rows long",
    "final": "session string, rows long",
}


class Log(list):
    """Rows (dicts) of one kind of event, in order. Those beyond the bound are in files."""

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name, self.schema = name, SCHEMAS[name]
        self.columns = [c.split()[0] for c in self.schema.split(", ")]
        self.path: str | None = None
        self.frames: list[DataFrame] = []  # rows that executors made
        self.lock = threading.Lock()

    def _rows(self) -> list[tuple]:
        return [tuple(r.get(c) for c in self.columns) for r in self]

    def spill(self, spark: SparkSession, most: int | None = None) -> None:
        """Move the rows to files if there are too many of them."""
        if len(self) > (KEPT_ROWS if most is None else most):
            with self.lock:
                self.path = self.path or f"{shared_dir(spark)}/trace-{self.name}-{uuid.uuid4().hex}"
                rows = self._rows()
                spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
                del self[: len(rows)]  # others may have come meanwhile

    def frame(self, spark: SparkSession) -> DataFrame:
        here = spark.createDataFrame(self._rows(), self.schema)
        out = here if self.path is None else spark.read.schema(self.schema).parquet(self.path).unionByName(here)
        for made in self.frames:
            out = out.unionByName(made)
        return out


class Trace:
    """The logs of a run, shared by its sessions."""

    def __init__(self, run: str | None = None) -> None:
        self.run = run or uuid.uuid4().hex[:8]
        self.logs = {name: Log(name) for name in SCHEMAS}

    def __getitem__(self, name: str) -> Log:
        return self.logs[name]

    def spill(self, spark: SparkSession) -> None:
        for log in self.logs.values():
            log.spill(spark)

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """One of runs, sessions, statements, calls, tool_calls, rounds and final; begins and ends are joined."""
        if name in ("sessions", "statements"):
            key = name[:-1]
            return self.logs[name].frame(spark).join(self.logs[f"{key}_ends"].frame(spark), key, "left")
        return self.logs[name].frame(spark)
