"""Call events as a stream: sessions append JSON lines to a folder; windows of them are aggregated as they come."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, run string, function string, alias string, memo boolean, ok boolean, input_tokens long, output_tokens long, dollars double"


def append(folder: str, run: str, calls: list[dict]) -> None:
    """Write a run's traced calls as one new file, which appears whole."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    keys = ("function", "alias", "memo", "ok", "input_tokens", "output_tokens", "dollars")
    lines = [json.dumps({"ts": c.get("ts", now), "run": run} | {k: c[k] for k in keys}) for c in calls]
    part = top / f".{run}-{time.time_ns()}"
    part.write_text("\n".join(lines))
    part.rename(top / f"{run}-{time.time_ns()}.json")


def spending(spark: SparkSession, folder: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame: calls, tokens and dollars by window, run and function; events later than the watermark are dropped."""
    events = spark.readStream.schema(SCHEMA).json(folder)
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "run", "function").agg(
        F.sum(F.when(F.col("memo"), 0).otherwise(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("dollars").alias("dollars"))
