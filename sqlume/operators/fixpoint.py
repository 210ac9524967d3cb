"""Semi-naive recursion: each round sees only the rows that the last one added.

Rounds whose rows fit a fixed bound are held on the driver as local relations, so that short loops cost one small job
each; larger ones go through tables in the shared folder, which cut the lineage and survive lost executors. Set
semantics compare whole rows, nulls being equal.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlume.errors import SqlError

HARD_ROUNDS = 10_000
MAX_ROWS = 1_000_000
LOCAL_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset one of our own, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sqlume-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """df computed once, as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rows:
    """The rows of one round, or of all so far: local up to LOCAL_ROWS, else in the shared folder."""

    def __init__(self, df: DataFrame, limit: int = LOCAL_ROWS) -> None:
        self.spark, self.schema = df.sparkSession, df.schema
        head = df.limit(limit + 1).collect()
        self.local = [tuple(r) for r in head] if len(head) <= limit else None
        self.df = self.spark.createDataFrame(self.local, self.schema) if self.local is not None else keep(df, "round")
        self.count = len(head) if self.local is not None else self.df.count()


def _hashable(row: tuple) -> tuple:
    return tuple(tuple(v) if isinstance(v, list) else ("nan",) if isinstance(v, float) and v != v else v + 0.0 if isinstance(v, float) else v for v in row)


def fixpoint(base: DataFrame, step, union_all: bool, max_rounds: int | None, name: str, on_round=None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """base and all that step(delta) adds, round by round. step takes a DataFrame and gives one of the same schema.

    max_rounds stops silently; HARD_ROUNDS rounds or MAX_ROWS rows are errors. With union_all rows are kept as they
    come, else only rows not seen before.
    """
    spark = base.sparkSession
    delta = Rows(base if union_all else base.distinct(), local_rows)
    seen = {_hashable(r) for r in delta.local} if delta.local is not None and not union_all else None
    parts, rounds, total = [delta], 0, delta.count
    if on_round:
        on_round(name, 0, delta.count, total)
    while delta.count and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        if rounds > HARD_ROUNDS:
            raise SqlError(f"recursive CTE {name} ran {HARD_ROUNDS} rounds; bound it with a condition or SET max_recursion_rounds")
        new = step(delta.df)
        if union_all:
            delta = Rows(new, local_rows)
        elif seen is not None and (got := Rows(new, local_rows)).local is not None:
            fresh = []
            for r in got.local:
                if (k := _hashable(r)) not in seen:
                    seen.add(k)
                    fresh.append(r)
            delta = Rows.__new__(Rows)
            delta.spark, delta.schema, delta.local, delta.count = spark, got.schema, fresh, len(fresh)
            delta.df = spark.createDataFrame(fresh, got.schema)
            if len(seen) > 10 * local_rows:
                seen = None
        else:
            new, seen = (got.df if seen is not None else new), None
            whole = _all(spark, parts)
            delta = Rows(new.distinct().join(whole.toDF(*[f"s_{c}" for c in whole.columns]), _same(new.columns), "left_anti"), local_rows)
        total += delta.count
        if on_round:
            on_round(name, rounds, delta.count, total)
        if total > MAX_ROWS:
            raise SqlError(f"recursive CTE {name} made over {MAX_ROWS} rows; use UNION to drop repeats, a condition, or ORDER BY ... LIMIT for a beam")
        if delta.count:
            parts.append(delta)
    return _all(spark, parts)


def _same(columns: list[str]):
    out = None
    for c in columns:
        e = F.col(c).eqNullSafe(F.col(f"s_{c}"))
        out = e if out is None else out & e
    return out


def _all(spark: SparkSession, parts: list[Rows]) -> DataFrame:
    """Local parts as one relation, the others as a union of tables."""
    local = [r for p in parts if p.local is not None for r in p.local]
    out = spark.createDataFrame(local, parts[0].schema)
    for p in parts:
        if p.local is None:
            out = out.union(p.df)
    return out
