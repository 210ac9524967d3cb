"""Places within groups of any size: a group's rows are sorted over many tasks, not in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlume.operators.fixpoint import keep

#: Rows of a group that one task takes for a rolling window.
BLOCK_ROWS = 200_000


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place in its group, from 0; ties in no fixed order.

    The rows are dealt by ranges of (group, order), so that one large group fills many partitions. A place is the
    place in the partition plus the group's rows in partitions before it, of which there is one count each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = keep(df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the group
    counts = kept.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_part")]
    return kept.alias("l").join(counts.alias("r"), same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._at") - F.col("r._first")).alias(name))


def rolling(df: DataFrame, group: list[str], order: list[str], window: int, value, as_: str, block: int = BLOCK_ROWS) -> DataFrame:
    """df with the mean of a value over each row and the window - 1 before it in its group.

    Groups are cut into blocks; the last rows of a block also go to the next one, where they only lead in.
    """
    block = max(block, window)
    own = ranked(df, group, order, "_rank").withColumn("_value", value)
    b = F.floor(F.col("_rank") / block)
    led = own.withColumn("_lead", F.explode(F.when(F.col("_rank") % block >= block - (window - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    w = Window.partitionBy(*group, "_block").orderBy("_rank").rowsBetween(-(window - 1), 0)
    return led.withColumn("_block", b + F.col("_lead")).withColumn(as_, F.avg("_value").over(w)).where("_lead = 0").select(*df.columns, as_)
