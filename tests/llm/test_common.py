import random

import numpy as np
import pytest

from sqlume.llm import common


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(root)}


def graph():
    rnd = random.Random(4)
    edges = [(rnd.randint(-50, 400), rnd.randint(-50, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1300)]
    return [(a, b) for a, b in edges if a != b] * 2


@pytest.mark.parametrize("part_edges", [500_000, 200, 0])
def test_components_match_brute_force(spark, monkeypatch, part_edges):
    monkeypatch.setattr(common, "PART_EDGES", part_edges)
    for parts, coalesce in ((1, "true"), (7, "false")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        df = spark.createDataFrame([*graph(), (5, 5), (None, 3), (3, None)], "a long, b long").repartition(parts)
        got, _ = common.connected_components(df)
        assert {tuple(r) for r in got.collect()} == brute(graph())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert common.connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_local_stars_match_brute_force():
    u, v = np.array(graph()).T
    assert set(zip(*map(np.ndarray.tolist, common.local_stars(u, v)))) == {x for x in brute(graph()) if x[0] != x[1]}


def test_a_vertex_with_very_many_neighbours_is_split(spark):
    """In the join by vertex no task reads more than a part of the hot vertex' edges."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    n = 1_000_000
    both = spark.range(1, n).selectExpr("0L as u", "id as v").union(spark.range(1, n).selectExpr("id as u", "0L as v"))
    low = both.groupBy("u", common.F.pmod(common.F.hash("u"), common.F.lit(2))).agg(common.F.min("v").alias("m")).select("u", "m")
    joined = both.join(low, "u").where("v > u").select("v", "m")
    assert joined.distinct().count() == n - 1
    counted = joined.distinct()
    counted.collect()
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_values_are_looked_up_by_place(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as found", "'x' as there").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    places = common.located(df, "id").where("id % 3 = 0").selectExpr("file", "pos", "id as a", "-id as b")
    got = common.looked_up(df, places, ("a", "b"), "own").collect()
    assert len(got) == 1000 and all((r.own is None) == (r.id % 3 > 0) and (r.own is None or (r.own.a, r.own.b) == (r.id, -r.id)) for r in got)
    left = common.drop_rows(df, places.select("file", "pos"))
    assert left.columns == df.columns and {r.id for r in left.collect()} == {i for i in range(1000) if i % 3}
    assert common.looked_up(df, places.where("false"), ("a",), "own") is None and common.drop_rows(df, places.where("false").select("file", "pos")) is df
