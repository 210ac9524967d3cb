import hashlib

import pytest

from sqlume.llm import sharding


def test_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(tuple(names), 1009)
    share = [table.count(k) for k in range(20)]
    assert sum(share) == 1009 and max(share) - min(share) <= 1
    less = sharding.lookup_table(tuple(names[:-1]), 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 19)
    assert moved < 0.25 * 1009
    for bad in ((("a", "a"), 11), ((), 11), (("a", "b"), 12), (tuple("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement_matches_brute_force(spark):
    rows = [(i, "x", 1, 2) for i in range(200)] + [(None, "n", 1, 2), (7, "again", 1, 2)]
    schema = "doc_id long, text string, slot int, shard int"
    names = tuple(f"n{i}" for i in range(7))
    out = sharding.shard(spark.createDataFrame(rows, schema), "doc_id", names, 101)
    table = sharding.lookup_table(names, 101)
    want = []
    for i, t, *_ in rows:
        slot = int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:15], 16) % 101
        want.append((i, t, slot, table[slot]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert out.columns == ["doc_id", "text", "slot", "shard", "slot_", "shard_"]  # no column of the input is lost
    assert sorted(((r.doc_id, r.text, r.slot_, r.shard_) for r in out.collect()), key=key) == sorted(want, key=key)
    assert {(r.slot, r.shard) for r in out.collect()} == {(1, 2)}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert sharding.shard(spark.createDataFrame([], schema), "doc_id", names, 101).count() == 0


def test_keys_named_like_the_new_columns(spark):
    df = spark.createDataFrame([(i, i + 1, i + 2) for i in range(30)], "slot int, SHARD int, doc_id int")
    names, table = ("a", "b", "c"), sharding.lookup_table(("a", "b", "c"), 101)
    for key in ("slot", "SHARD", "shard"):
        out = sharding.shard(df, key, names, 101)
        assert out.columns == ["slot", "SHARD", "doc_id", "slot_", "shard_"]
        for r in out.collect():
            slot = int(hashlib.md5(str(r["slot" if key == "slot" else "SHARD"]).encode()).hexdigest()[:15], 16) % 101
            assert (r.slot_, r.shard_) == (slot, table[slot])
