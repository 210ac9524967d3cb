import base64
import hashlib
import random
import zlib

import pytest

from sqlume.llm import warc
from sqlume.llm.common import scratch

SCHEMA = "page_id long, url string, html string, record_type string, file int"


def pages():
    rnd = random.Random(2)
    rows = [(i, f"https://{rnd.choice('abc')}.example.{rnd.choice(['com', 'org'])}:443/p{i % 30}?q={i % 7}", "é" * rnd.randint(0, 4) + "x" * rnd.randint(0, 3)) for i in range(150)]
    return [*rows, (200, None, None), (201, "", ""), (202, "http://a b/\tc", "long " * 100_000), (203, "http://[bad", "q"), (204, "http://h/é", "\r\n\r\nWARC/1.1\r\n"), (150, "http://z/", "only once")]


def brute(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = set()
    for i, _, h in rows:
        raw, f = (h or "").encode(), first[h or ""]
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_round_trip_matches_brute_force(spark):
    got = warc.round_trip(frame(spark, pages()).repartition(5)).collect()
    assert len(got) == len(pages())
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(pages())


def test_small_payloads_can_be_left_alone(spark):
    got = warc.round_trip(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_null_and_repeated_ids_and_empty_table(spark):
    got = warc.round_trip(frame(spark, [(None, "u", "a"), (None, "u", "b"), (5, "u", "a"), (5, "u", "a"), (9, "u", "a")])).collect()
    assert sorted(((r.page_id or -1), r.record_type, r.refers_to or -1) for r in got) == [(-1, "response", -1), (-1, "revisit", 5), (5, "response", -1), (5, "response", -1), (9, "revisit", 5)]
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_index_finds_every_capture_by_range_reads(spark):
    folder = scratch(spark, "warc-test")
    manifest = warc.write_archives(frame(spark, pages()), folder)
    ranges = [tuple(r) for r in warc.write_index(manifest, folder, block_lines=7).collect()]
    index = warc.CaptureIndex(folder, [r[:3] for r in ranges])
    blocks = sum(r[3] for r in ranges)
    assert len(ranges) > 2 and blocks > 15
    for url in {u for _, u, _ in pages()}:
        want = sorted(i for i, u, _ in pages() if warc.url_key(u) == warc.url_key(url))
        before = index.reads
        lines = index.lookup(url)
        assert sorted(x[0] for x in lines) == want and index.reads - before <= 2 + len(want) // 7 + 1
        for x in lines:
            assert x in index.find(warc.url_key(url), x[0])
            own, http, payload = index.fetch(x)
            assert own["x-page"] == str(x[0]) and own["warc-type"] == x[2] and (x[2] == "revisit" or len(payload) == int(http["content-length"]))
    assert index.lookup("https://nowhere.test/") == [] and index.find("aaa", 1) == [] and index.find("zzz", None) == []


def test_lookups_in_order_read_each_block_about_once(spark):
    folder = scratch(spark, "warc-test")
    rows = [(i, "http://one.example/", f"p{i}") for i in range(500)]  # one very common URL over many ranges
    manifest = warc.write_archives(frame(spark, rows), folder)
    ranges = [tuple(r) for r in warc.write_index(manifest, folder, block_lines=20).collect()]
    index = warc.CaptureIndex(folder, [r[:3] for r in ranges])
    assert [x[0] for i in range(500) for x in index.find(warc.url_key("http://one.example/"), i)] == list(range(500))
    assert len(ranges) > 2 and index.reads <= sum(r[3] for r in ranges)
    assert len(index.lookup("http://one.example/")) == 500


def test_no_payload_is_shuffled(spark, tmp_path):
    frame(spark, pages()).write.parquet(str(tmp_path / "p"))
    seen, real = [], warc.materialize
    warc.materialize = lambda df, name: (seen.append(df), real(df, name))[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warc.round_trip(spark.read.parquet(str(tmp_path / "p"))).collect()
    finally:
        warc.materialize = real
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(pages())
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    writes = [p for p in plans if "html" in p and "MapInArrow" in p]
    assert writes and not any(x in p for p in writes for x in ("Join", "Aggregate", "Repartition", "Sort"))


def test_keys_and_broken_records():
    assert warc.url_key("https://M.a.example.com:80/X?q") == "com,example,a,m:80)/x?q" and warc.url_key("http://h:80") == "h)/"
    record = warc.build_record(1, "u", b"body", "D", None)
    assert warc.parse_record(record)[2] == b"body" and zlib.decompress(zlib.compress(record)) == record
    for bad in (record[:-3], b"HTTP" + record):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
