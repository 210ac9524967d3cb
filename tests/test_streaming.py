"""Traced calls as a stream."""

from sqlume.streaming import events


def test_windows_of_calls(spark, tmp_path):
    call = {"function": "f", "alias": "worker", "memo": False, "ok": True, "input_tokens": 10, "output_tokens": 5, "dollars": 0.5}
    events.append(str(tmp_path / "e"), "r1", [{**call, "ts": "2024-01-01T00:00:01Z"}, {**call, "ts": "2024-01-01T00:00:59Z"}, {**call, "ts": "2024-01-01T00:01:00Z", "memo": True, "dollars": 0.0}])
    events.append(str(tmp_path / "e"), "r2", [{**call, "ts": "2024-01-01T00:00:30Z", "function": "g"}])
    q = events.spending(spark, str(tmp_path / "e")).writeStream.format("memory").queryName("spending").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.window.start.minute, r.run, r.function, r.calls, r.tokens, r.dollars) for r in spark.table("spending").collect())
    assert got == [(0, "r1", "f", 2, 30, 1.0), (0, "r2", "g", 1, 15, 0.5), (1, "r1", "f", 0, 15, 0.0)]
