"""web_fetch of a table's pages by executors, and CALLs whose rows go to tables as they grow."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sqlume import session, session_queries
from sqlume.errors import SqlError
from sqlume.session import Session
from sqlume.sources import tools

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests


def pages(n=300):
    """Pages by number: plain ones, and each tenth odd."""
    odd = ["", None, "no tags", "<p>" + "word " * 60_000 + "</p><b>end</b>", "ä&lt;<br>\U0001f600", "<script>x"]
    return [(i, odd[i // 10 % len(odd)] if i % 10 == 0 else f"<h1>{i}</h1><p>a &amp; b</p>") for i in range(n)]


def expected(rows):
    made = [(f"https://pages.example/{i}", 200, None if h is None else tools.page_text(h)) for i, h in rows]
    return sorted((u, s, t, None if t is None else -(-len(t) // 4)) for u, s, t in made)


def test_every_page_is_fetched_whole_in_order_and_none_passes_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = pages()
    spark.createDataFrame([*rows, *rows[:5]], "page_id long, html string").repartition(7).write.parquet(str(tmp_path / "pages.parquet"))
    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "toPandas"):
            m.setattr(DataFrame, name, lambda *a, **k: 1 / 0)
        out = session_queries.web_fetch_pages(spark, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    assert got == expected([*rows, *rows[:5]])
    assert max(len(t or "") for _, _, t, _ in got) > tools.MAX_BODY and got[0][0].endswith("/0")


def library(spark, urls):
    s = Session(spark, web=session_queries.Library(spark.createDataFrame([(f"https://pages.example/{i}", f"<p>{i}</p>") for i in range(20)], "url string, html string")))
    s.register("u", spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string").repartition(4))
    return s


def test_calls_of_a_table_are_traced_once_each_with_repeats(spark):
    s = library(spark, [f"https://pages.example/{i % 20}" for i in range(50)])
    out = s.sql("CALL web_fetch(url) FROM (SELECT url FROM u ORDER BY i DESC)")
    assert [r.text for r in out.collect()] == [str(i % 20) for i in reversed(range(50))]
    out.count()
    calls = s.system("trace_tool_calls").collect()
    assert len(calls) == 50 and {(c.tool, c.error) for c in calls} == {("web_fetch", None)}
    assert sorted(c.bytes_out for c in calls) == sorted(tools.row_bytes(tuple(r)) for r in out.collect())
    assert [r.text for r in s.sql("CALL web_fetch('https://pages.example/7')").collect()] == ["7"]


@pytest.mark.parametrize("bad,why", [("https://else.example/1", "else.example is not on the list"), (None, "None is not on the list"), ("https://pages.example/99", "there is no page https://pages.example/99")])
def test_a_page_that_is_refused_or_missing_stops_the_statement(spark, bad, why):
    s = library(spark, ["https://pages.example/1", bad, "https://pages.example/2"])
    with pytest.raises(SqlError, match=why):
        s.sql("CALL web_fetch(url) FROM (SELECT url FROM u ORDER BY i)")
    assert [c.error for c in s.system("trace_tool_calls").where(F.col("error").isNotNull()).collect()] != []


class Net:
    hosts = ("example.org",)

    def fetch(self, url):
        return 200, "text/plain", url.encode() * 20


def test_rows_of_a_call_leave_the_driver_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(session, "HELD_BYTES", 5_000)
    s = Session(spark, web=Net())
    s.register("u", spark.range(100).selectExpr("id AS i", "concat('http://example.org/', id) AS url").repartition(4))
    kept = []
    monkeypatch.setattr(session.loops, "keep", lambda df, name="kept", f=session.loops.keep: kept.append(name) or f(df, name))
    out = s.sql("CALL web_fetch(url) FROM (SELECT url FROM u ORDER BY i DESC)")
    assert [r.url for r in out.collect()] == [f"http://example.org/{i}" for i in reversed(range(100))]
    assert kept.count("called") > 5 and len(s.trace["tool_calls"]) < 20 and s.system("trace_tool_calls").count() == 100
