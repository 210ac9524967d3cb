"""Output, documents, the web, tool servers, prices, async children, inserts, and joins that end at the first match."""

import json
import threading
import zipfile

import pytest

from sqlume import output
from sqlume.calls.providers import Reply, Router, Ruled, Scripted
from sqlume.errors import SqlError
from sqlume.session import Session
from sqlume.sources import convert, tools


def test_output_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5, True, '{"k": [1]}', [0.5, 1.0]), (None, "x\ny", 3.0, None, None, None), (2, "é" * 70, float("nan"), False, "null", [])], "i long, t string, d double, b boolean, j string, v array<float>")
    got = json.loads(output.to_json(df, ["BIGINT", "TEXT", "DOUBLE", "BOOLEAN", "JSON", "VECTOR"]))
    assert got[0] == {"i": 1, "t": 'a "q", b', "d": 1.5, "b": True, "j": {"k": [1]}, "v": [0.5, 1.0]} and got[1] == {"i": None, "t": "x\ny", "d": 3.0, "b": None, "j": None, "v": None} and got[2]["d"] == "NaN" and list(got[0]) == df.columns
    assert output.render_csv(df).split("\r\n")[:2] == ["i,t,d,b,j,v", '1,"a ""q"", b",1.5,true,"{""k"": [1]}",[2 floats]'] and '\r\n,"x\ny",3,,,\r\n' in output.render_csv(df)
    table = output.render_table(df.select("i", "t"), 2).split("\n")
    assert table[0].startswith("i    | t") and set(table[1]) <= set("-+") and table[-1] == "... 1 more rows" and table[3].startswith("NULL")
    assert ("é" * 57 + "...") in output.render_table(df) and "more rows" not in output.render_table(df)
    assert output.render_table(df.limit(0).select("i")) == "i\n-"
    output.write_csv(df.select("i", "t"), str(tmp_path / "c"))
    output.write_json(df.select("i", "t"), str(tmp_path / "j"))
    assert {r.i for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {"1", "2", None}
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_documents_are_read_searched_and_written(spark, tmp_path):
    s = Session(spark, workspace=str(tmp_path))
    s.sql("CALL write_file('memo.docx', '# Head & tail\n\nThe **deal** holds.\n- Item\n| a | b |\n|---|---|\n| 1 | 2 |'); CALL write_file('m.xlsx', 'Item,Year\nSales,\"1,200\"\nMargin,0.42')")
    text = lambda name: s.sql(f"SELECT text FROM read('{name}')").first().text
    assert text("memo.docx") == "Head & tail\nThe deal holds.\n- Item\n| a | b |\n| 1 | 2 |\n" and text("m.xlsx") == '## Sheet: Sheet1\nItem,Year\nSales,"1,200"\nMargin,0.42\n\n'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:r><w:t>A</w:t><w:tab/><w:t>B &amp; C</w:t></w:r></w:p><w:tbl><w:tr>{cell("h1")}{cell("h2")}</w:tr></w:tbl><w:p/></w:body></w:document>')
        z.writestr("word/comments.xml", f"<w:comments {w}><w:comment><w:p><w:r><w:t>why?</w:t></w:r></w:p></w:comment></w:comments>")
    assert text("t.docx") == "A\tB & C\nh1 | h2\n\n\n## Comments\nwhy?\n"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<sld {a}><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p><a:p/></sld>")
    assert text("s.pptx") == "## Slide 2\nslide 2\n\n## Slide 10\nslide 10\n\n"
    (tmp_path / "m.eml").write_bytes(b"Subject: x\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ncaf=C3=A9 is soft =\r\nwrapped\r\n")
    assert text("m.eml").endswith("café is soft wrapped\n")
    (tmp_path / "bad.docx").write_text("no zip")
    (tmp_path / "x.pdf").write_text("no pdf")
    with pytest.raises(SqlError, match="not an Office file"):
        text("bad.docx")
    with pytest.raises(SqlError):
        text("x.pdf")
    assert [tuple(r) for r in s.sql("SELECT path, lineno FROM grep('deal|slide 10|café') ORDER BY path").collect()] == [("m.eml", 4), ("memo.docx", 2), ("s.pptx", 5)]
    assert s.sql("SELECT path FROM search('deal')").first().path == "memo.docx"
    assert convert.kind_of(tmp_path / "A.DOCX") == "docx"


class Net:
    hosts = ("example.org",)

    def fetch(self, url):
        return 200, "text/html", b"<title>T</title><p>A &#8212; &#x41;&amp;lt; &#55555555;</p><script>no</script>"

    def search(self, query, n):
        return [(f"{query} {i}", f"http://example.org/{i}", "s") for i in range(30)]


def test_web_tools_go_through_the_sessions_backend(spark):
    s = Session(spark, web=Net())
    assert [tuple(r) for r in s.sql("CALL web_fetch('https://www.example.org/a')").collect()] == [("https://www.example.org/a", 200, "T\nA — A&lt; &#55555555;", 6)]
    assert [tuple(r) for r in s.sql("CALL web_search('q', 2)").collect()] == [(1, "q 0", "http://example.org/0", "s"), (2, "q 1", "http://example.org/1", "s")]
    assert s.sql("CALL web_search('q')").count() == 10 and s.sql("CALL web_search('q', 99)").count() == 20
    for bad in ("CALL web_fetch('https://example.com/')", "CALL web_fetch('file:///etc/passwd')", "CALL web_fetch('https://notexample.org/')", "CALL web_search('q', 0)"):
        with pytest.raises(SqlError):
            s.sql(bad)
    with pytest.raises(SqlError, match="no web access"):
        Session(spark).sql("CALL web_fetch('https://example.org/')")
    from pyspark.sql import functions as F

    from sqlume.operators.text import html_text

    page = Net().fetch("")[2].decode()
    assert spark.createDataFrame([(page,)], "h string").select(html_text(F.col("h")).alias("t")).first().t == tools.page_text(page)


class Server:
    def tools(self):
        return [{"name": "look", "args": ["z", "id", "a"], "required": ["id"], "read_only": True}, {"name": "put", "args": ["id", "value"], "required": ["id", "value"]}]

    def call(self, name, args):
        return [f"{name} {k}={v}" for k, v in sorted(args.items())]


def test_tools_of_a_server(spark):
    s = Session(spark)
    s.connect("shop", Server())
    assert [r.text for r in s.sql("SELECT text FROM shop_look('7', 'x') ORDER BY text").collect()] == ["look a=x", "look id=7"]
    assert [r.text for r in s.sql("SELECT r.text FROM (VALUES ('1'), ('2')) AS v(i) CROSS JOIN LATERAL shop_look(v.i) r ORDER BY 1").collect()] == ["look id=1", "look id=2"]
    assert [r.text for r in s.sql("CALL shop_put('1', 'v')").collect()] == ["put id=1", "put value=v"]
    with pytest.raises(SqlError):
        s.sql("CALL shop_put('1')")


def test_router_prices_replies():
    r = Router({"worker": [Scripted(default="four")]}, prices={"worker": (1.0, 5.0)})
    assert r.complete("worker", "x" * 40) == Reply("four", 10, 1, 15e-6)


def test_async_children_run_while_the_parent_goes_on(spark):
    gate, began = threading.Event(), threading.Barrier(3, timeout=60)

    def runner(child, role, task):
        began.wait()
        gate.wait(60)
        child.sql(f"CALL send('parent', 'from {task}')")
        return f"{role.name} {task}", {"turns": 1}

    s = Session(spark, runner=runner)
    s.sql("CREATE AGENT helper PROMPT 'help'; CREATE TABLE h AS SELECT v.t, a.handle, a.session FROM (VALUES ('x'), ('y')) AS v(t) CROSS JOIN LATERAL spawn_async('helper', v.t) a")
    began.wait()  # both children run although nothing awaited them
    handles = {r.t: (r.handle, r.session) for r in s.sql("SELECT t, handle, session FROM h").collect()}
    assert len({h for h, _ in handles.values()}) == 2 and not any(f.done() for _, f in s.pending.values())
    s.sql(f"CALL send('{handles['x'][0]}', 'to child')")
    assert s.pending[handles["x"][0]][0].mail[0][2] == "to child"
    with pytest.raises(SqlError):
        s.sql("CALL send('nobody', 'x')")
    gate.set()
    got = s.sql("SELECT h.t, w.answer, w.session FROM h CROSS JOIN LATERAL await(h.handle) w WHERE h.t = 'x'").collect()
    assert [(r.t, r.answer) for r in got] == [("x", "helper x")] and got[0].session == handles["x"][1]
    s.close()
    assert sorted(r[2] for r in s.mail) == ["from x", "from y"] and s.system("trace_sessions").where("outcome = 'final'").count() == 3
    with pytest.raises(SqlError):
        s.sql(f"SELECT answer FROM await('{handles['x'][0]}')")


def test_inserts_write_new_rows_only(spark):
    s = Session(spark)
    s.sql("CREATE TABLE t AS SELECT 0 AS k, 'a' AS v")
    for i in range(1, 4):
        s.sql(f"INSERT INTO t (k) VALUES ({i})")
    s.sql("INSERT INTO t SELECT k + 10, v FROM t")
    assert sorted((r.k, r.v) for r in s.sql("SELECT k, v FROM t").collect()) == [(0, "a"), (1, None), (2, None), (3, None), (10, "a"), (11, None), (12, None), (13, None)]
    assert [r.k for r in s.in_order("t").collect()][:4] == [0, 1, 2, 3]
    base, path = s.appended["t"]
    assert base.count() == 1 and spark.read.parquet(path).count() == 7
    s.sql("DROP TABLE t; CREATE TABLE t (k BIGINT); INSERT INTO t VALUES (5)")
    assert [r.k for r in s.sql("SELECT k FROM t").collect()] == [5] and "t" in s.appended


def test_semi_and_anti_joins_with_calls_stop_at_the_first_match(spark):
    p = Ruled({"fits": lambda a: int(a["x"]) % 7 == int(a["y"]) % 7})
    s = Session(spark, p)
    s.register("l", spark.createDataFrame([(i, str(i)) for i in range(12)], "k long, x string"))
    s.register("r", spark.createDataFrame([(i, str(i)) for i in range(5)], "k long, y string"))
    s.sql("CREATE FUNCTION fits(x TEXT, y TEXT) RETURNS BOOLEAN AS PROMPT '{x} {y}?' BATCH 1")
    semi = [r.k for r in s.sql("SELECT l.k FROM l WHERE EXISTS (SELECT 1 FROM r WHERE fits(l.x, r.y)) ORDER BY 1").collect()]
    assert semi == [i for i in range(12) if i % 7 < 5] and p.calls < 12 * 5
    anti = [r.k for r in s.sql("SELECT l.k FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE fits(l.x, r.y)) ORDER BY 1").collect()]
    assert anti == [5, 6]
    part = [r.k for r in s.sql("SELECT l.k FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = l.k AND fits(l.x, r.y)) ORDER BY 1").collect()]
    assert part == list(range(5, 12))
    s.register("none", spark.createDataFrame([], "k long, y string"))
    assert s.sql("SELECT l.k FROM l WHERE EXISTS (SELECT 1 FROM none n WHERE fits(l.x, n.y))").count() == 0 and s.sql("SELECT l.k FROM l WHERE NOT EXISTS (SELECT 1 FROM none n WHERE fits(l.x, n.y))").count() == 12
