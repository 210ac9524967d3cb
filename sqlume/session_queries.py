"""Queries of sessions: workspace files, loads, tools, delegation, calibration, traces, learning and generated rows, with the same in DuckDB's SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlume import evals, output
from sqlume.calls.providers import Reply, Ruled, Scripted
from sqlume.operators.fixpoint import keep
from sqlume.queries import FUNCTIONS, RULES, call_session, html_oracle, tables
from sqlume.session import Session
from sqlume.sources.files import new_folder

NATION_ROWS = "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey"


def nations(spark: SparkSession, sf_dir: str) -> list[tuple]:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    return [(r.n_nationkey, r.n_name, r.n_regionkey) for r in rows]


def session_on_files(spark: SparkSession, sf_dir: str) -> Session:
    """The nations in a workspace: one file of CSV, one of lines, one of JSON, and a folder of small files."""
    top = new_folder(spark)
    rows = nations(spark, sf_dir)
    (top / "n.csv").write_text("key,name,region\n" + "".join(f'{k},"{n}",{r}\n' for k, n, r in rows))
    (top / "n.txt").write_text("".join(f"{n} in {r}\n" for _, n, r in rows))
    (top / "n.json").write_text(json.dumps([{"key": k, "half": k / 2, "big": k > 10} for k, _, _ in rows]))
    (top / "each").mkdir()
    for k, n, _ in rows:
        (top / "each" / f"{k:02d}.md").write_text(n * (k + 1))
    return Session(spark, workspace=str(top), env=("SQLUME_TEST",), skills={"count": ("built in", "Count things.")})


def files_of_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_on_files(spark, sf_dir).sql("SELECT path, size, kind FROM files('each/*.md')")


def lines_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_on_files(spark, sf_dir).sql("SELECT lineno, text FROM lines('n.txt', 3, 20)")


def grep_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_on_files(spark, sf_dir).sql("SELECT path, lineno, text FROM grep('_1[0-9]? in [02]', '*.txt')")


def read_of_each_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_on_files(spark, sf_dir).sql("SELECT f.path, LENGTH(r.text) AS n FROM files('each/*.md') f CROSS JOIN LATERAL read(f.path) r")


def search_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file has one word, so that the score of the one that holds the word asked for follows from the number of files alone."""
    return session_on_files(spark, sf_dir).sql("SELECT path, lineno FROM search('nation_0', 'each/*.md')")


def skill_and_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_on_files(spark, sf_dir).sql("SELECT name, source, text FROM skill('count') UNION ALL SELECT 'env', 'none', COALESCE(value, 'unset') FROM env('SQLUME_TEST')")


def load_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and JSON as tables with inferred types."""
    s = session_on_files(spark, sf_dir)
    s.load("c", "n.csv")
    s.load("j", "n.json")
    return s.sql("SELECT c.key + 1 AS k, c.name, c.region * 2 AS r, j.half, j.big FROM c JOIN j ON j.key = c.key")


def context_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.context("\n\n".join(f"{n}\nof {r}" for _, n, r in nations(spark, sf_dir)))
    return s.sql("SELECT ordinal, text FROM ctx")


def call_of_each_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool with effects, run for each row of a query, and what it wrote read back."""
    s = tables(session_on_files(spark, sf_dir), sf_dir, ["nation"])
    s.sql("CALL write_file('out/' || n_name, n_name || ' ' || CAST(n_regionkey AS TEXT)) FROM (SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey)")
    return s.sql("SELECT f.path, r.text FROM files('out/*') f CROSS JOIN LATERAL read(f.path) r")


def _roles(spark: SparkSession, sf_dir: str) -> Session:
    s = tables(Session(spark, runner=lambda child, role, task: (f"{role.name} {task}", {"turns": 1})), sf_dir, ["nation"])
    s.sql("CREATE AGENT helper MODEL 'worker' PROMPT 'Help.'")
    return s


def spawn_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).sql("SELECT n.n_name, r.answer, JSON_EXTRACT_STRING(r.detail, 'turns') AS turns FROM nation n CROSS JOIN LATERAL spawn('helper', n.n_name) r")


def spawn_async_await(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _roles(spark, sf_dir)
    s.sql("CREATE TABLE h AS SELECT n.n_name, a.handle FROM nation n CROSS JOIN LATERAL spawn_async('helper', n.n_name) a")
    return s.sql("SELECT h.n_name, w.answer FROM h CROSS JOIN LATERAL await(h.handle) w")


def inbox_of_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    def runner(child: Session, role, task: str) -> tuple[str, dict]:
        child.sql(f"CALL send('parent', '{task}')")
        return "sent", {"turns": 1}

    s = tables(Session(spark, runner=runner), sf_dir, ["nation"])
    s.sql("CREATE TABLE done AS SELECT r.answer FROM nation n CROSS JOIN LATERAL rlm(n.n_name) r")
    return s.sql("SELECT text FROM inbox()")


def calls_in_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree search: each round expands what the last one found."""
    def two(prompt: str) -> str:
        name = prompt.split("\n")[0]
        return json.dumps([f"{name}a", f"{name}b", f"{name}c"])

    s = tables(Session(spark, Scripted(default=two)), sf_dir, ["nation"])
    return s.sql("WITH RECURSIVE t(item, d) AS (SELECT n_name, 0 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT e.item, t.d + 1 FROM t CROSS JOIN LATERAL expand(t.item, 2) AS e WHERE t.d < 2) SELECT item, d FROM t")


def calibrate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of a proxy from a sample in which one of the ten answers contradicts the scores."""
    rules = {"proxy": lambda a: int(a["x"].split()[1]) / 10, "oracle": lambda a: int(a["x"].split()[1]) >= 4 and a["x"] != "row 7"}
    s = Session(spark, Ruled(rules))
    s.sql("CREATE FUNCTION proxy(x TEXT) RETURNS DOUBLE AS PROMPT 'score {x}'; CREATE FUNCTION oracle(x TEXT) RETURNS BOOLEAN AS PROMPT 'is {x}' PROXY proxy")
    return s.sql("CALIBRATE oracle FROM (SELECT 'row ' || CAST(g.i AS TEXT) AS x FROM generate_series(1, 10) AS g(i))").select("function", "proxy", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "sample")


def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN ANALYZE says was made: rows and calls."""
    s = call_session(spark, sf_dir, ["region", "nation", "supplier", "part"])
    out = s.sql("EXPLAIN ANALYZE SELECT p_partkey FROM part WHERE p_size > 20 AND relevant(p_name)")
    return out.where("plan like 'actual:%'").select(F.regexp_extract("plan", r"actual: (\d+) rows", 1).cast("long").alias("n"), F.regexp_extract("plan", r"(\d+) calls", 1).cast("long").alias("calls"))


def trace_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a run by depth, from the trace."""
    s = _roles(spark, sf_dir)
    s.sql("CREATE TABLE done AS SELECT r.answer FROM nation n CROSS JOIN LATERAL spawn('helper', n.n_name) r")
    s.close()
    return s.system("trace_sessions").groupBy("depth", "role", "outcome").agg(F.count("*").alias("n"))


def inserts_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(Session(spark), sf_dir, ["nation", "customer"])
    s.sql("CREATE TABLE t (k BIGINT, v TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT INTO t (k) SELECT c_custkey FROM customer; INSERT INTO t SELECT k + 1000000, v FROM t WHERE v IS NOT NULL")
    return s.sql("SELECT k, v FROM t")


def elo_ratings_by_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of one solver that meets each nation once, in order: a sequence that SQL can express."""
    rows = nations(spark, sf_dir)
    attempts = spark.createDataFrame([("s", n, k, k % 3 > 0) for k, n, _ in rows], "solver string, task string, seq long, solved boolean")
    return keep(evals.ratings(attempts), "ratings").where("kind = 'solver'").select("name", F.round("rating", 4).alias("rating"), "attempts")


class Rules:
    """Answers like Ruled, and can be sent to the executors."""

    portable = True

    def complete(self, alias: str, prompt: str) -> Reply:
        return Ruled(RULES).complete(alias, prompt)


def calls_by_executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of a filter made on the executors."""
    s = tables(Session(spark, Rules()), sf_dir, ["part"])
    s.sql(FUNCTIONS)
    return s.sql("SELECT p_partkey FROM part WHERE p_size > 20 AND relevant(p_name)")


class Library:
    """A table of pages (url, html) as the web; pages are read whole."""

    hosts, max_body = ("pages.example",), None

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages

    def fetch(self, url: str) -> tuple[int, str, bytes]:
        return 200, "text/html", self.pages.where(F.col("url") == url).select(F.max("html").cast("binary")).first()[0]

    def fetch_all(self, urls: DataFrame) -> DataFrame:
        pages = self.pages.groupBy("url").agg(F.max("html").cast("binary").alias("body"))  # one for a URL that is there more than once
        return urls.join(pages.withColumns({"status": F.lit(200), "kind": F.lit("text/html")}), "url", "left")

    def search(self, query: str, n: int) -> list[tuple[str, str, str]]:
        return [(f"{query} {k}", r.url, "found") for k, r in enumerate(self.pages.select("url").distinct().orderBy("url").limit(n).collect())]


def web_fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("concat('https://pages.example/', page_id) AS url", "html")
    s = Session(spark, web=Library(pages))
    s.register("urls", pages.select("url"))
    return s.sql("CALL web_fetch(url) FROM (SELECT url FROM urls ORDER BY url)")


def web_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, web=Library(spark.createDataFrame([(f"https://pages.example/{n}", "") for _, n, _ in nations(spark, sf_dir)], "url string, html string")))
    return s.sql("CALL web_search('query', 7)")


class Atlas:
    """A server of tools over the nations."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows

    def tools(self) -> list[dict]:
        return [{"name": "in_region", "args": ["region"], "required": ["region"], "read_only": True}, {"name": "rename", "args": ["name", "to"], "required": ["name", "to"]}]

    def call(self, name: str, args: dict) -> list[str]:
        return [n for _, n, r in self.rows if str(r) == args["region"]] if name == "in_region" else [f"{args['name']} is {args['to']}"]


def server_table_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(Session(spark), sf_dir, ["region"])
    s.connect("atlas", Atlas(nations(spark, sf_dir)))
    return s.sql("SELECT r.r_name, t.text FROM region r CROSS JOIN LATERAL atlas_in_region(CAST(r.r_regionkey AS TEXT)) t")


def server_call_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(Session(spark), sf_dir, ["nation"])
    s.connect("atlas", Atlas([]))
    return s.sql("CALL atlas_rename(n_name, 'N' || CAST(n_nationkey AS TEXT)) FROM (SELECT n_name, n_nationkey FROM nation ORDER BY n_nationkey)")


def documents_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two kinds written from text and read as text."""
    s = tables(Session(spark, workspace=str(new_folder(spark))), sf_dir, ["nation"])
    s.sql("CALL write_file(n_name || '.docx', '# ' || n_name || CHR(10) || CHR(10) || 'In **region** ' || CAST(n_regionkey AS TEXT)) FROM (SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey); "
          "CALL write_file(n_name || '.xlsx', n_name || ',' || CAST(n_regionkey AS TEXT)) FROM (SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey)")
    return s.sql("SELECT f.path, r.text FROM files('*.*') f CROSS JOIN LATERAL read(f.path) r")


def output_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as CSV, JSON and a table."""
    s = tables(Session(spark), sf_dir, ["region"])
    df = s.sql("SELECT r_regionkey AS k, r_name || ', ' || r_name AS n, NULLIF(r_regionkey, 2) AS odd FROM region ORDER BY r_regionkey")
    return spark.createDataFrame([("csv", output.render_csv(df)), ("json", output.to_json(df)), ("rows", str(len(output.render_table(df, 3).split("\n"))))], "form string, text string")


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers read as tasks and orders as attempts at them."""
    tasks = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS STRING) AS id", "'k' AS kind", "c_mktsegment AS generator", "'given' AS source", "0.5D AS dial", "1000D AS difficulty")
    attempts = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "CAST(o_custkey AS STRING) AS task", "CAST(o_orderkey AS STRING) AS run", "o_orderstatus AS solver", "o_totalprice > 350000 AS solved", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'needs_review' ELSE 'judged' END AS detail",
        "o_orderkey % 9 AS calls", "CAST(o_custkey % 13 AS DOUBLE) AS dollars", "1 AS depth", "o_orderkey AS seq", "CAST(o_orderkey AS DOUBLE) AS recorded_at")
    return tasks, attempts


def task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.board(*_tasks(spark, sf_dir)).select("id", "status", "attempts", "last_run")


def tasks_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.trace_tasks(*_tasks(spark, sf_dir)).select("task", "generator", "status", "run", "solver", "solved", "calls")


def generator_dials(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, attempts = _tasks(spark, sf_dir)
    return evals.generator_state(attempts.join(tasks.selectExpr("id AS task", "generator"), "task")).select("generator", "dial", F.round("solve_rate", 6).alias("solve_rate"), "tried", "solved")


def bench_runs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, attempts = _tasks(spark, sf_dir)
    return evals.bench_runs(attempts.withColumns({"run": F.col("solver"), "pack": F.lit("orders"), "mode": F.col("detail")}))


_FUNCTIONS: tuple[Callable, ...] = (files_of_workspace, lines_of_file, grep_of_files, read_of_each_file, search_of_files, skill_and_env, load_typed, context_paragraphs, call_of_each_row, spawn_each, spawn_async_await,
                                    inbox_of_children, calls_in_recursion, calibrate_thresholds, explain_analyze, trace_of_sessions, inserts_appended, elo_ratings_by_recursion, calls_by_executors,
                                    web_fetch_pages, web_search_hits, server_table_tool, server_call_tool, documents_read_back, output_forms, task_board, tasks_traced, generator_dials, bench_runs_report)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}
_EACH = "'each/' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.md'"
_TREE = ("WITH a AS (SELECT n_name AS item FROM nation WHERE n_regionkey = 1), b AS (SELECT item || x AS item FROM a, (VALUES ('a'), ('b')) AS v(x)), c AS (SELECT item || x AS item FROM b, (VALUES ('a'), ('b')) AS v(x)) "
         "SELECT item, CAST(0 AS BIGINT) AS d FROM a UNION ALL SELECT item, CAST(1 AS BIGINT) FROM b UNION ALL SELECT item, CAST(2 AS BIGINT) FROM c")
_ATTEMPTS = ("(SELECT CAST(o_custkey AS VARCHAR) AS task, CAST(o_orderkey AS VARCHAR) AS run, o_orderstatus AS solver, o_totalprice > 350000 AS solved, CASE WHEN o_orderpriority = '1-URGENT' THEN 'needs_review' ELSE 'judged' END AS detail, "
             "o_orderkey % 9 AS calls, CAST(o_custkey % 13 AS DOUBLE) AS dollars, o_orderkey AS seq, CAST(o_orderkey AS DOUBLE) AS recorded_at FROM orders)")
_BOARD = (f"(SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS generator, CASE WHEN n IS NULL THEN 'open' WHEN d = 'needs_review' THEN 'needs_review' WHEN s THEN 'solved' ELSE 'failed' END AS status, coalesce(n, 0) AS attempts, r AS last_run FROM customer "
          f"LEFT JOIN (SELECT task, count(*) AS n, arg_max(run, seq) AS r, arg_max(detail, seq) AS d, bool_or(solved) AS s FROM {_ATTEMPTS} GROUP BY task) AS a ON a.task = CAST(c_custkey AS VARCHAR))")
ORACLES: dict[str, str] = {
    "files_of_workspace": f"SELECT {_EACH} AS path, CAST(length(n_name) * (n_nationkey + 1) AS BIGINT) AS size, 'file' AS kind FROM nation",
    "lines_of_file": "SELECT row_number() OVER (ORDER BY n_nationkey) AS lineno, n_name || ' in ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation QUALIFY lineno BETWEEN 3 AND 20",
    "grep_of_files": "SELECT 'n.txt' AS path, CAST(n_nationkey + 1 AS BIGINT) AS lineno, n_name || ' in ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation WHERE regexp_matches(n_name || ' in ' || CAST(n_regionkey AS VARCHAR), '_1[0-9]? in [02]')",
    "read_of_each_file": f"SELECT {_EACH} AS path, CAST(length(n_name) * (n_nationkey + 1) AS BIGINT) AS n FROM nation",
    "search_of_files": "SELECT 'each/00.md' AS path, CAST(1 AS BIGINT) AS lineno",
    "skill_and_env": "SELECT 'count' AS name, 'built in' AS source, 'Count things.' AS text UNION ALL SELECT 'env', 'none', 'unset'",
    "load_typed": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS k, n_name AS name, CAST(n_regionkey * 2 AS BIGINT) AS r, n_nationkey / 2.0::DOUBLE AS half, n_nationkey > 10 AS big FROM nation",
    "context_paragraphs": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name || chr(10) || 'of ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation",
    "call_of_each_row": "SELECT 'out/' || n_name AS path, n_name || ' ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation",
    "spawn_each": "SELECT n_name, 'helper ' || n_name AS answer, '1' AS turns FROM nation",
    "spawn_async_await": "SELECT n_name, 'helper ' || n_name AS answer FROM nation",
    "inbox_of_children": "SELECT n_name AS text FROM nation",
    "calls_in_recursion": _TREE,
    "calibrate_thresholds": "SELECT 'oracle' AS function, 'proxy' AS proxy, 0.4::DOUBLE AS low, 0.8::DOUBLE AS high, CAST(10 AS BIGINT) AS sample",
    "trace_of_sessions": "SELECT CAST(0 AS INTEGER) AS depth, 'root' AS role, 'final' AS outcome, CAST(1 AS BIGINT) AS n UNION ALL SELECT 1, 'helper', 'final', COUNT(*) FROM nation",
    "inserts_appended": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation UNION ALL SELECT c_custkey, NULL FROM customer UNION ALL SELECT n_nationkey + 1000000, n_name FROM nation",
    "elo_ratings_by_recursion": "WITH RECURSIVE r(i, x) AS (SELECT 0, 1500.0::DOUBLE UNION ALL SELECT i + 1, x + (CASE WHEN i < 10 THEN 48 ELSE 32 END) * ((CASE WHEN i % 3 > 0 THEN 1 ELSE 0 END) - 1 / (1 + pow(10, (1500 - x) / 400))) FROM r WHERE i < 25) "
    "SELECT 's' AS name, round(x, 4) AS rating, CAST(25 AS BIGINT) AS attempts FROM r WHERE i = 25",
    "explain_analyze": "SELECT (SELECT count(*) FROM part WHERE p_size > 20 AND lower(p_name) LIKE '%a%') AS n, "
    "(SELECT CAST(ceil(count(DISTINCT p_name) / 20.0) AS BIGINT) FROM part WHERE p_size > 20) AS calls",
    "calls_by_executors": "SELECT p_partkey FROM part WHERE p_size > 20 AND lower(p_name) LIKE '%a%'",
    "web_fetch_pages": f"SELECT 'https://pages.example/' || CAST(page_id AS VARCHAR) AS url, CAST(200 AS BIGINT) AS status, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM ({html_oracle()})",
    "web_search_hits": "SELECT row_number() OVER (ORDER BY n_name) AS rank, 'query ' || CAST(row_number() OVER (ORDER BY n_name) - 1 AS VARCHAR) AS title, 'https://pages.example/' || n_name AS url, 'found' AS snippet FROM nation QUALIFY rank <= 7",
    "server_table_tool": "SELECT r_name, n_name AS text FROM region JOIN nation ON n_regionkey = r_regionkey",
    "server_call_tool": "SELECT n_name || ' is N' || CAST(n_nationkey AS VARCHAR) AS text FROM nation",
    "documents_read_back": "SELECT n_name || '.docx' AS path, n_name || chr(10) || 'In region ' || CAST(n_regionkey AS VARCHAR) || chr(10) AS text FROM nation UNION ALL "
    "SELECT n_name || '.xlsx', '## Sheet: Sheet1' || chr(10) || n_name || ',' || CAST(n_regionkey AS VARCHAR) || chr(10) || chr(10) FROM nation",
    "output_forms": "SELECT 'csv' AS form, 'k,n,odd' || chr(13) || chr(10) || string_agg(CAST(r_regionkey AS VARCHAR) || ',\"' || r_name || ', ' || r_name || '\",' || CASE WHEN r_regionkey = 2 THEN '' ELSE CAST(r_regionkey AS VARCHAR) END || chr(13) || chr(10), '' ORDER BY r_regionkey) AS text FROM region "
    "UNION ALL SELECT 'json', '[' || string_agg('{\"k\": ' || CAST(r_regionkey AS VARCHAR) || ', \"n\": \"' || r_name || ', ' || r_name || '\", \"odd\": ' || CASE WHEN r_regionkey = 2 THEN 'null' ELSE CAST(r_regionkey AS VARCHAR) END || '}', ', ' ORDER BY r_regionkey) || ']' FROM region UNION ALL SELECT 'rows', '6'",
    "task_board": f"SELECT id, status, attempts, last_run FROM {_BOARD}",
    "tasks_traced": f"SELECT a.task, b.generator, b.status, a.run, a.solver, CASE WHEN a.solved THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS solved, a.calls FROM {_ATTEMPTS} a JOIN {_BOARD} b ON b.id = a.task",
    "generator_dials": f"SELECT generator, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(0.3::DOUBLE + 0.1::DOUBLE * sum(CASE WHEN n < 10 THEN 0 WHEN k / n > 0.7 THEN 1 WHEN k / n < 0.3 THEN -1 ELSE 0 END), 6))) AS dial, round(sum(k) / sum(n), 6) AS solve_rate, CAST(sum(n) AS BIGINT) AS tried, CAST(sum(k) AS BIGINT) AS solved "
    f"FROM (SELECT generator, block, count(*) AS n, sum(solved::INT) AS k FROM (SELECT c_mktsegment AS generator, solved, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY seq) - 1) // 10 AS block FROM {_ATTEMPTS} a JOIN customer ON CAST(c_custkey AS VARCHAR) = a.task) GROUP BY 1, 2) GROUP BY 1",
    "bench_runs_report": f"SELECT solver AS run, 'orders' AS pack, detail AS mode, count(*) AS tasks, CAST(sum(solved::INT) AS BIGINT) AS solved, sum(dollars) AS dollars, min(recorded_at) AS started_at, max(recorded_at) AS finished_at FROM {_ATTEMPTS} GROUP BY 1, 3",
}
