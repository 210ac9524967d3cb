"""Queries in the dialect over the driver's tables, each with the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlume import evals
from sqlume.calls.providers import Ruled, Scripted
from sqlume.operators import text
from sqlume.session import Session
from sqlume.sources.files import new_folder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_JSON = {"events": ("props",)}

#: name -> (dialect, DuckDB's SQL; None where both are the same text)
SQL: dict[str, tuple[str, str | None]] = {
    "slice_pricing": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, ROUND(AVG(l_discount), 6) AS d FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2", None),
    "filter_project": ("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", None),
    "three_valued_logic": ("SELECT p_partkey, (NULLIF(p_size, 1) > 10) AS gt, (NULLIF(p_size, 1) > 10 OR p_size < 5) AS either, (NULLIF(p_size, 1) > 10 AND p_size < 5) AS both_, NOT (NULLIF(p_size, 1) > 10) AS not_, (NULLIF(p_size, 1) > 10) IS TRUE AS is_true, (NULLIF(p_size, 1) > 10) IS NOT FALSE AS not_false FROM part", None),
    "between_in_case": ("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'mid' ELSE 'big' END AS band, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS word FROM part WHERE p_size NOT BETWEEN 40 AND 45 AND p_brand IS NOT NULL", None),
    "like_ilike": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%' AND p_type ILIKE '%S%' AND p_name NOT LIKE 'z%'", None),
    "cast_matrix": ("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST('7' AS BIGINT) AS i, CAST(' 8 ' AS BIGINT) AS j, CAST('true' AS BOOLEAN) AS b, CAST(o_orderkey AS TEXT) AS t, o_orderkey::DOUBLE / 4 AS q, CAST(FLOOR(o_totalprice) AS BIGINT) AS f FROM orders",
                    "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST('7' AS BIGINT) AS i, CAST(8 AS BIGINT) AS j, CAST('true' AS BOOLEAN) AS b, CAST(o_orderkey AS VARCHAR) AS t, o_orderkey::DOUBLE / 4 AS q, CAST(FLOOR(o_totalprice) AS BIGINT) AS f FROM orders"),
    "div_by_zero": ("SELECT p_partkey, (p_size - 10) / (p_size % 2) AS q FROM part WHERE p_size % 2 = 0 OR p_size > 5",
                    "SELECT p_partkey, CAST(p_size - 10 AS DOUBLE) / CAST(p_size % 2 AS DOUBLE) AS q FROM part WHERE p_size % 2 = 0 OR p_size > 5"),
    "mod_try": ("SELECT p_partkey, p_partkey % (p_size - 5) AS m, MOD(p_partkey, 7) AS k, (0 - p_partkey) % 3 AS neg FROM part",
                "SELECT p_partkey, CASE WHEN p_size = 5 THEN NULL ELSE p_partkey % CASE WHEN p_size = 5 THEN 1 ELSE p_size - 5 END END AS m, p_partkey % 7 AS k, (0 - p_partkey) % 3 AS neg FROM part"),
    "string_builtins": ("SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, REPLACE(p_name, 'a', 'A') AS r, REVERSE(p_name) AS v, p_name || '-' || p_brand AS c, CONCAT(p_name, NULL, p_size) AS k, STARTS_WITH(p_name, 'a') AS s, CONTAINS(p_name, 'e') AS h FROM part", None),
    "substr_edges": ("SELECT p_partkey, SUBSTR(p_name, 0, 3) AS a, SUBSTR(p_name, 2) AS b, SUBSTR(p_name, 2, 3) AS c, SUBSTR(p_name, -1, 4) AS d, SUBSTRING(p_name FROM 3 FOR 2) AS e, SUBSTR(p_name, 200, 2) AS f FROM part",
                     "SELECT p_partkey, SUBSTR(p_name, 1, 2) AS a, SUBSTR(p_name, 2) AS b, SUBSTR(p_name, 2, 3) AS c, SUBSTR(p_name, 1, 2) AS d, SUBSTR(p_name, 3, 2) AS e, '' AS f FROM part"),
    "pad_repeat_reverse": ("SELECT p_partkey, LPAD(p_brand, 12, '*') AS a, RPAD(p_brand, 3, '*') AS b, LPAD(CAST(p_partkey AS TEXT), 6) AS c, REPEAT('ab', p_size % 4) AS d, REVERSE(p_brand) AS e FROM part",
                           "SELECT p_partkey, LPAD(p_brand, 12, '*') AS a, RPAD(p_brand, 3, '*') AS b, LPAD(CAST(p_partkey AS VARCHAR), 6, ' ') AS c, REPEAT('ab', p_size % 4) AS d, REVERSE(p_brand) AS e FROM part"),
    "chr_ascii": ("SELECT p_partkey, CHR(65 + p_size % 26) AS c, CHR(12354 + p_size % 20) AS k, ASCII(p_name) AS a FROM part",
                  "SELECT p_partkey, CHR(CAST(65 + p_size % 26 AS INTEGER)) AS c, CHR(CAST(12354 + p_size % 20 AS INTEGER)) AS k, CAST(ASCII(p_name) AS BIGINT) AS a FROM part"),
    "trim_whitespace": ("SELECT n_nationkey, TRIM('  ' || n_name || '  ') AS t, LTRIM('  ' || n_name) AS l, RTRIM(n_name || '  ') AS r, TRIM(LEADING ' x') AS x FROM nation",
                        "SELECT n_nationkey, n_name AS t, n_name AS l, n_name AS r, 'x' AS x FROM nation"),
    "split_part_strpos": ("SELECT event_id, SPLIT_PART(props, ':', 2) AS a, SPLIT_PART(props, '!', 1) AS b, SPLIT_PART(props, ':', 9) AS c, STRPOS(props, 'k') AS p, STRPOS(event_type, 'zz') AS z FROM events", None),
    "left_right_negative": ("SELECT n_nationkey, LEFT(n_name, 2) AS a, LEFT(n_name, -2) AS b, RIGHT(n_name, 2) AS c, RIGHT(n_name, -2) AS d FROM nation", None),
    "null_functions": ("SELECT p_partkey, COALESCE(NULLIF(p_size, 3), -1) AS a, NULLIF(p_brand, 'x') AS b, COALESCE(NULL, p_name) AS c FROM part", None),
    "greatest_least": ("SELECT p_partkey, GREATEST(p_size, 25, NULL) AS g, LEAST(p_size, 25) AS l, GREATEST(p_retailprice, p_size) AS m FROM part", None),
    "round_floor_ceil": ("SELECT p_partkey, ROUND(p_retailprice, 1) AS r, ROUND(p_retailprice) AS s, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, ABS(0 - p_retailprice) AS a, ROUND(p_size, 2) AS i FROM part",
                         "SELECT p_partkey, ROUND(p_retailprice, 1) AS r, ROUND(p_retailprice) AS s, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, ABS(0 - p_retailprice) AS a, p_size AS i FROM part"),
    "json_paths": ("SELECT event_id, JSON_EXTRACT_STRING(props, '$.k') AS k, CAST(JSON_EXTRACT_STRING(props, 'k') AS BIGINT) + 1 AS n, JSON_EXTRACT_STRING(props, '$.none') AS m FROM events",
                   "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS n, json_extract_string(props, '$.none') AS m FROM events"),
    "json_extract_typed": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS j, JSON_EXTRACT(props, 'none') AS m, JSON_EXTRACT('{\"a\": [1, {\"b\": \"x\"}]}', 'a[1]') AS n FROM events",
                           "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS j, CAST(NULL AS VARCHAR) AS m, '{\"b\":\"x\"}' AS n FROM events"),
    "order_of_union": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey + 100 FROM supplier ORDER BY k DESC", None),
    "order_of_values": ("SELECT v.k, v.t FROM (VALUES (3, 'c'), (1, NULL), (2, 'b')) AS v(k, t) ORDER BY t DESC, k", "SELECT k, t FROM (VALUES (3, 'c'), (1, NULL), (2, 'b')) AS v(k, t) ORDER BY t DESC NULLS FIRST, k"),
    "group_having": ("SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "group_by_ordinal_alias": ("SELECT UPPER(o_orderstatus) AS st, o_orderpriority AS pr, COUNT(*) AS n FROM orders GROUP BY st, 2", None),
    "global_agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS m, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey < 0", None),
    "group_agg_empty": ("SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_custkey", None),
    "count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey) AS s, COUNT(o_custkey) AS n FROM orders GROUP BY o_orderstatus",
                       "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s, COUNT(o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "string_agg_ordered": ("SELECT n_regionkey, STRING_AGG(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", None),
    "bool_aggs": ("SELECT p_brand, BOOL_AND(p_size > 1) AS a, BOOL_OR(p_size > 49) AS o FROM part GROUP BY p_brand", None),
    "min_max_bool": ("SELECT p_brand, MIN(p_size > 25) AS lo, MAX(p_size > 25) AS hi, MIN(p_name) AS a, MAX(p_name) AS z FROM part GROUP BY p_brand", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "union_set": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "order_nulls_all_rows": ("SELECT p_partkey, NULLIF(p_size, 7) AS s FROM part ORDER BY s DESC, p_partkey", "SELECT p_partkey, NULLIF(p_size, 7) AS s FROM part ORDER BY s DESC NULLS FIRST, p_partkey"),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "order_hidden_column_all_rows": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey", None),
    "inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0", None),
    "left_join_nulls": ("SELECT c.c_custkey, COUNT(o.o_orderkey) AS n, MAX(o.o_totalprice) AS top FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey", None),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "theta_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "three_way_join": ("SELECT r.r_name, n.n_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2", None),
    "exists_semi": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "not_exists_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "not_in_null": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region)", None),
    "not_in_empty": ("SELECT n_nationkey, NULLIF(n_regionkey, 1) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 100) AS t FROM nation", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", None),
    "correlated_scalar": ("SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c", None),
    "two_level_correlation": ("SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000))", None),
    "values_alias": ("SELECT v.a + 1 AS b, v.t FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, t)", None),
    "nested_ctes": ("WITH a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey), b AS (SELECT k, n FROM a WHERE n > 10) SELECT n.n_name, b.n FROM b JOIN nation n ON n.n_nationkey = b.k", None),
    "cte_in_subquery": ("WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)", None),
    "generate_series_plain": ("SELECT g.generate_series AS n FROM generate_series(3, 20, 4) g UNION ALL SELECT h.generate_series FROM generate_series(5, 1, -2) h",
                              "SELECT unnest(generate_series(3, 20, 4)) AS n UNION ALL SELECT unnest(generate_series(5, 1, -2))"),
    "generate_series_lateral": ("SELECT n.n_nationkey, g.i FROM nation n CROSS JOIN LATERAL generate_series(1, n.n_regionkey) AS g(i)",
                                "SELECT n_nationkey, unnest(generate_series(1, CAST(n_regionkey AS BIGINT))) AS i FROM nation"),
    "parenthesised_join": ("SELECT a.n_name, b.r_name FROM (nation a JOIN region b ON a.n_regionkey = b.r_regionkey) WHERE b.r_regionkey > 1", None),
    "select_star_alias": ("SELECT r.*, n.n_name FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey", None),
    "closure_set": ("WITH RECURSIVE up(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT u.a, n.n_regionkey FROM up u JOIN nation n ON n.n_nationkey = u.b) SELECT a, b FROM up", None),
    "bounded_paths_bag": ("WITH RECURSIVE w(a, b, d) AS (SELECT n_nationkey, n_regionkey, 1 FROM nation UNION ALL SELECT w.a, n.n_regionkey, w.d + 1 FROM w JOIN nation n ON n.n_nationkey = w.b WHERE w.d < 4) SELECT a, b, d FROM w", None),
    "shortest_hops": ("WITH RECURSIVE h(k, d) AS (SELECT 24, 0 UNION SELECT n.n_regionkey, h.d + 1 FROM h JOIN nation n ON n.n_nationkey = h.k WHERE h.d < 6) SELECT k, MIN(d) AS hops FROM h GROUP BY k",
                      "WITH RECURSIVE h(k, d) AS (SELECT 24, 0 UNION SELECT n.n_regionkey, h.d + 1 FROM h JOIN nation n ON n.n_nationkey = h.k WHERE h.d < 6) SELECT CAST(k AS BIGINT) AS k, CAST(MIN(d) AS BIGINT) AS hops FROM h GROUP BY k"),
    "chunks_documents": ("SELECT d.doc_id, c.ordinal, LENGTH(c.text) AS n, c.tokens FROM documents d CROSS JOIN LATERAL chunks(d.text, 500, 50) c",
                             "WITH RECURSIVE w AS (SELECT doc_id, CAST(0 AS BIGINT) AS ordinal, text AS rest, CASE WHEN length(text) > 500 AND strpos(substr(text, 401, 100), chr(10)) > 0 THEN 500 - length(string_split(substr(text, 401, 100), chr(10))[-1]) ELSE least(500, length(text)) END AS n FROM documents WHERE length(text) > 0 "
                             "UNION ALL SELECT doc_id, ordinal + 1, r, CASE WHEN length(r) > 500 AND strpos(substr(r, 401, 100), chr(10)) > 0 THEN 500 - length(string_split(substr(r, 401, 100), chr(10))[-1]) ELSE least(500, length(r)) END FROM (SELECT doc_id, ordinal, substr(rest, n - 49) AS r FROM w WHERE n < length(rest)) AS t) "
                             "SELECT doc_id, ordinal, n, CAST(ceil(n / 4.0) AS BIGINT) AS tokens FROM w"),
    "conversation_digest": ("SELECT conv_id, COUNT(*) AS turns, STRING_AGG(role || ':' || CAST(LENGTH(text) AS TEXT), ' ' ORDER BY turn, role, LENGTH(text)) AS shape FROM conversations GROUP BY conv_id",
                            "SELECT conv_id, COUNT(*) AS turns, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ' ' ORDER BY turn, role, length(text)) AS shape FROM conversations GROUP BY conv_id"),
    "label_join": ("SELECT d.lang, COUNT(*) AS n, SUM(l.toxic) AS toxic, SUM(l.quality) AS good FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang",
                   "SELECT d.lang, COUNT(*) AS n, CAST(SUM(l.toxic) AS BIGINT) AS toxic, CAST(SUM(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang"),
    "event_types": ("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(SUM(value), 4) AS total FROM events GROUP BY event_type", None),
    "top_customers": ("SELECT c.c_custkey, c.c_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c.c_custkey LIMIT 20", None),
}


def tables(session: Session, sf_dir: str, names: list[str] = TABLES) -> Session:
    for t in names:
        session.register(t, session.spark.read.parquet(f"{sf_dir}/{t}.parquet"), json_columns=_JSON.get(t, ()))
    return session


def _sql(body: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
        return tables(Session(spark), sf_dir, used).sql(body)

    return run


# calls, answered by pure rules of their arguments so that SQL can say the same

RULES = {
    "relevant": lambda a: "a" in a["name"].lower(),
    "matches": lambda a: (int(a["x"].rpartition("_")[2]) + len(a["y"])) % 7 == 0,
    "size_of": lambda a: len(a["name"]),
    "ratio": lambda a: len(a["name"]) / 4,
    "shout": lambda a: a["name"].upper(),
    "score": lambda a: min(1.0, len(a["name"]) / 20),
    "long_name": lambda a: len(a["name"]) >= 10,
}
FUNCTIONS = """
CREATE FUNCTION relevant(name TEXT) RETURNS BOOLEAN AS PROMPT 'Does {name} hold an a?';
CREATE FUNCTION matches(x TEXT, y TEXT) RETURNS BOOLEAN AS PROMPT 'Does {x} belong with {y}?';
CREATE FUNCTION size_of(name TEXT) RETURNS BIGINT AS PROMPT 'Length of {name}?';
CREATE FUNCTION ratio(name TEXT) RETURNS DOUBLE AS PROMPT 'A quarter of the length of {name}?';
CREATE FUNCTION shout(name TEXT) RETURNS TEXT AS PROMPT 'Capitals of {name}?';
CREATE FUNCTION score(name TEXT) RETURNS DOUBLE AS PROMPT 'How long is {name}, from 0 to 1?' MODEL 'proxy';
CREATE FUNCTION long_name(name TEXT) RETURNS BOOLEAN AS PROMPT 'Is {name} long?' PROXY score THRESHOLDS (0.4, 0.6);
CREATE FUNCTION doubled(n BIGINT) RETURNS BIGINT AS SQL (n * 2);
"""
CALLS: dict[str, tuple[str, str]] = {
    "prompt_filter": ("SELECT p_partkey FROM part WHERE p_size > 20 AND relevant(p_name)", "SELECT p_partkey FROM part WHERE p_size > 20 AND lower(p_name) LIKE '%a%'"),
    "prompt_project_typed": ("SELECT p_partkey, relevant(p_name) AS b, size_of(p_name) AS i, ratio(p_name) AS d, shout(p_name) AS t FROM part", "SELECT p_partkey, lower(p_name) LIKE '%a%' AS b, length(p_name) AS i, length(p_name) / 4.0::DOUBLE AS d, upper(p_name) AS t FROM part"),
    "call_in_join": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND matches(n.n_name, r.r_name)", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND (CAST(split_part(n.n_name, '_', 2) AS BIGINT) + length(r.r_name)) % 7 = 0"),
    "call_in_left_join": ("SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND matches(n.n_name, r.r_name)", "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND (CAST(split_part(n.n_name, '_', 2) AS BIGINT) + length(r.r_name)) % 7 = 0"),
    "call_in_group_key": ("SELECT size_of(n_name) AS k, COUNT(*) AS n FROM nation GROUP BY size_of(n_name)", "SELECT length(n_name) AS k, COUNT(*) AS n FROM nation GROUP BY 1"),
    "cascade_filter": ("SELECT p_partkey, p_name FROM part WHERE long_name(p_name)", "SELECT p_partkey, p_name FROM part WHERE length(p_name) >= 12 OR (length(p_name) >= 8 AND length(p_name) >= 10)"),
    "semi_join_refute": ("SELECT n.n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE matches(n.n_name, r.r_name))", "SELECT n.n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE (CAST(split_part(n.n_name, '_', 2) AS BIGINT) + length(r.r_name)) % 7 = 0)"),
    "call_or_pure": ("SELECT p_partkey FROM part WHERE p_size = 1 OR relevant(p_name)", "SELECT p_partkey FROM part WHERE p_size = 1 OR lower(p_name) LIKE '%a%'"),
    "call_in_case": ("SELECT n_name, CASE WHEN n_regionkey < 2 THEN shout(n_name) ELSE 'no' END AS c FROM nation", "SELECT n_name, CASE WHEN n_regionkey < 2 THEN upper(n_name) ELSE 'no' END AS c FROM nation"),
    "call_in_order_all_rows": ("SELECT n_name FROM nation ORDER BY size_of(n_name) DESC, n_name", "SELECT n_name FROM nation ORDER BY length(n_name) DESC, n_name"),
    "join_order_calls": ("SELECT r.r_name, n.n_name, s.s_suppkey FROM region r, nation n, supplier s WHERE relevant(r.r_name) AND matches(n.n_name, r.r_name) AND n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey",
                         "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r, nation n, supplier s WHERE lower(r.r_name) LIKE '%a%' AND (CAST(split_part(n.n_name, '_', 2) AS BIGINT) + length(r.r_name)) % 7 = 0 AND n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey"),
    "sql_function": ("SELECT n_nationkey, doubled(n_nationkey) AS d FROM nation", "SELECT n_nationkey, n_nationkey * 2 AS d FROM nation"),
}


def call_session(spark: SparkSession, sf_dir: str, names: list[str]) -> Session:
    session = tables(Session(spark, Ruled(RULES)), sf_dir, names)
    session.sql(FUNCTIONS)
    return session


def _call(body: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: call_session(spark, sf_dir, ["region", "nation", "supplier", "part"]).sql(body)


def statements_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS, INSERT, DROP and FINAL in one script."""
    s = tables(Session(spark), sf_dir, ["nation"])
    s.sql("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = 1; INSERT INTO t (k) VALUES (100), (101); "
          "CREATE TABLE gone (x BIGINT); DROP TABLE gone; DROP TABLE IF EXISTS gone; FINAL SELECT k, COALESCE(v, 'none') AS v FROM t")
    return s.answer


def beam_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam: the best three new rows of each round."""
    s = tables(Session(spark), sf_dir, ["nation"])
    return s.sql("WITH RECURSIVE b(k, s, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL "
                 "SELECT n.n_nationkey, b.s + n.n_nationkey, b.d + 1 FROM b CROSS JOIN nation n WHERE b.d < 3 ORDER BY 2 DESC, 1 DESC LIMIT 3) SELECT k, s, d FROM b")


def max_rounds_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(Session(spark), sf_dir, ["nation"])
    return s.sql("SET max_recursion_rounds = 5; WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c) SELECT n FROM c")


def explain_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_session(spark, sf_dir, ["region", "nation", "supplier", "part"]).sql("EXPLAIN SELECT n_name FROM nation WHERE long_name(n_name) AND n_regionkey > 0")


def memo_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run of a query makes no calls: the trace says so."""
    s = call_session(spark, sf_dir, ["region", "nation", "supplier", "part"])
    for _ in range(2):
        s.sql("SELECT n_name, relevant(n_name) AS r FROM nation").collect()
    return s.system("trace_calls").groupBy("function", "memo").count().withColumnRenamed("count", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _sql(dialect) for name, (dialect, _) in SQL.items()},
    **{name: _call(dialect) for name, (dialect, _) in CALLS.items()},
    **{f.__name__: f for f in (statements_cycle, beam_top_k, max_rounds_cap, explain_calls, memo_second_run)},
}
#: Columns that DuckDB types as INTEGER and the dialect, which has one integer type, as BIGINT.
_BIGINT = {
    "trim_whitespace": "n_nationkey", "left_right_negative": "n_nationkey", "null_functions": "a", "greatest_least": "g l", "round_floor_ceil": "i", "string_agg_ordered": "n_regionkey",
    "union_set": "k", "union_all": "k", "order_nulls_all_rows": "s", "not_in_null": "n_nationkey", "not_in_empty": "n_nationkey", "values_alias": "b", "generate_series_lateral": "n_nationkey",
    "order_of_union": "k", "order_of_values": "k", "select_star_alias": "r_regionkey", "closure_set": "a b", "bounded_paths_bag": "a b d", "sql_function": "n_nationkey d",
}


def _typed(name: str, sql: str) -> str:
    wide = _BIGINT.get(name)
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in wide.split())}) FROM ({sql})" if wide else sql


_ORACLES: dict[str, str] = {
    **{name: other or dialect for name, (dialect, other) in SQL.items()},
    **{name: other for name, (_, other) in CALLS.items()},
    "statements_cycle": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation WHERE n_regionkey = 1 UNION ALL VALUES (100, 'none'), (101, 'none')",
    "beam_top_k": "WITH b0 AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM nation WHERE n_nationkey < 3), "
    + ", ".join(f"b{i} AS (SELECT CAST(n_nationkey AS BIGINT) AS k, b.s + n_nationkey AS s, CAST({i} AS BIGINT) AS d FROM b{i - 1} b, nation ORDER BY 2 DESC, 1 DESC LIMIT 3)" for i in (1, 2, 3))
    + " SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3",
    "explain_calls": "SELECT unnest(['plan [FO]: 2 calls, 825 tokens, $0.0030', '  Project (rows 6.25)', '    Project (rows 6.25)', "
    "'      Filter ((#3 >= 0.6) OR ((#3 >= 0.4) AND long_name(#1))) [λ worker] (rows 6.25, calls 1, tokens 750, $0.0027)', '        Project [λ proxy] (rows 12.5, calls 1, tokens 75, $0.0003)', "
    "'          Filter (#2 > 0) (rows 12.5)', '            Scan nation (rows ' || (SELECT count(*) FROM nation) || ')', 'rules: cascade']) AS plan",
    "max_rounds_cap": "SELECT unnest(generate_series(1, 6)) AS n",
    "memo_second_run": "SELECT 'relevant' AS function, false AS memo, CAST(ceil(COUNT(DISTINCT n_name) / 20.0) AS BIGINT) AS n FROM nation UNION ALL SELECT 'relevant', true, CAST(ceil(COUNT(DISTINCT n_name) / 20.0) AS BIGINT) FROM nation",
}
ORACLES: dict[str, str] = {name: _typed(name, sql) for name, sql in _ORACLES.items()}


# text relations and evaluation reports over the driver's tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr("doc_id", "lineno", "line")


def grep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.grep(_read(spark, sf_dir, "documents").select("doc_id", "text"), "the .* and")


def paragraphs_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.paragraphs(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bm25(_read(spark, sf_dir, "documents"), "with their the", "doc_id", n=20)


def html_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as attempts: a status is a run, a priority a mode."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus AS run", "'orders' AS pack", "o_orderpriority AS mode", "o_orderkey AS seq", "concat('t', o_custkey % 7) AS task", "o_totalprice > 150000 AS solved",
        "o_orderkey % 9 AS calls", "o_orderkey % 1000 AS tokens", "CAST(o_custkey % 13 AS DOUBLE) AS dollars", "o_orderkey % 5000 AS wall_ms")


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.report(_evals(spark, sf_dir)).select("pack", "mode", "tasks", "solved", *[F.round(c, 6).alias(c) for c in ("accuracy", "calls_per_task", "tokens_per_task", "dollars_per_task")])


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.learning_curve(_evals(spark, sf_dir), 10).select("run", "seq", F.round("rate", 6).alias("rate"))


def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.pareto(_evals(spark, sf_dir)).select("mode", "solved")


def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.ratings(_evals(spark, sf_dir).withColumnRenamed("run", "solver"))


def html_oracle() -> str:
    """The steps of html_text as nested replacements; the given pages hold named entities only."""
    x = "html"
    for pattern, to in ((r"(?s)<!--.*?(-->|\z)", ""), (r"(?is)<script\b[^>]*>.*?(</script\s*>|\z)", "\n"), (r"(?is)<style\b[^>]*>.*?(</style\s*>|\z)", "\n"),
                        (rf"(?is)</?({'|'.join(text.BLOCKS)})\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " ")):
        x = f"regexp_replace({x}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    for name, to in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{to}')"
    return f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda r: trim(regexp_replace(r, '\\s+', ' ', 'g'))), lambda r: r <> ''), chr(10)) AS text FROM pages"


_ATTEMPTS = ("(SELECT o_orderstatus AS run, 'orders' AS pack, o_orderpriority AS mode, o_orderkey AS seq, o_totalprice > 150000 AS solved, o_orderkey % 9 AS calls, "
             "o_orderkey % 1000 AS tokens, CAST(o_custkey % 13 AS DOUBLE) AS dollars FROM orders)")
_TEXT = (lines_documents, grep_documents, paragraphs_conversations, bm25_documents, html_text_pages, eval_report, learning_curve, pareto, elo_ratings)
QUERIES |= {f.__name__: f for f in _TEXT}
_LINES = "SELECT doc_id, CAST(i AS BIGINT) AS lineno, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''))"
_TERMS = ("the", "their", "with")
ORACLES |= {
    "lines_documents": _LINES,
    "grep_documents": f"SELECT * FROM ({_LINES}) WHERE regexp_matches(line, 'the .* and')",
    "bm25_documents": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents), "
    f"d AS (SELECT doc_id, len(w) AS n, {', '.join(f'''len(list_filter(w, lambda x: x = '{t}')) AS t{i}''' for i, t in enumerate(_TERMS))} FROM w), "
    f"s AS (SELECT count(*) AS c, avg(n) AS m, {', '.join(f'count(*) FILTER (t{i} > 0) AS f{i}' for i in range(3))} FROM d) "
    f"SELECT doc_id, round(x, 3) AS score FROM (SELECT doc_id, {' + '.join(f'ln((c - f{i} + 0.5) / (f{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / m))' for i in range(3))} AS x FROM d, s WHERE t0 + t1 + t2 > 0) ORDER BY x DESC, doc_id LIMIT 20",
    "paragraphs_conversations": "SELECT conv_id, turn, i - 1 AS ordinal, p[i] AS paragraph FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn, "
    "list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n[ \\t]*\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM conversations))",
    "html_text_pages": html_oracle(),
    "eval_report": f"SELECT pack, mode, count(*) AS tasks, CAST(sum(solved::INT) AS BIGINT) AS solved, round(avg(solved::INT), 6) AS accuracy, round(avg(calls), 6) AS calls_per_task, round(avg(tokens), 6) AS tokens_per_task, round(avg(dollars), 6) AS dollars_per_task FROM {_ATTEMPTS} GROUP BY 1, 2",
    "learning_curve": f"SELECT run, seq, round(avg(solved::INT) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM {_ATTEMPTS}",
    "pareto": f"WITH r AS (SELECT mode, CAST(sum(solved::INT) AS BIGINT) AS solved, avg(solved::INT) AS a, avg(dollars) AS c FROM {_ATTEMPTS} GROUP BY 1) SELECT mode, solved FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.c <= r.c AND o.a >= r.a AND (o.c < r.c OR o.a > r.a))",
}


# calls that make rows, built-in calls, delegation, workspace files and judged answers, over the nations


def _nations(spark: SparkSession, sf_dir: str, **options) -> Session:
    return tables(Session(spark, **options), sf_dir, ["nation"])


def _two_forms(prompt: str) -> str:
    name = prompt.split("\n")[0]
    return json.dumps([name.lower(), name.upper(), name])


def expand_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir, provider=Scripted(default=_two_forms)).sql("SELECT n.n_name, e.item FROM nation n CROSS JOIN LATERAL expand(n.n_name, 2) AS e")


def builtin_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def reply(prompt: str) -> str:
        name = prompt.split("\n")[0]
        return json.dumps({"n": len(name)}) if "schema" in prompt else json.dumps({"answer": name[-1] in "02468"}) if "true" in prompt else name.upper()

    return _nations(spark, sf_dir, provider=Scripted(default=reply)).sql(
        "SELECT n_name, llm(n_name) AS t, llm_bool(n_name) AS b, CAST(json_extract_string(llm_json(n_name, '{\"n\": \"number\"}'), '$.n') AS BIGINT) AS n FROM nation")


def delegation_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir, runner=lambda child, role, task: (f"{child.depth} {task}", {"turns": 1}))
    return s.sql("SELECT n.n_name, r.answer FROM nation n CROSS JOIN LATERAL rlm(n.n_name) r")


def csv_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations written to files of a workspace and read as records."""
    top = new_folder(spark)  # records are read on the driver when the statement is planned
    rows = [(r.n_nationkey, r.n_name) for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    (top / "n.csv").write_text("key,name\r\n" + "".join(f'{k},"{n}"\r\n' for k, n in rows))
    (top / "n.json").write_text("\n".join(json.dumps({"key": k, "name": n}) for k, n in rows))
    s = Session(spark, workspace=str(top))
    return s.sql("SELECT 'csv' AS kind, row AS line, json_extract_string(record, '$.key') AS k, json_extract_string(record, 'name') AS v FROM read_csv('n.csv') "
                 "UNION ALL SELECT 'json', row, json_extract_string(record, '$.key'), json_extract_string(record, 'name') FROM read_json('n.json')")


def exact_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    bag = s.sql("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
    same = s.sql("SELECT n_regionkey + 0.0 AS r, COUNT(n_name) AS c FROM nation GROUP BY n_regionkey ORDER BY 1 DESC")
    return spark.createDataFrame([(evals.exact(bag, same), evals.exact(bag, same.limit(4)))], "equal boolean, shorter boolean")


QUERIES |= {f.__name__: f for f in (expand_lateral, builtin_calls, delegation_all_nations, csv_json_records, exact_oracle)}
ORACLES |= {
    "expand_lateral": "SELECT n_name, unnest([lower(n_name), upper(n_name)]) AS item FROM nation",
    "builtin_calls": "SELECT n_name, upper(n_name) AS t, CAST(right(n_name, 1) AS INTEGER) % 2 = 0 AS b, length(n_name) AS n FROM nation",
    "delegation_all_nations": "SELECT n_name, '1 ' || n_name AS answer FROM nation",
    "csv_json_records": "SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n_nationkey) AS line, CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation, (VALUES ('csv'), ('json')) AS t(kind)",
    "exact_oracle": "SELECT true AS equal, false AS shorter",
}
