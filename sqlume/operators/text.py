"""Text relations as plain DataFrame operations: lines, paragraphs, grep, BM25 search, and text of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BLOCKS = ("address article aside blockquote br dd div dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table title tr ul").split()


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line: df's columns but the text, then lineno (from 1) and line."""
    rest = [c for c in df.columns if c != text]
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*rest, F.posexplode(F.split(body, r"\r?\n")).alias("_pos", "line")).select(*rest, (F.col("_pos") + 1).cast("long").alias("lineno"), "line")


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each part between blank lines that is not blank: df's other columns, ordinal (from 0) and paragraph."""
    rest = [c for c in df.columns if c != text]
    parts = F.filter(F.transform(F.split(F.col(text), r"\r?\n[ \t]*\r?\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return df.select(*rest, F.posexplode(parts).alias("_pos", "paragraph")).select(*rest, F.col("_pos").cast("long").alias("ordinal"), "paragraph")


def grep(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """The lines that a regular expression matches."""
    # texts without any match are dropped before they are split; (?m) keeps anchors on lines
    return lines(df.where(F.col(text).rlike(f"(?m){pattern}")), text).where(F.col("line").rlike(pattern))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def _count(array: str, word: str) -> Column:
    return F.size(F.filter(array, lambda x: x == F.lit(word)))


def bm25(df: DataFrame, query: str, id_col: str, text: str = "text", n: int = 10) -> DataFrame:
    """The n best documents for a query's words: (id, score rounded to 3 places); ties by id.

    One pass makes a row of counts for each document, with the query's words only; the corpus statistics are one row of
    sums, so nothing is shuffled but partial sums and the top n.
    """
    terms = sorted(set(_query_words(query)))
    if not terms:
        raise ValueError("the query has no words")
    words = _words(F.coalesce(F.col(text), F.lit("")))
    docs = df.select(F.col(id_col).alias("id"), words.alias("w")).select(
        "id", F.size("w").alias("len"), *[_count("w", t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    scored = docs.crossJoin(F.broadcast(stats))  # a single row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, seen = F.col(f"t{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - seen + 0.5) / (seen + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = scored.where(" or ".join(f"t{i} > 0" for i in range(len(terms)))).select("id", score.alias("s"))
    return hits.orderBy(F.col("s").desc(), "id").limit(n).select(F.col("id").alias(id_col), F.round("s", 3).alias("score"))


def _query_words(query: str) -> list[str]:
    import re

    return [w.lower() for w in re.findall(r"\w+", query)]


_ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|nbsp|amp);"


def _character(e: Column) -> Column:
    """What an entity stands for: six names and all numbers of characters; others stay as they are."""
    digits = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.substring(e, F.lit(4), F.length(e) - 4), 16, 10)).when(F.substring(e, 2, 1) == "#", F.substring(e, F.lit(3), F.length(e) - 3))
    n = digits.cast("bigint")
    valid = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    out = F.when(F.substring(e, 2, 1) == "#", F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(e))
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = out.when(e == f"&{name};", F.lit(value))
    return out


def html_text(html: Column) -> Column:
    """Text of HTML: comments gone, scripts and styles and block tags as line ends, other tags as spaces, entities decoded once."""
    x = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    x = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?(</\1\s*>|\z)", "\n")
    x = F.regexp_replace(x, rf"(?is)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    between, found = F.split(x, _ENTITY, -1), F.concat(F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(0)), F.array(F.lit("")))
    x = F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.when(e == "", "").otherwise(_character(e)))), "")
    rows = F.filter(F.transform(F.split(x, "\n"), lambda r: F.trim(F.regexp_replace(r, r"\s+", " "))), lambda r: r != "")
    return F.array_join(rows, "\n")
