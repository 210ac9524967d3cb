"""Pure table functions as Spark SQL: generate_series and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MAX_SERIES = 10_000_000


def series(args: list[str]) -> str:
    """An array of the series' values; none for a null, an error for a step of zero or too many values."""
    a, b = args[:2]
    s = args[2] if len(args) > 2 else "1L"
    none = "CAST(array() AS ARRAY<BIGINT>)"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {s} IS NULL THEN {none} WHEN {s} = 0 THEN raise_error('generate_series: the step is zero') "
            f"WHEN ({s} > 0 AND {a} > {b}) OR ({s} < 0 AND {a} < {b}) THEN {none} "
            f"WHEN ({b} - {a}) div {s} >= {MAX_SERIES} THEN raise_error('generate_series: over {MAX_SERIES} rows') ELSE sequence({a}, {b}, {s}) END)")


def chunk(text: str, size: int, overlap: int = 0) -> list[tuple[int, str, int]]:
    """Windows of size characters; one ends after the last newline in its final fifth, where there is one."""
    if size <= 0:
        raise ValueError(f"chunks: size must be positive, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"chunks: overlap must be between 0 and size - 1, got {overlap}")
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = text.rfind("\n", end - max(1, size // 5), end)
            if cut >= at:
                end = cut + 1
        out.append((len(out), text[at:end], -(-(end - at) // 4)))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def register(spark: SparkSession) -> None:
    @F.pandas_udf("array<struct<ordinal:bigint,text:string,tokens:bigint>>")
    def sqlume_chunks(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([[{"ordinal": o, "text": x, "tokens": n} for o, x, n in chunk(t, int(s), int(k))] if t and not pd.isna(s) else [] for t, s, k in zip(text, size, overlap)])

    spark.udf.register("sqlume_chunks", sqlume_chunks)
