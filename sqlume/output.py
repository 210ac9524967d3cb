"""Relations as text: JSON, CSV and the table form; in files of many parts for large ones."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

WIDEST = 60


def plain(value: object, kind: str) -> object:
    """A value as JSON holds it: JSON text parsed, numbers that JSON lacks as their text."""
    if value is None:
        return None
    if kind == "JSON":
        return json.loads(value)
    if isinstance(value, float) and not math.isfinite(value):
        return shown(value, kind)
    if isinstance(value, list):
        return [plain(v, "DOUBLE") for v in value]
    return value if isinstance(value, (bool, int, float, str)) else str(value)


def shown(value: object, kind: str = "TEXT") -> str:
    """A value as text of a cell."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return {math.inf: "inf", -math.inf: "-inf"}.get(value, "NaN" if value != value else str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value))
    if isinstance(value, list):
        return f"[{len(value)} floats]"
    return str(value)


def _kinds(df: DataFrame, kinds: list[str] | None) -> list[str]:
    return kinds or ["TEXT"] * len(df.columns)


def to_json(df: DataFrame, kinds: list[str] | None = None) -> str:
    """A JSON array of objects with the columns in order; kinds: the columns' types in the dialect, where some are JSON. For results that fit the driver."""
    own = _kinds(df, kinds)
    return json.dumps([{c: plain(v, k) for c, v, k in zip(df.columns, r, own)} for r in df.toLocalIterator()], ensure_ascii=False)


def _field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def render_csv(df: DataFrame) -> str:
    """RFC 4180 with a header; nulls are empty fields. For results that fit the driver."""
    rows = [",".join(map(_field, df.columns))]
    rows += [",".join("" if v is None else _field(shown(v)) for v in r) for r in df.toLocalIterator()]
    return "".join(r + "\r\n" for r in rows)


def render_table(df: DataFrame, max_rows: int = 20) -> str:
    """Columns of even width, cells cut at WIDEST characters; at most max_rows rows and a line that counts the rest."""
    head = [[shown(v) for v in r] for r in df.limit(max_rows + 1).collect()]
    more = df.count() - max_rows if len(head) > max_rows else 0
    head = [[c if len(c) <= WIDEST else c[: WIDEST - 3] + "..." for c in r] for r in head[:max_rows]]
    width = [max(map(len, col)) for col in zip(df.columns, *head)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, width))
    out = [line(df.columns), "-+-".join("-" * w for w in width), *map(line, head)]
    return "\n".join([*out, f"... {more} more rows"] if more else out)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in files of the folder, written by the executors."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files of the folder, each with a header, written by the executors."""
    df.write.option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)
