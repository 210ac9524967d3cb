"""Tools with effects: run by CALL, one row after the other, never more than once for a row."""

from __future__ import annotations

import difflib
import json
import re
import subprocess
import time
from collections.abc import Iterable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from sqlume.errors import SqlError
from sqlume.operators.text import BLOCKS
from sqlume.sources import convert
from sqlume.sources.files import Workspace

#: name -> (argument types, least arguments, result columns)
TOOLS: dict[str, tuple[tuple[str, ...], int, tuple]] = {
    "write_file": (("TEXT", "TEXT"), 2, (("path", "TEXT"), ("bytes", "BIGINT"))),
    "append_file": (("TEXT", "TEXT"), 2, (("path", "TEXT"), ("bytes", "BIGINT"))),
    "patch": (("TEXT", "TEXT", "TEXT"), 3, (("path", "TEXT"), ("replaced", "BIGINT"), ("diff", "TEXT"))),
    "mkdir": (("TEXT",), 1, (("path", "TEXT"),)),
    "remove": (("TEXT",), 1, (("path", "TEXT"),)),
    "shell": (("TEXT", "TEXT", "BIGINT"), 1, (("stdout", "TEXT"), ("stderr", "TEXT"), ("exit_code", "BIGINT"), ("duration_ms", "BIGINT"))),
    "send": (("TEXT", "TEXT"), 2, (("to", "TEXT"), ("delivered", "BOOLEAN"))),
    "web_fetch": (("TEXT",), 1, (("url", "TEXT"), ("status", "BIGINT"), ("text", "TEXT"), ("tokens", "BIGINT"))),
    "web_search": (("TEXT", "BIGINT"), 1, (("rank", "BIGINT"), ("title", "TEXT"), ("url", "TEXT"), ("snippet", "TEXT"))),
}
MAX_BODY, DEFAULT_HITS, MAX_HITS = 200 << 10, 10, 20


class Web(Protocol):
    """The web as a session sees it: hosts it may read from, pages, and a search service.

    One whose pages are a table may also have ``fetch_all(urls)``: to a table of calls (at, url) it adds status, kind and
    body (binary) of each, a null status where there is no page. Executors then make the rows, and none passes through
    the driver. ``max_body`` is the number of bytes of a body that are read, MAX_BODY where it is not given, None for all.
    """

    hosts: tuple[str, ...]

    def fetch(self, url: str) -> tuple[int, str, bytes]:
        """Status, content type and body."""

    def search(self, query: str, n: int) -> list[tuple[str, str, str]]:
        """Title, URL and summary of the n best hits."""


class Server(Protocol):
    """A server of tools. tools() lists dicts of name, args, required and read_only; call() returns texts."""

    def tools(self) -> list[dict]: ...

    def call(self, name: str, args: dict) -> list[str]: ...


def web(own: Web | None, name: str, args: list) -> list[tuple]:
    """Rows of web_fetch and web_search."""
    if own is None:
        raise SqlError(f"{name}: the session has no web access; give it one")
    if name == "web_search":
        n = DEFAULT_HITS if len(args) < 2 or args[1] is None else int(args[1])
        if n < 1:
            raise SqlError(f"web_search: n must be positive, got {n}")
        return [(i, *hit) for i, hit in enumerate(own.search(args[0], min(n, MAX_HITS))[: min(n, MAX_HITS)], 1)]
    if refused := refusal(own.hosts, args[0]):
        raise SqlError(refused)
    return [page_row(args[0], *own.fetch(args[0]), getattr(own, "max_body", MAX_BODY))]


def refusal(hosts: Iterable[str], url: str | None) -> str | None:
    """Why web_fetch may not read a URL."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not any(host == h or host.endswith(f".{h}") for h in hosts):
        return f"web_fetch: {host or url} is not on the list of hosts"
    return None


def page_row(url: str, status: int, kind: str, body: bytes | None, most: int | None) -> tuple:
    """web_fetch's row for a page; one without a body has no text."""
    if body is None:
        return url, status, None, None
    text = body[:most].decode("utf-8", "replace")
    text = page_text(text) if "html" in kind or text.lstrip()[:1] == "<" else text
    return url, status, text, -(-len(text) // 4)


def refused_urls(own: Web, urls: DataFrame) -> DataFrame:
    """Of calls (at, url) those that web_fetch may not make: at, url and why."""
    hosts = tuple(own.hosts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(at, url, why) for at, url in zip(b["at"].to_pylist(), b["url"].to_pylist()) if (why := refusal(hosts, url))]
            yield _batch(rows, {"at": pa.int64(), "url": pa.string(), "error": pa.string()})

    return urls.select("at", "url").mapInArrow(run, "at long, url string, error string")


def fetched_pages(own: Web, urls: DataFrame) -> DataFrame:
    """web_fetch's rows for calls (at, url), made by executors, each with what the trace says of it."""
    most = getattr(own, "max_body", MAX_BODY)
    types = {"at": pa.int64(), "url": pa.string(), "status": pa.int64(), "text": pa.string(), "tokens": pa.int64(), "args": pa.string(), "bytes_out": pa.int64(), "elapsed_ms": pa.int64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at, url, status, kind, body in zip(*[b[c].to_pylist() for c in ("at", "url", "status", "kind", "body")]):
                began, error = time.time(), None if status is not None else f"web_fetch: there is no page {url}"
                row = (url, None, None, None) if error else page_row(url, status, kind, body, most)
                rows.append((at, *row, json.dumps([url], ensure_ascii=False), 0 if error else row_bytes(row), int(1000 * (time.time() - began)), error))
            yield _batch(rows, types)

    found = own.fetch_all(urls).selectExpr("at", "url", "CAST(status AS long) AS status", "kind", "body")
    return found.mapInArrow(run, "at long, url string, status long, text string, tokens long, args string, bytes_out long, elapsed_ms long, error string")


def row_bytes(row: tuple) -> int:
    return sum(len(str(v).encode("utf-8", "replace")) for v in row)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


def page_text(html: str) -> str:
    """The same text as html_text makes of a column, for one page."""
    x = re.sub(r"(?s)<!--.*?(-->|\Z)", "", html)
    x = re.sub(r"(?is)<(script|style)\b[^>]*>.*?(</\1\s*>|\Z)", "\n", x)
    x = re.sub(rf"(?is)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n", x)
    x = re.sub(r"(?s)<[^>]*>", " ", x)
    x = re.sub(r"&(?:#(\d{1,8})|#[xX]([0-9a-fA-F]{1,6})|(lt|gt|quot|apos|nbsp|amp));", _entity, x)
    return "\n".join(r for line in x.split("\n") if (r := " ".join(line.split())))


def _entity(m: re.Match) -> str:
    if m[3]:
        return {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}[m[3]]
    n = int(m[1]) if m[1] else int(m[2], 16)
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]


def run(ws: Workspace, name: str, args: list, allow_shell: bool = False) -> list[tuple]:
    if name == "write_file":
        p = ws.path(args[0])
        p.parent.mkdir(parents=True, exist_ok=True)
        if convert.kind_of(p) in convert.WRITTEN:  # documents are built from the text
            (convert.write_docx if convert.kind_of(p) == "docx" else convert.write_xlsx)(p, args[1])
            return [(args[0], p.stat().st_size)]
        return [(args[0], p.write_bytes(args[1].encode()))]
    if name == "append_file":
        with ws.path(args[0]).open("ab") as f:
            return [(args[0], f.write(args[1].encode()))]
    if name == "patch":
        return [patch(ws, *args)]
    if name == "mkdir":
        ws.path(args[0]).mkdir(parents=True, exist_ok=True)
        return [(args[0],)]
    if name == "remove":
        p = ws.path(args[0])
        if p == ws.root:
            raise SqlError("remove: the workspace itself stays")
        p.rmdir() if p.is_dir() else p.unlink()
        return [(args[0],)]
    if name == "shell":
        if not allow_shell:
            raise SqlError("shell is withheld in this session")
        began = time.time()
        limit = (args[2] if len(args) > 2 and args[2] else 60_000) / 1000
        done = subprocess.run(["sh", "-c", args[0]], cwd=ws.path(args[1] if len(args) > 1 and args[1] else "."), capture_output=True, text=True, timeout=limit, check=False)
        return [(done.stdout, done.stderr, done.returncode, int(1000 * (time.time() - began)))]
    raise SqlError(f"unknown tool {name}")


def patch(ws: Workspace, name: str, old: str, new: str) -> tuple[str, int, str]:
    """Replace the one occurrence of old: exact, else alike but for white space and curly quotes."""
    p = ws.path(name)
    text = p.read_text("utf-8")
    n = text.count(old)
    if n == 1:
        after = text.replace(old, new)
    elif n > 1:
        raise SqlError(f"patch: the text occurs {n} times in {name}; give more of it")
    else:
        quotes = {"'": "['‘’]", "‘": "['‘’]", "’": "['‘’]", '"': '["“”]', "“": '["“”]', "”": '["“”]'}
        rule = r"\s+".join("".join(quotes.get(c, re.escape(c)) for c in w) for w in old.split())
        hits = list(re.finditer(rule, text)) if rule else []
        if len(hits) != 1:
            raise SqlError(f"patch: the text {'is not' if not hits else 'occurs more than once'} in {name}")
        after = text[: hits[0].start()] + new + text[hits[0].end() :]
    p.write_text(after, "utf-8")
    diff = "".join(difflib.unified_diff(text.splitlines(True), after.splitlines(True), f"a/{name}", f"b/{name}"))
    return name, 1, diff
