"""Workspace files as relations: files, lines, read, read_csv, read_json, grep, search, and typed table loads.

Paths are resolved inside the workspace and cannot leave it.
"""

from __future__ import annotations

import csv
import io
import json
import math
import os
import re
import subprocess
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

from sqlume.errors import SqlError
from sqlume.operators.fixpoint import shared_dir
from sqlume.sources import convert

MAX_FILES, MAX_HITS, MAX_BYTES, MAX_RESULTS = 10_000, 10_000, 4 << 20, 100
_WORD = re.compile(r"\w+")


def new_folder(spark: SparkSession) -> Path:
    """A folder for a session's files, which only the driver reads: below the shared folder where that is one of files."""
    top = shared_dir(spark)
    path = Path(top.removeprefix("file://"), f"workspace-{uuid.uuid4().hex}") if top.startswith("file:/") else Path(mkdtemp(prefix="sqlume-"))
    path.mkdir(parents=True, exist_ok=True)
    return path


class Workspace:
    def __init__(self, root: str, env: tuple[str, ...] = (), skills: dict[str, tuple[str, str]] | None = None) -> None:
        self.root, self.allowed, self.skills = Path(root).resolve(), env, skills or {}

    def path(self, name: str) -> Path:
        p = (self.root / name).resolve()
        if ".." in Path(name).parts or not p.is_relative_to(self.root):
            raise SqlError(f"{name} lies outside the workspace")
        return p

    def _text(self, name: str) -> str:
        try:
            p = self.path(name)
            if convert.kind_of(p) in convert.READ and p.is_file():
                return convert.text_of(p)
            return p.read_text("utf-8", "replace").removeprefix("﻿")
        except OSError as e:
            raise SqlError(f"{name}: {e.strerror}") from e

    def walk(self, glob: str = "**") -> Iterator[tuple[str, Path]]:
        rule = re.compile(_glob(glob))
        found = []
        for top, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in (".git", "target"))
            for n in [*dirs, *names]:
                p = Path(top, n)
                rel = p.relative_to(self.root).as_posix()
                if rule.fullmatch(rel):
                    found.append((rel, p))
                    if len(found) > MAX_FILES:
                        raise SqlError(f"{glob} matches over {MAX_FILES} entries; narrow it")
        yield from sorted(found)

    # table functions: rows of tuples

    def files(self, glob: str) -> list[tuple]:
        out = []
        for rel, p in self.walk(glob):
            s = p.stat()
            out.append((rel, s.st_size, int(s.st_mtime), "dir" if p.is_dir() else "file"))
        return out

    def lines(self, name: str, first: int = 1, last: int | None = None) -> list[tuple]:
        if last is not None and last < first:
            raise SqlError(f"lines: the range ends at {last}, before {first}")
        rows = self._text(name).splitlines()
        return [(i, t) for i, t in enumerate(rows, 1) if i >= first and (last is None or i <= last)]

    def read(self, name: str) -> list[tuple]:
        return [(self._text(name),)]

    def read_csv(self, name: str) -> list[tuple]:
        return [(i, json.dumps(r, ensure_ascii=False, separators=(",", ":"))) for i, r in enumerate(csv_records(self._text(name)), 1)]

    def read_json(self, name: str) -> list[tuple]:
        return [(i, json.dumps(r, ensure_ascii=False, separators=(",", ":"))) for i, r in enumerate(json_records(self._text(name)), 1)]

    def _texts(self, glob: str) -> Iterator[tuple[str, str]]:
        for rel, p in self.walk(glob):
            if p.is_file() and p.stat().st_size <= MAX_BYTES:
                if convert.kind_of(p) in convert.READ:
                    try:
                        yield rel, convert.text_of(p)
                    except SqlError:  # grep and search pass over what isn't readable, as over binary files
                        pass
                    continue
                raw = p.read_bytes()
                if b"\0" not in raw[:8192]:
                    yield rel, raw.decode("utf-8", "replace")

    def grep(self, pattern: str, glob: str = "**") -> list[tuple]:
        try:
            rule = re.compile(pattern)
        except re.error as e:
            raise SqlError(f"grep: {e}") from e
        out = []
        for rel, text in self._texts(glob):
            for i, line in enumerate(text.splitlines(), 1):
                if rule.search(line):
                    if len(out) >= MAX_HITS:
                        return [*out, ("", 0, f"stopped after {MAX_HITS} lines")]
                    out.append((rel, i, line))
        return out

    def search(self, query: str, glob: str = "**", n: int = 10) -> list[tuple]:
        if n < 1:
            raise SqlError(f"search: n must be positive, got {n}")
        terms = list(dict.fromkeys(words(query)))
        if not terms:
            raise SqlError("search: the query has no words")
        docs = [(rel, text, words(text)) for rel, text in self._texts(glob)]
        scores = bm25([d[2] for d in docs], terms)
        best = sorted(((s, rel, text) for s, (rel, text, _) in zip(scores, docs) if s > 0), key=lambda x: (-x[0], x[1]))[: min(n, MAX_RESULTS)]
        return [(rel, round(s * 1000) / 1000, *best_line(text, terms)) for s, rel, text in best]

    def env(self, name: str) -> list[tuple]:
        if name not in self.allowed:
            raise SqlError(f"env: {name} is not on the allow list")
        return [(os.environ.get(name),)]

    def skill(self, name: str) -> list[tuple]:
        if name not in self.skills:
            raise SqlError(f"skill: there is no skill {name}")
        return [(name, *self.skills[name])]

    def _git(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", str(self.root), *args], capture_output=True, text=True, timeout=60, check=False)
        if done.returncode:
            raise SqlError(f"git: {done.stderr.strip()}")
        return done.stdout

    def git_log(self, n: int = 20) -> list[tuple]:
        out = self._git("log", f"-{int(n)}", "--format=%H%x1f%an%x1f%aI%x1f%s%x1e")
        return [tuple(r.strip("\n").split("\x1f")) for r in out.split("\x1e") if r.strip()]

    def git_diff(self, ref: str = "HEAD") -> list[tuple]:
        if ref.startswith("-"):
            raise SqlError("git_diff takes a revision")
        parts = re.split(r"(?m)^(?=diff --git )", self._git("diff", ref, "--"))
        return [(re.search(r" b/(.*)", p.splitlines()[0])[1], p) for p in parts if p.strip()]

    def git_blame(self, name: str) -> list[tuple]:
        rel = self.path(name).relative_to(self.root).as_posix()
        rows, sha, author, line = [], "", "", 0
        for t in self._git("blame", "--line-porcelain", "--", rel).split("\n"):
            if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", t):
                sha, line = m[1], int(m[2])
            elif t.startswith("author "):
                author = t[7:]
            elif t.startswith("\t"):
                rows.append((line, sha, author, t[1:]))
        return rows


def _glob(glob: str) -> str:
    """A pattern in which * stays within a folder and ** does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def bm25(docs: list[list[str]], terms: list[str], k1: float = 1.2, b: float = 0.75) -> list[float]:
    n = len(docs)
    mean = sum(map(len, docs)) / n if n else 0
    counts = [Counter(w for w in d if w in terms) for d in docs]
    idf = {t: math.log((n - (df := sum(t in c for c in counts)) + 0.5) / (df + 0.5) + 1) for t in terms}
    return [sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(d) / mean)) for t in terms if c[t]) for c, d in zip(counts, docs)]


def best_line(text: str, terms: list[str]) -> tuple[int, str]:
    best = (0, 0, "")
    for i, line in enumerate(text.splitlines(), 1):
        hits = len(set(words(line)) & set(terms))
        if hits > best[0]:
            best = (hits, i, line.strip()[:160])
    return best[1], best[2]


def csv_records(text: str) -> list[dict]:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return []
    head = [h.strip() or f"column{i}" for i, h in enumerate(rows[0], 1)]
    out = []
    for i, r in enumerate(rows[1:], 2):
        if len(r) > len(head):
            raise SqlError(f"CSV record {i} has {len(r)} fields, the header {len(head)}")
        out.append({h: v for h, v in zip(head, r) if v != ""})
    return out


def json_records(text: str) -> list:
    text = text.strip()
    if not text:
        return []
    try:
        v = json.loads(text)
    except ValueError as e:
        try:
            return [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError:
            raise SqlError(f"not JSON (an array, an object or a value in each line): {e}") from e
    if isinstance(v, dict):
        arrays = [x for x in v.values() if isinstance(x, list)]
        return arrays[0] if len(arrays) == 1 else [v]
    return v if isinstance(v, list) else [v]


def infer(values: list) -> str:
    """The narrowest type that all values that are there fit."""
    seen = [v for v in values if v is not None and not (isinstance(v, str) and not v.strip())]
    if not seen:
        return "TEXT"
    if all(isinstance(v, (dict, list)) for v in seen):
        return "JSON"
    texts = [("true" if v else "false") if isinstance(v, bool) else str(v).strip() for v in seen if not isinstance(v, (dict, list))]
    if len(texts) == len(seen):
        if all(re.fullmatch(r"[+-]?\d{1,18}", t) for t in texts):
            return "BIGINT"
        if all(_number(t) for t in texts):
            return "DOUBLE"
        if all(t.lower() in ("true", "false") for t in texts):
            return "BOOLEAN"
    return "TEXT"


def _number(t: str) -> bool:
    try:
        float(t)
    except ValueError:
        return False
    return "_" not in t


def typed(records: list, header: list[str] | None = None) -> tuple[list[tuple[str, str]], list[tuple]]:
    """Fields and rows of records, with inferred types."""
    names = header or list(dict.fromkeys(k for r in records if isinstance(r, dict) for k in r))
    fields = [(n, infer([r.get(n) if isinstance(r, dict) else None for r in records])) for n in names]

    def cell(v: object, t: str) -> object:
        if v is None or isinstance(v, str) and not v.strip():
            return None
        if isinstance(v, (dict, list)):
            return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        s = ("true" if v else "false") if isinstance(v, bool) else str(v)
        return int(s) if t == "BIGINT" else float(s) if t == "DOUBLE" else s.strip().lower() == "true" if t == "BOOLEAN" else s

    return fields, [tuple(cell(r.get(n), t) for n, t in fields) for r in records if isinstance(r, dict)]


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(ordinal, text) of the paragraphs between blank lines."""
    parts = [p.strip() for p in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n"))]
    return list(enumerate(p for p in parts if p))
