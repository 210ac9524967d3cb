"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some token positions of a window and ignore the others, so that a window with substituted words
still hashes like the original. Hashes of all benchmark windows are joined with those of all document windows; each
hit is verified by aligning the item with the document along the hit's diagonal and taking the best-scoring stretch,
which may hold substituted words. A document overlaps an item where such a stretch has at least ``min_words`` words
(or the whole item, where that is shorter) of which a share of ``min_share`` or more agree. Items of under
``MIN_ITEM_WORDS`` words are looked for whole and word for word, by one hash of their words.

The benchmark's hash tables are built on the executors in blocks of bounded size and written to the shared folder. The
documents are scanned once: each batch of them is joined with one block after the other, which a worker reads when
it gets there, so no size of benchmark overfills an executor or passes through the driver, and documents are never shuffled.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import materialize, remove, scratch

#: Windows of up to ten words, six of which count: some window of a stretch of 13 words or more is hit whichever fifth is substituted.
MASKS = ("111111", "1101011001", "111001011", "1011000111", "1110001011")
#: The same for whole items of 8 to 12 words.
SHORT_MASKS = ("111011", "11010011", "11111")
MIN_WORDS = 13
MIN_ITEM_WORDS = 8
MIN_SHARE = 0.8
BLOCK_WORDS = 200_000
_WORD = re.compile(r"\w+")
_BITS = 21
_ROWS = 512
SCHEMA = "doc_id long, item_id long, doc_start long, n_words long, n_agree long, share double"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return _WORD.findall((text or "").lower())


class SeedIndex:
    """Spaced-seed hashes of one block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, list[str]]], masks: tuple[str, ...] = MASKS) -> None:
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int32) for _, ws in items]
        # the value of a word is its own hash; a word that no item has is 0 and never agrees
        self.value = np.array([0, *(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) for w in self.vocab)], np.uint64)
        whole = sorted({len(ws) for _, ws in items if len(ws) < MIN_ITEM_WORDS})
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in (*masks, *SHORT_MASKS)] + [np.arange(n) for n in whole]
        seeded = len(masks) + len(SHORT_MASKS)
        self.seeds = []
        for r, mask in enumerate(self.masks):
            h, item, at = [], [], []
            for k, ws in enumerate(self.items):
                if len(ws) != whole[r - seeded] if r >= seeded else len(ws) < MIN_ITEM_WORDS or r >= len(masks) and len(ws) >= MIN_WORDS:
                    continue
                own = self.hashes(self.value[ws], mask)
                h.append(own), item.append(np.full(len(own), k)), at.append(np.arange(len(own)))
            h, item, at = (np.concatenate([np.empty(0, t), *x]) for x, t in ((h, np.uint64), (item, np.int64), (at, np.int64)))
            order = np.argsort(h, kind="stable")
            present = np.zeros(1 << _BITS, bool)
            present[h >> np.uint64(64 - _BITS)] = True
            self.seeds.append((h[order], item[order], at[order], present))

    @staticmethod
    def hashes(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Hash of each window of the values under the mask."""
        n = len(values) - int(mask[-1])
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for p in mask:
            h = (h ^ values[p : p + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def codes(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts laid end to end as numbers (0 where no item has the word), and where each text starts."""
        get, words, starts, n = self.vocab.get, [np.empty(0, np.int32)], [], 0
        for t in texts:
            own = [get(w, 0) for w in words_of(t)]
            starts.append(n)
            words.append(np.array(own, np.int32))
            n += len(own)
        return np.concatenate(words), np.array(starts, np.int64)

    def overlaps(self, words: np.ndarray, starts: np.ndarray, min_words: int, min_share: float) -> list[tuple[int, int, int, int, int]]:
        """Of documents laid end to end: (document, item, start, words, agreeing words), the best stretch of each pair."""
        values = self.value[words]
        found = []
        for mask, (h, item, at, present) in zip(self.masks, self.seeds):
            if not len(h):
                continue
            own = self.hashes(values, mask)
            pos = np.flatnonzero(present[own >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(h, own[pos], "left"), np.searchsorted(h, own[pos], "right")
            n = hi - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            j = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            p = np.repeat(pos, n)
            found.append(np.stack([np.searchsorted(starts, p, "right") - 1, item[j], p - at[j]], 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, diag in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            ws = self.items[k]
            lo, hi = max(starts[d], diag), min(starts[d + 1] if d + 1 < len(starts) else len(words), diag + len(ws))
            same = words[lo:hi] == ws[lo - diag : hi - diag]
            stretch = best_stretch(same, min_share)
            if stretch is None:
                continue
            a, b, agree = stretch
            if len(ws) < MIN_ITEM_WORDS and agree < len(ws):
                continue
            if b - a >= min(min_words, len(ws)) and (b - a, agree) > best.get((d, k), (0, 0, 0))[:2]:
                best[d, k] = (b - a, agree, int(lo + a - starts[d]))
        return [(d, k, at, n, agree) for (d, k), (n, agree, at) in sorted(best.items())]


def best_stretch(same: np.ndarray, min_share: float) -> tuple[int, int, int] | None:
    """Longest [a, b) that begins and ends with an agreement and has a share of at least min_share; with its agreements."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return None
    score = np.r_[0, np.cumsum(np.where(same, 1 - min_share, -min_share))]
    low = np.minimum.accumulate(score[:-1])  # the first start from which an end is reached with the share kept
    best = None
    for b in hits[::-1].tolist():
        if best is not None and b + 1 <= best[1] - best[0]:
            break
        a = int(np.searchsorted(-low[: b + 1], -(score[b + 1] + 1e-9), "left"))
        if a > b:
            continue
        a = int(hits[np.searchsorted(hits, a)])
        if best is None or b + 1 - a > best[1] - best[0]:
            best = (a, b + 1)
    return None if best is None else (*best, int(same[best[0] : best[1]].sum()))


def write_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[str]:
    """Writes the indexes of the benchmark's items, each over at most block_words words (or one item); gives their paths, one for each block."""
    spark = benchmark.sparkSession
    folder = scratch(spark, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        items, n, names = [], 0, []

        def close() -> None:
            name = uuid.uuid4().hex
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(zlib.compress(pickle.dumps(SeedIndex(items)), 1))
            names.append(name)

        for b in batches:
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ws = words_of(text.as_py())
                if not ws:
                    continue
                if items and n + len(ws) > block_words:
                    close()
                    items, n = [], 0
                items.append((item_id, ws))
                n += len(ws)
        if items:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    made, path = materialize(rows.mapInArrow(run, "name string"), "blocks")  # of tasks that run again only those listed count
    names = [f"{folder}/{r[0]}" for r in made.orderBy("name").collect()]
    remove(spark, path)
    return names


@functools.lru_cache(2)
def read_block(path: str) -> SeedIndex:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return pickle.loads(zlib.decompress(f.read()))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, block_words: int = BLOCK_WORDS,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (doc_id, item_id, doc_start, n_words, n_agree, share) for each document and item that overlap.

    The longest stretch counts (then the one with most agreeing words, then the first); doc_start counts words of the
    document. Null and empty texts overlap with nothing, nor do items without words. Repeated
    documents and items each give their rows. Empty tables give no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = write_blocks(benchmark, item_col, item_text_col, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in blocks:
                ix = read_block(path)
                for at in range(0, b.num_rows, _ROWS):
                    part = b.slice(at, _ROWS)
                    words, starts = ix.codes(t.as_py() for t in part.column(1))
                    got = ix.overlaps(words, starts, min_words, min_share)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[d], ix.ids[k], s, m, a, a / m) for d, k, s, m, a in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in rows], pa.float64() if c == 5 else pa.int64()) for c in range(6)],
                        ["doc_id", "item_id", "doc_start", "n_words", "n_agree", "share"])

    return src.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, block_words: int = BLOCK_WORDS,
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that overlap with no item, with all their columns; a map over the documents, without a shuffle.

    Null and empty texts stay; so does everything where the benchmark is empty. Repeated rows are judged alike.
    """

    blocks = write_blocks(benchmark, item_col, item_text_col, block_words)
    if not blocks:
        return docs

    @F.pandas_udf("boolean")
    def clear(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            left = np.arange(len(s))
            for path in blocks:
                ix, kept = read_block(path), []
                for at in range(0, len(left), _ROWS):
                    own = left[at : at + _ROWS]
                    words, starts = ix.codes(s.iloc[own])
                    hit = np.zeros(len(own), bool)
                    hit[[d for d, *_ in ix.overlaps(words, starts, min_words, min_share)]] = True
                    kept.append(own[~hit])
                left = np.concatenate(kept) if kept else left
            out = np.zeros(len(s), bool)
            out[left] = True
            yield pd.Series(out)

    return docs.where(clear(F.col(text_col).cast("string")))
