"""SimHash near-duplicate groups, linked exactly through a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint; fingerprints that differ in at most ``max_distance`` bits are linked and
the connected groups returned. Distinct fingerprints only are compared. By the pigeonhole principle two linked
fingerprints agree on one of ``max_distance + 1`` bit blocks, so fingerprints are dealt by block value. Within a
block bucket they are sorted by Gray rank and indexed: neighbours in Gray order share most bits, and each upper
node keeps the bits that all fingerprints below it share, as a mask and a pattern. A search adds up differences on
the shared bits downwards and drops whole groups once they exceed the limit.

A bucket above ``bucket_limit`` is dealt again by a block of its remaining bits (same principle, still exact),
so the rows a task may gather for one bucket are bounded by the free bits, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import connected_components, local_stars, materialize, remove

SEED = 42
FANOUT = 16
BUCKET_LIMIT = 512
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash as an unsigned integer; 0 where there are no words. Lower-cases A-Z, words split at ASCII space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return h(joined, SEED)  # a single shingle: its bits are all in over half
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    starts, ends = at[: len(words) - shingle_words + 1].tolist(), (at[shingle_words:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        hs = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], "<u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row, fp holding the 64 bits as a signed long."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(words: np.ndarray) -> np.ndarray:
    """Places of fingerprints of several words (rows) in Gray order: a word's rank is turned round after words of odd rank."""
    ranks, odd = [], np.zeros(len(words), np.uint64)
    for col in words.T:
        r = gray_rank(col) ^ (np.uint64(0) - odd)
        ranks.append(r)
        odd = r & np.uint64(1)
    return np.lexsort(ranks[::-1])


class GrayIndex:
    """Hierarchical index over distinct fingerprints, rows of one or more 64-bit words, sorted by Gray rank."""

    def __init__(self, words: np.ndarray, fanout: int = FANOUT) -> None:
        words = words.reshape(len(words), -1)
        self.order = gray_order(words)
        self.fanout = fanout
        leaf = words[self.order]
        self.levels = [(leaf, np.full(leaf.shape, ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pat, mask = self.levels[-1]
            cut = np.arange(0, len(pat), fanout)
            first = np.repeat(pat[cut], np.diff(np.append(cut, len(pat))), axis=0)
            varied = np.bitwise_or.reduceat((pat ^ first) | ~mask, cut, axis=0)
            self.levels.append((pat[cut] & ~varied, ~varied))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields blocks of (query position, word position) with at most ``limit`` differing bits."""
        queries = queries.reshape(len(queries), -1)
        for at in range(0, len(queries), 256):
            q = np.arange(at, min(at + 256, len(queries)))
            n = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                pat, mask = self.levels[depth]
                apart = np.bitwise_count((queries[q] ^ pat[n]) & mask[n])
                near = (apart[:, 0] if apart.shape[1] == 1 else apart.sum(1, dtype=np.int32)) <= limit  # differences so far, on shared bits
                q, n = q[near], n[near]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q = np.repeat(q, self.fanout)
                    n = (n[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    q, n = q[n < below], n[n < below]
            yield q, self.order[n]


def local_roots(words: np.ndarray, limit: int) -> np.ndarray:
    """For each word of one bucket, the position of the first word of its group under links of at most ``limit`` bits."""
    label = np.arange(len(words))
    if len(words) < 2:
        return label
    for i, j in GrayIndex(words).search(words, limit):
        moved, to = local_stars(label[i], label[j])
        if len(moved):
            new = np.arange(len(words))
            new[moved] = to
            label = new[label]
    return label


def bucket_linker(limit: int, width: int = 1):
    """Maps rows (part, key, ``width`` words, rep) sorted by bucket (part, key) to star edges (a, b) between representatives."""

    def edges(part: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[list, list]:
        cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.append(cut, len(fp)))
        a, b = [], []
        small = np.repeat(size <= FANOUT, size)  # one leaf: its words are compared as they lie
        group = np.repeat(np.arange(len(cut)), size)
        for s in range(1, FANOUT):
            i = np.flatnonzero(small[s:] & (group[s:] == group[:-s]))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]).sum(1, dtype=np.int32) <= limit]
            a.append(rep[i + s]), b.append(rep[i])
        for g in np.flatnonzero(size > FANOUT):
            own = slice(cut[g], cut[g] + size[g])
            root = local_roots(fp[own], limit)
            moved = np.flatnonzero(root != np.arange(size[g]))
            a.append(rep[own][moved]), b.append(rep[own][root[moved]])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * (3 + width)
        for batch in batches:
            cols = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = last[-1] + 1 if len(last) else 0
            kept = [c[at:] for c in cols]
            yield from out([c[:at] for c in cols])
        yield from out(kept)

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            a, b = edges(cols[0], cols[1], np.stack(cols[2:-1], 1).view(np.uint64), cols[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (a, b)], ["a", "b"])

    return run


def _parts(free: list[int], n: int) -> list[list[int]]:
    """n contiguous parts of the free bits, as even as can be."""
    cut = [len(free) * i // n for i in range(n + 1)]
    return [free[cut[i] : cut[i + 1]] for i in range(n)]


def _signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def link_edges(nodes: DataFrame, max_distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> tuple[DataFrame, list[str]]:
    """Edges (a, b) that connect the groups of nodes (fp long distinct, rep long), and the scratch paths behind them."""
    spark, ways = nodes.sparkSession, max_distance + 1
    fixed: list[list[int]] = [[]]
    rows = nodes.select(F.lit(0).cast("long").alias("path"), "fp", "rep")
    parts, paths = [], []
    while True:
        fixed = [f + p for f in fixed for p in _parts([b for b in range(64) if b not in f], ways)]
        masks = F.array(*[F.lit(_signed(f)).cast("long") for f in fixed])
        child = F.explode(F.sequence(F.col("path") * ways, F.col("path") * ways + ways - 1))
        keyed = rows.select(child.alias("path"), "fp", "rep")
        keyed = keyed.select("path", F.col("fp").bitwiseAND(F.element_at(masks, (F.col("path") + 1).cast("int"))).alias("key"), "fp", "rep")
        last = 64 - max(map(len, fixed)) <= 15
        hot = None
        if not last:
            hot, p = materialize(keyed.groupBy("path", "key").count().where(F.col("count") > bucket_limit).select("path", "key"), "hot")
            paths.append(p)
            if hot.isEmpty():
                hot = None
        cold = keyed.join(hot, ["path", "key"], "left_anti") if hot is not None else keyed
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found, p = materialize(
            cold.select("path", "key", "fp", "rep").repartition(n, "path", "key").sortWithinPartitions("path", "key", "fp")
            .mapInArrow(bucket_linker(max_distance), "a long, b long"), "links")
        parts.append(found)
        paths.append(p)
        if hot is None:
            break
        rows = keyed.join(hot, ["path", "key"], "left_semi").select("path", "fp", "rep")
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    return edges, paths


def grouped(docs: DataFrame, shingle_words: int = 3, max_distance: int = 3, bucket_limit: int = BUCKET_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of all rows with component_id, the smallest doc_id of the group."""
    marks, _ = materialize(fingerprints(docs, shingle_words, id_col, text_col), "simhash")
    nodes, at = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    edges, paths = link_edges(nodes.where("rep is not null"), max_distance, bucket_limit)
    roots, path = connected_components(edges)
    named, _ = materialize(nodes.join(roots, nodes.rep == roots.v, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "named")
    remove(docs.sparkSession, at, path, *paths)
    return marks.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_distance: int = 3, bucket_limit: int = BUCKET_LIMIT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per document.

    fingerprint: 16 lowercase hex digits; component_id: smallest doc_id reachable over links of at most
    max_distance differing bits, itself included. Null, empty and blank texts have fingerprint zero and are linked
    like any other. A null doc_id counts for no component's smallest id; a fingerprint without any id has null and
    no links. Repeated rows each get their row. An empty table gives an empty result. Other columns are ignored.
    """
    found = grouped(docs, shingle_words, max_distance, bucket_limit, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

