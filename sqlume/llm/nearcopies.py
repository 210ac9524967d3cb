"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash proposes, the shingle sets decide. Fingerprints are made of a text's distinct words: an edit changes five
shingles but one word, so that near copies differ in few bits (7 of 128 in the median; fingerprints of the shingles
themselves differ in 15). ``BANDS`` bands (more for short texts) of ``BITS`` further SimHash bits deal the texts; texts that agree on a band
meet in a bucket, where the Gray-order index of ``simhash`` finds those at most ``MAX_DISTANCE`` of 128 bits apart.

What the candidates connect is a cluster; every pair of a cluster is then tried on the whole shingle sets, unless
links found already connect it, so that groups are exactly those of the links within clusters. A cluster of more than
``CLUSTER_ROWS`` sets (or their bytes) is dealt into blocks. Each block is tried with a few sets that all blocks get, the hubs;
what then lies outside the cluster's main group is tried against all blocks. So no task holds more than a
block or two, and what the links already connect is not tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import connected_components, drop_rows, located, materialize, remove, write_places
from sqlume.llm.simhash import bucket_linker

SEED = 42
WORDS = 5
SIMILARITY = 0.8
BANDS, BITS = 48, 22
#: Bands of texts with fewer distinct words than SHORT: one word changes more of their bits.
SHORT, SHORT_BANDS = 40, 96
#: Words of 64 bits that are compared in a bucket, and the most bits that candidates may differ in there.
COMPARED, MAX_DISTANCE = 2, 26
BUCKET_ROWS = 8192
CLUSTER_ROWS, CLUSTER_BYTES = 512, 8 << 20
HUBS = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Reader:
    """Texts to word hashes, all words of a text at once: differences of running sums of bytes by powers. Lower-cases A-Z, words split at ASCII space."""

    def __init__(self) -> None:
        self.powers = np.ones((2, 1), np.uint64)  # of a multiplier and of its inverse

    def words(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        while self.powers.shape[1] < len(raw):
            n = self.powers.shape[1]
            base = np.array([[pow(_BASE, n, 1 << 64)], [pow(_BASE, -n, 1 << 64)]], np.uint64)
            self.powers = np.concatenate([self.powers, self.powers * base], 1)
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[raw], True]))  # turns of words and spaces
        start, end = edge[::2], edge[1::2]
        sums = np.r_[np.uint64(0), np.cumsum((raw + np.uint64(1)) * self.powers[0, : len(raw)])]
        return _mixed((sums[end] - sums[start]) * self.powers[1, start])


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of the whole text where it is shorter."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _STEP + words[i : len(words) - n + 1 + i]
    return np.unique(_mixed(h))


def sketch(words: np.ndarray) -> np.ndarray:
    """SimHash bits of the distinct words: those compared in buckets, then those of the bands."""
    own = np.unique(words)
    width = COMPARED + -(-(BANDS if len(own) >= SHORT else SHORT_BANDS) * BITS // 64)
    ones = np.zeros(64 * width, np.int64)
    steps = np.arange(1, width + 1, dtype=np.uint64) * _STEP
    for i in range(0, len(own), 255):  # counts of a chunk fit in a byte
        x = _mixed(own[i : i + 255, None] + steps)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * ones > len(own)


def band_keys(bits: np.ndarray) -> np.ndarray:
    """Each band's number and its bits, as one number."""
    rows = bits[64 * COMPARED :]
    rows = rows[: len(rows) // BITS * BITS].reshape(-1, BITS)
    return rows @ (1 << np.arange(BITS)) + (np.arange(len(rows)) << BITS)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def links_between(sets: list[np.ndarray], group: np.ndarray, query: np.ndarray, offer: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Near pairs (query, offer) of sets that connect all that near pairs connect; group: what is connected before."""
    if len(sets) == 2:
        pair = bool(query[0] & offer[1] or query[1] & offer[0]) and group[0] != group[1]
        return [(0, 1)] if pair and min(map(len, sets)) >= similarity * max(map(len, sets)) - 1e-9 and jaccard(*sets) >= similarity else []
    size = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(size)]
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(code), bool)
    group, out = group.copy(), []
    for i in np.flatnonzero(query).tolist():
        todo = offer & (group != group[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9) & (size > 0)
        if offer[i]:
            todo[:i] &= ~query[:i]  # pairs of queries once
        if not todo.any():
            continue
        own = code[at[i] : at[i + 1]]
        mark[own] = True
        both = np.diff(np.r_[0, np.cumsum(mark[code])][at])
        mark[own] = False
        for j in np.flatnonzero(todo & (both / (size + size[i] - both + (size == 0)) >= similarity)).tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row its place, doc_id, its shingle set's hash c and size n, and where that may be near another one the SimHash bits."""
    src = located(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["file", "pos", "doc_id", "c", "n", *_FPS, "keys"]
    least = SIMILARITY / (1 - SIMILARITY) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader().words
        for b in batches:
            c, n, fps, keys = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((COMPARED, b.num_rows), np.uint64), []
            for i, t in enumerate(b.column(3)):
                words = read(t.as_py())
                own = shingles(words)
                c[i], n[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)
                if len(own) < least:
                    keys.append(None)
                    continue
                bits = sketch(words)
                fps[:, i] = np.packbits(bits[: 64 * COMPARED], bitorder="little").view("<u8")
                keys.append(band_keys(bits))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(3)), pa.array(c.view(np.int64)), pa.array(n), *(pa.array(f.view(np.int64)) for f in fps), pa.array(keys, pa.list_(pa.int32()))], names)

    return src.mapInArrow(run, f"file long, pos long, doc_id long, c long, n long, {', '.join(f'{f} long' for f in _FPS)}, keys array<int>")


_FPS = [f"f{i}" for i in range(COMPARED)]


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between sets, that connect those which share a bucket and differ in few bits; nodes(c, f0, f1, keys).

    A bucket of many texts is dealt as squares of two blocks each. Which are large is told from a sixteenth of the sets,
    chosen by hash; that decides only how a bucket is dealt, not what is found in it.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.where("keys is not null").select(F.explode("keys").alias("key"), *_FPS, "c")
    some = keyed.where("pmod(c, 16) = 0").groupBy("key").count().where(F.col("count") > BUCKET_ROWS // 16)
    hot, _ = materialize(some.select("key", F.ceil(F.col("count") * 32 / BUCKET_ROWS).cast("int").alias("g")), "hot")
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).cast("long").alias("square"), *_FPS, "c")
    else:
        own, g = F.pmod(F.xxhash64("c"), F.col("g").cast("long")), F.col("g").cast("long")
        others = F.filter(F.sequence(F.lit(0).cast("long"), g - 1), lambda x: x != own)
        square = F.when(g.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda x: F.least(x, own) * g + F.greatest(x, own)))
        dealt = keyed.join(hot, "key", "left").select("key", F.explode(square).alias("square"), *_FPS, "c")
    dealt = dealt.select(F.col("key").cast("long"), "square", *_FPS, "c").repartition(n, "key", "square").sortWithinPartitions("key", "square", "c")
    return dealt.mapInArrow(bucket_linker(MAX_DISTANCE, COMPARED), "a long, b long")


def _dealt(docs: DataFrame, text_col: str, places: DataFrame, names: tuple[str, ...], rows_of: Callable, paths: list[str]) -> DataFrame:
    """(cluster, square, c, role, grp, own): the sets of the rows at places, once for each (square, role, grp) that rows_of(c, *values) lists."""
    listed = write_places(places, names)
    paths.append(listed.folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader().words
        for b in batches:
            there, values = listed.look(*(np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(2)))
            texts, out = b.column(2), []
            for i in np.flatnonzero(there).tolist():
                own = shingles(read(texts[i].as_py())).tobytes()
                c = xxhash.xxh64_intdigest(own, SEED)
                c = c - (1 << 64) if c >> 63 else c
                v = values[:, i].tolist()
                out += [(v[0], square, c, role, grp, own) for square, role, grp in rows_of(c, *v)]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(cols)], ["cluster", "square", "c", "role", "grp", "own"])

    src = located(docs, F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "cluster long, square long, c long, role long, grp long, own binary")


def _verified(dealt: DataFrame) -> DataFrame:
    """Links (a, b) found in each square; role: 1 asks, 2 is offered, 3 both."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            c, role, grp = (np.array([r[k] for r in held], np.int64) for k in range(3))
            got = links_between([np.frombuffer(r[3], np.uint64) for r in held], np.unique(grp, return_inverse=True)[1], role & 1 > 0, role & 2 > 0) if len(held) > 1 else []
            i, j = (np.array([p[k] for p in got], np.int64) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(c[j])], ["a", "b"])

        for b in batches:
            clusters, squares = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = zip(*(b.column(k).to_pylist() for k in range(2, 6)))
            for own, row in zip(zip(clusters, squares), rows):
                if own != key:
                    if held:
                        yield found()
                    key, held = own, []
                held.append(row)
        if held:
            yield found()

    return dealt.repartition(n, "cluster", "square").sortWithinPartitions("cluster", "square", "c").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """Verified pairs (a, b) of sets that connect what all near pairs within a cluster of candidates connect; and the paths behind them.

    nodes: (c, file, pos, n, f0, f1, keys), a row for each distinct set with the place of one text that has it.
    """
    paths: list[str] = []

    def cut(df: DataFrame, name: str) -> DataFrame:
        df, path = materialize(df, name)
        paths.append(path)
        return df

    def groups(edges: DataFrame, as_: str) -> DataFrame:
        found, path = connected_components(edges)
        paths.append(path)
        return found.select(F.col("v").alias("c"), F.col("root").alias(as_))

    edges = cut(candidates(nodes), "candidates")
    members = cut(nodes.select("c", "file", "pos", "n").join(groups(edges, "cluster"), "c"), "members")
    if members.isEmpty():
        return edges, paths
    blocks = F.ceil(F.greatest(F.count("*") / CLUSTER_ROWS, F.sum("n") * 8 / CLUSTER_BYTES)).cast("long")
    hubs = [F.min(F.struct(F.xxhash64(F.lit(k), "c"), "c"))["c"].alias(f"h{k}") for k in range(HUBS)]
    sizes = cut(members.groupBy("cluster").agg(blocks.alias("g"), *hubs).where("g > 1"), "sizes")
    some = not sizes.isEmpty()
    places = members.select("file", "pos", "cluster", F.lit(1).alias("g"), F.lit(0).alias("hub"))
    if some:
        is_hub = F.col("c").isin(*[F.col(f"h{k}") for k in range(HUBS)]).cast("long").alias("hub")
        big = cut(members.join(sizes, "cluster").select("cluster", "c", "file", "pos", "n", "g", is_hub), "big")
        places = places.join(sizes, "cluster", "left_anti").unionByName(big.select("file", "pos", "cluster", "g", "hub"))
    first = _dealt(docs, text_col, places, ("cluster", "g", "hub"), lambda c, cluster, g, hub: [(s, 3, c) for s in (range(g) if hub else [c % g])], paths)
    found = cut(_verified(first), "near")
    if some:
        tied = groups(found.join(big.select(F.col("c").alias("a")), "a", "left_semi"), "grp")
        big = cut(big.join(tied, "c", "left").withColumn("grp", F.coalesce("grp", "c")), "tied")
        count = big.groupBy("cluster", "grp").agg(F.count("*").alias("rows"))
        main = count.groupBy("cluster").agg(F.max(F.struct("rows", "grp")).alias("main"), F.sum("rows").alias("rows")).where("main.rows < rows")
        big = cut(big.join(main.select("cluster", F.col("main.grp").alias("main")), "cluster"), "split")
        asking = big.where("grp <> main").groupBy("cluster").agg(blocks.alias("k"))
        places = big.join(asking, "cluster").select("file", "pos", "cluster", "g", "k", "grp", (F.col("grp") != F.col("main")).cast("long").alias("asks"))

        def squares(c: int, cluster: int, g: int, k: int, grp: int, asks: int) -> list[tuple[int, int, int]]:
            mine, own = c % g, c // g % k
            out = [(q * g + mine, 2, grp) for q in range(k) if not (asks and q == own)]
            return out + [(own * g + o, 3 if o == mine else 1, grp) for o in range(g)] if asks else out

        if not big.isEmpty():
            found = found.union(cut(_verified(_dealt(docs, text_col, places, ("cluster", "g", "k", "grp", "asks"), squares, paths)), "near"))
    return found, paths


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every group of near copies, that of the smallest id, with all columns.

    Rows without an id come after those with one; of rows that repeat an id in a group the first in the files stays.
    Null, empty and blank texts are one group. Rows are told apart by their places in files, so that whole texts are
    not dealt; docs that do not read files are written to the shared folder first.
    """
    if located(docs) is None:
        docs, _ = materialize(docs, "documents")
    marks, marks_at = materialize(_marks(docs, id_col, text_col), "marks")
    row = F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "file", "pos")
    one = [F.any_value(c).alias(c) for c in ("n", *_FPS, "keys")]
    nodes, nodes_at = materialize(marks.groupBy("c").agg(F.min(row).alias("row"), F.count("*").alias("rows"), *one).select("c", "row", "rows", "row.file", "row.pos", "n", *_FPS, "keys"), "nodes")
    found, paths = links(nodes, docs, text_col)
    roots, roots_at = connected_components(found)
    sets, sets_at = materialize(nodes.select("c", "row", "rows").join(roots.withColumnRenamed("v", "c"), "c", "left").select("c", "row", "rows", F.coalesce("root", "c").alias("root")), "sets")
    heads = sets.groupBy("root").agg(F.min("row").alias("head"), F.sum("rows").alias("all")).where("all > 1").select("root", "head")
    named = sets.join(heads, "root").select("c", "head")
    gone = marks.select("file", "pos", "c").join(named, "c").where("file <> head.file or pos <> head.pos").select("file", "pos")
    out = drop_rows(docs, gone)
    remove(docs.sparkSession, marks_at, nodes_at, roots_at, sets_at, *paths)
    return out
