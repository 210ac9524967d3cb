"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

Unit vectors are projected on fixed random directions. Two vectors of cosine c are apart by d = sqrt(2 - 2c), so on a
unit direction their projections differ by about s = d / sqrt(dims). A pair collides on a projection if one lies in
the window of ``WIDTH`` s around the other, found by bisection in the sorted projection; pairs that collide on at least
``min_count`` of ``PROJECTIONS`` projections are verified in double precision.

A window alone holds a fixed share of all vectors, whatever their number (an eighth at cosine 0.98), so windows over whole
projections would meet nearly every pair. The vectors of a label are therefore dealt first: each of T tables sorts K further
projections into cells of ``CELL`` s, and only vectors of one cell meet. K grows with the logarithm of the largest label's
vectors, so that a cell holds about ``CELL_ROWS`` unrelated ones, and T so that a pair at the least cosine shares a cell of some table
with a probability of ``RECALL``: work and rows grow as the vectors to the power 1.13, not 2. A pair that shares several cells counts in the first.

Equal vectors are folded into one class first. A cell with more than ``block`` rows is dealt as squares of blocks, so
no task gathers a dense group, and a task hands on counts and star edges only, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import connected_components, local_stars, materialize, remove

COSINE = 0.98
PROJECTIONS = 16
#: Window half-width and cell size in standard deviations of a linked pair's difference at the least cosine.
WIDTH = 1.5
CELL = 7.0
CELL_ROWS = 64
BLOCK = 512
RECALL = 0.9995
_SEED = 20
#: Groups up to this size are compared side by side with others.
_SMALL = 24


def directions(dims: int, n: int, first: int = 0) -> np.ndarray:
    """n unit directions after the first ones, orthogonal as far as the dimensions go."""
    rnd = np.random.default_rng(_SEED + dims)
    out = []
    while len(out) < first + n:
        out += list(np.linalg.qr(rnd.standard_normal((dims, dims)))[0].T)
    return np.array(out[first : first + n]).reshape(n, dims)


def spread(dims: int, cosine: float = COSINE) -> float:
    """Standard deviation of a linked pair's difference on a projection, at the least cosine."""
    return max(1e-9, math.sqrt(max(0.0, 2 - 2 * cosine))) / math.sqrt(dims)


def min_count(n: int = PROJECTIONS, recall: float = RECALL, width: float = WIDTH) -> int:
    """Most collisions that may be asked for while a pair at the least cosine still passes with this probability."""
    p = math.erf(width / math.sqrt(2))
    for k in range(n, -1, -1):
        if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) >= recall:
            return k
    return 0


def tables(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(K, T): projections of a table and tables, for the vectors of the largest label."""
    near = 1 - math.sqrt(2 / math.pi) / CELL  # a linked pair's chance to share a cell of one projection
    far = min(0.95, CELL * math.sqrt(max(0.0, 2 - 2 * cosine)) / (2 * math.sqrt(math.pi)) + 1e-9)  # an unrelated pair's
    k = max(1, math.ceil(math.log(max(1.0, rows / CELL_ROWS)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def usable(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.abs(v).max() > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cells(x: np.ndarray, k: int, t: int, cosine: float = COSINE) -> np.ndarray:
    """The cell of each unit vector in each table, as a number: rows by tables."""
    d = x.shape[1]
    size = CELL * spread(d, cosine)
    shift = np.random.default_rng(_SEED - 1).random(k * t) * size
    at = np.floor((x @ directions(d, k * t, PROJECTIONS).T + shift) / size).astype(np.int64).reshape(len(x), t, k)
    out = np.broadcast_to(np.arange(1, t + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(x), t)).copy()
    for j in range(k):
        out = (out ^ at[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _offers(cosine: float, k: int, t: int):
    """Maps classes (label, dims, cid, n, vec) to rows (label, dims, cell, cid, n, vec), one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            vecs = b.column(4)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                mine = vecs.take(pa.array(own))
                code = cells(_unit(mine.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)), k, t, cosine)
                for j in range(t):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(own)), pa.array(dims[own]), pa.array(np.ascontiguousarray(code[:, j])), b.column(2).take(pa.array(own)), b.column(3).take(pa.array(own)), mine],
                        ["label", "dims", "cell", "cid", "n", "vec"])

    return run


def _windows(p: np.ndarray, q: np.ndarray, h: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query of q, row of p) that collide on at least ``least`` projections: windows by bisection in each sorted one."""
    hits = np.zeros(len(q) * len(p), np.uint8)
    for j in range(p.shape[1]):
        order = np.argsort(p[:, j], kind="stable")
        line = p[order, j]
        lo, hi = np.searchsorted(line, q[:, j] - h, "left"), np.searchsorted(line, q[:, j] + h, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
        hits[np.repeat(np.arange(len(q)) * len(p), n) + order[at]] += 1
    return np.divmod(np.flatnonzero(hits >= least), len(p))


def _search(cosine: float, k: int, t: int, block: int):
    """Maps rows (label, dims, cell, square, side, cid, n, vec) sorted by square to rows (cid, links, other): links counted, or a star edge.

    side: 0 where a square compares all its rows, else 1 or 2 where it compares those of two blocks.
    """
    least = min_count()

    def linked(d: int, group: np.ndarray, side: np.ndarray, cid: np.ndarray, cell: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (i, j) of rows of one group."""
        h = WIDTH * spread(d, cosine) + 1e-12
        p = x @ directions(d, PROJECTIONS).T
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.append(cut, len(group)))
        pairs = [np.empty((2, 0), np.int64)]
        small = np.repeat(size <= _SMALL, size)
        for s in range(1, min(_SMALL, int(size.max()))):
            i = np.flatnonzero(small[:-s] & (group[s:] == group[:-s]))
            i = i[(np.abs(p[i] - p[i + s]) <= h).sum(1) >= least]
            pairs.append(np.stack([i, i + s]))
        for g in np.flatnonzero(size > _SMALL):
            own = np.arange(cut[g], cut[g] + size[g])
            for a in range(0, len(own), block):
                q, of = _windows(p[own], p[own[a : a + block]], h, least)
                q = q + a
                pairs.append(np.stack([own[q], own[of]])[:, q < of])
        i, j = np.concatenate(pairs, 1)
        ok = (cid[i] != cid[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        near = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 15):
            e = slice(s, s + (1 << 15))
            near[e] = np.einsum("ij,ij->i", x[i[e]], x[j[e]]) >= cosine
        i, j = i[near], j[near]
        if len(i):  # a pair counts in the first table in which it shares a cell
            some, at = np.unique(np.r_[i, j], return_inverse=True)
            code = cells(x[some], k, t, cosine)
            first = (code[at[: len(i)]] == code[at[len(i) :]]).argmax(1)
            ok = code[at[: len(i)], first] == cell[i]
            i, j = i[ok], j[ok]
        return i, j

    def found(rows: list[np.ndarray], vecs: pa.Array) -> Iterator[pa.RecordBatch]:
        label, dims, cell, square, side, cid, n = rows
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            group = np.cumsum(np.r_[0, (label[own][1:] != label[own][:-1]) | (cell[own][1:] != cell[own][:-1]) | (square[own][1:] != square[own][:-1])])
            if group[-1] == len(own) - 1:
                continue  # no two meet
            many = np.bincount(group)[group] > 1
            own, group = own[many], group[many]
            x = _unit(vecs.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
            i, j = linked(d, group, side[own], cid[own], cell[own], x)
            if not len(i):
                continue
            who, at = np.unique(np.r_[cid[own][i], cid[own][j]], return_inverse=True)
            links = np.bincount(at, np.r_[n[own][j], n[own][i]]).astype(np.int64)
            u, v = local_stars(cid[own][i], cid[own][j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[who, u]), pa.array(np.r_[links, np.zeros(len(u), np.int64)]), pa.array(np.r_[np.zeros(len(who), np.int64), v], mask=np.r_[np.ones(len(who), bool), np.zeros(len(u), bool)])],
                ["cid", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(c).to_numpy() for c in range(4)])
            last = np.flatnonzero((keys != keys[:, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0
            kept = rows.slice(cut)
            if cut:
                done = rows.slice(0, cut).combine_chunks()
                yield from found([done.column(c).to_numpy() for c in range(7)], done.column(7).combine_chunks())
        if kept is not None:
            done = kept.combine_chunks()
            yield from found([done.column(c).to_numpy() for c in range(7)], done.column(7).combine_chunks())

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector.

    Only vectors with equal labels that aren't null are compared, by cosine in double precision. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do those of other lengths. Repeated
    ids are rows of their own and link like any others; a null id counts as a link but for no component's smallest
    id. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(vec_col)).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    vec = F.col("vec").cast("array<double>")
    fit = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"), F.col(label_col).cast("long").alias("label"))
    src = src.select("vec_id", "label", "vec", F.when(fit, F.xxhash64("label", F.xxhash64(F.lit(1), "vec"), F.xxhash64(F.lit(2), "vec"))).alias("cid"))
    classes, classes_at = materialize(src.where("cid is not null").groupBy("label", "cid").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec")).withColumn("dims", F.size("vec").cast("long")), "classes")
    most = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    k, t = tables(most, cosine)
    offered = classes.select("label", "dims", "cid", "n", "vec").mapInArrow(_offers(cosine, k, t), f"label long, dims long, cell long, cid long, n long, vec {kind}")
    # a cell of many rows becomes squares: each block meets itself and each other one
    cell, zero = ["label", "dims", "cell"], F.lit(0).cast("long")
    big, big_at = materialize(offered.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("long").alias("g")).where("g > 1"), "cells")
    if big.isEmpty():
        dealt = offered.select(*cell, zero.alias("square"), zero.alias("side"), "cid", "n", "vec")
    else:
        own, g = F.pmod(F.xxhash64("cid"), F.col("g")), F.col("g")
        pair = F.transform(F.sequence(zero, g - 1), lambda o: F.struct((F.least(o, own) * g + F.greatest(o, own)).alias("square"), F.when(o == own, zero).when(o < own, zero + 2).otherwise(zero + 1).alias("side")))
        dealt = offered.join(big, cell, "left").withColumn("at", F.explode(F.when(g.isNull(), F.array(F.struct(zero.alias("square"), zero.alias("side")))).otherwise(pair)))
        dealt = dealt.select(*cell, "at.square", "at.side", "cid", "n", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *cell, "square").sortWithinPartitions(*cell, "square")
    found, found_at = materialize(dealt.mapInArrow(_search(cosine, k, t, block), "cid long, links long, other long"), "found")
    roots, roots_at = connected_components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "rep", "n").join(links, "cid", "left").join(roots.withColumnRenamed("v", "cid"), "cid", "left")
    named, named_at = materialize(named.select("cid", "rep", (F.col("n") - 1 + F.coalesce("links", zero)).alias("n_links"), F.coalesce("root", "cid").alias("root")), "named")
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named, _ = materialize(named.join(low, "root").select("cid", "n_links", "component_id"), "named")
    remove(spark, classes_at, big_at, found_at, roots_at, named_at)
    out = src.join(named, "cid", "left").select("vec_id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
