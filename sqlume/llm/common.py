"""Helpers shared by the training-data operators: shared storage, lineage cuts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a file whose places are kept together.
CHUNK_ROWS = 1 << 20
#: Star edges of a graph that one task finishes.
PART_EDGES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where it is unset a temporary one, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sqlume-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths in whatever store they name."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors, unlike a local checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these edges as stars: every vertex but the smallest of its component, with that one."""
    ids, ix = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ix[: len(u)], ix[len(u) :], np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _partition_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars."""
    held = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for b in batches:
        for k in range(2):
            held[k].append(b.column(k).to_numpy(zero_copy_only=False))
    u, v = local_stars(*map(np.concatenate, held))
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], ["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """Components of an undirected graph given as (a long, b long): one row (v, root) per vertex that has an edge; and the path behind it.

    root is the smallest vertex of the component. Every partition turns its own edges into stars first. A graph of up to
    ``PART_EDGES`` star edges, the most that any task takes of one, then fits in one partition and is done there.
    Larger ones alternate large-star and small-star steps, in which every vertex points its larger (or all) neighbours
    at its smallest neighbour, until they fit or don't change. Minimums are combined map-side, and each round is cut in shared
    storage. Loops, repeated and null edges are ignored.

    The minimums are grouped by (u, a function of u), which makes the same groups, but an exchange that the join by u
    can't use: so both of its sides come straight from exchanges, the shape in which the adaptive skew join splits a
    vertex with very many neighbours over tasks.
    """
    spark = edges.sparkSession

    def cut(df: DataFrame) -> tuple[DataFrame, str, dict]:
        seen = Observation()
        marks = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        df, path = materialize(df.mapInArrow(_partition_stars, "u long, v long").observe(seen, *marks), "cc")
        return df, path, seen.get

    cur, path, now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    side, before = F.pmod(F.hash("u"), F.lit(2)).alias("side"), None
    for _ in range(max_rounds):
        last = now["n"] <= PART_EDGES
        if last:
            small = cur.coalesce(1)
        else:
            both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u", side).agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m")
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = large.distinct()
            # small-star: u > v in every row of `large`
            low = large.groupBy("u", side).agg(F.min("v").alias("m")).select("u", "m")
            small = large.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
            )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt, npath, now = cut(small)
        remove(spark, path)
        cur, path = nxt, npath
        if last or now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return stars.union(cur.select("v", F.col("v").alias("root")).distinct()), path


def place_of(df: DataFrame) -> tuple[Column, Column]:
    """Where a row lies: its file's hash and its place there; a column of df named like the metadata is not mistaken for it."""
    meta = df.metadataColumn("_metadata")
    return F.xxhash64(meta["file_path"]), meta["row_index"].cast("long")


def located(df: DataFrame, *columns) -> DataFrame | None:
    """columns of a DataFrame that reads files, after (file, pos): each row's place. None where rows have no place."""
    try:
        file, pos = place_of(df)
        return df.select(file.alias("file"), pos.alias("pos"), *columns)
    except AnalysisException:
        return None


class Places:
    """Longs by place: files in the shared folder, each with the sorted places and values of a stretch of one file of a table."""

    def __init__(self, folder: str, width: int) -> None:
        self.folder, self.width = folder, width

    def __getstate__(self) -> tuple:
        return self.folder, self.width

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _listed(self, key: tuple[int, int]) -> np.ndarray | None:
        if not hasattr(self, "kept"):
            (self.fs, self.base), self.kept, self.rows = pafs.FileSystem.from_uri(self.folder), {}, 0
        if key not in self.kept:
            path = f"{self.base}/{key[0]}-{key[1]}"
            if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
                self.kept[key] = None
            else:
                with self.fs.open_input_file(path) as f:
                    got = np.frombuffer(zlib.decompress(f.read()), "<i8").reshape(1 + self.width, -1)
                if self.rows + got.shape[1] > 2 * CHUNK_ROWS:
                    self.kept.clear()
                    self.rows = 0
                self.kept[key], self.rows = got, self.rows + got.shape[1]
        return self.kept[key]

    def look(self, file: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places are listed, and their values: a row for each of the widths."""
        out, there = np.zeros((self.width, len(file)), np.int64), np.zeros(len(file), bool)
        for own in {*zip(file.tolist(), (pos >> 20).tolist())}:
            got = self._listed(own)
            if got is not None:
                here = np.flatnonzero((file == own[0]) & (pos >> 20 == own[1]))
                want = pos[here] & (CHUNK_ROWS - 1)
                at = np.minimum(np.searchsorted(got[0], want), got.shape[1] - 1)
                hit = got[0, at] == want
                there[here] = hit
                out[:, here[hit]] = got[1:, at[hit]]
        return there, out


def write_places(places: DataFrame, names: tuple[str, ...]) -> Places | None:
    """The places of places(file, pos, *names), each listed once, with their values; None if there are none. They are dealt by file."""
    spark = places.sparkSession
    folder = scratch(spark, "places")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = len(names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        key, held, done = None, [], 0

        def close() -> None:
            part = f"{base}/{uuid.uuid4().hex}.part"  # appears whole; a task that runs again writes the same
            with fs.open_output_stream(part, compression=None) as f:
                f.write(zlib.compress(np.concatenate(held, 1).astype("<i8").tobytes(), 1))
            fs.move(part, f"{base}/{key[0]}-{key[1]}")

        for b in batches:
            cols = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3 + k)]) if b.num_rows else np.empty((3 + k, 0), np.int64)
            cut = np.flatnonzero(np.r_[True, (cols[0, 1:] != cols[0, :-1]) | (cols[1, 1:] != cols[1, :-1])]) if b.num_rows else []
            for i, j in zip(cut, [*cut[1:], b.num_rows]):
                own = (int(cols[0, i]), int(cols[1, i]))
                if own != key:
                    if key is not None:
                        close()
                    key, held = own, []
                    done += 1
                held.append(cols[2:, i:j])
        if key is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    dealt = places.select("file", F.shiftright("pos", 20).alias("chunk"), F.col("pos").bitwiseAND(CHUNK_ROWS - 1).alias("at"), *[F.col(c).cast("long") for c in names])
    made = dealt.repartition(n, "file", "chunk").sortWithinPartitions("file", "chunk", "at").mapInArrow(write, "files long")
    return Places(folder, k) if made.agg(F.sum("files")).first()[0] else None


def looked_up(df: DataFrame, places: DataFrame, names: tuple[str, ...], as_: str) -> DataFrame | None:
    """df with a struct of longs for each row at a place in places(file, pos, *names), null elsewhere; None if there are no places.

    Nothing of df is shuffled: reading df again, each task looks up the places of what it reads.
    """
    own = write_places(places, names)
    if own is None:
        return None
    names = names or ("there",)
    kind = ", ".join(f"{c}: bigint" for c in names)

    @F.arrow_udf(f"struct<{kind}>")
    def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for file, pos in batches:
            there, out = own.look(*(np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (file, pos)))
            cols = out if len(out) else [there.astype(np.int64)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in cols], list(names), mask=pa.array(~there))

    return df.withColumn(as_, look(*place_of(df)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def drop_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """df without the rows at the places in gone(file, pos), all columns kept and nothing of df shuffled."""
    own = free_name(df, "gone")
    found = looked_up(df, gone, (), own)
    return df if found is None else found.where(F.col(own).isNull()).drop(own)
