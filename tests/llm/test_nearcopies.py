import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from sqlume.llm import nearcopies  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)["simhash"]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """First of each group over all pairs, rows in the order of their ids."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if similarity(sets[i], sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(r[0] for k, r in enumerate(rows) if find(k) == k)


def planted():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 600))]
        for _ in range(rnd.randint(1, 4)):
            c = list(base)
            for _ in range(rnd.choice((0, 1, len(base) // 60, len(base) // 45, len(base) // 10))):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            rows.append(" ".join(c))
    chain = [rnd.choice(words) for _ in range(300)]  # each is near the one before it, the last far from the first
    for k in range(25):
        chain[k * 12] = f"new{k}"
        rows.append("  ".join(chain).upper())
    rows += [None, "", " \n\t", "a b c d e f g h", "a b c d e f g i", "a b c d e f g h i", "A  b c d", "a b c d"]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


def test_stage_drops_planted_near_copies_and_nothing_else(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = sorted(r.doc_id for r in STAGE(spark, spark.read.parquet(str(tmp_path / "d")), "").collect())
    assert got == kept(rows) and 60 < len(got) < len(rows) - 60


def crowd(n=420):
    """One large group of near copies of one text, some of which are near only to each other or to nothing."""
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(900)]
    base = [rnd.choice(words) for _ in range(240)]
    rows = []
    for _ in range(n):
        c = list(base)
        for _ in range(rnd.choice((1, 2, 3, 4, 5, 6, 7))):
            c[rnd.randrange(len(c))] = rnd.choice(words)
        rows.append(" ".join(c))
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("cluster_rows, bucket_rows", [(512, 8192), (40, 64), (7, 64)])
def test_blocks_of_large_clusters_and_squares_of_large_buckets_lose_nothing(spark, tmp_path, monkeypatch, cluster_rows, bucket_rows):
    monkeypatch.setattr(nearcopies, "CLUSTER_ROWS", cluster_rows)
    monkeypatch.setattr(nearcopies, "BUCKET_ROWS", bucket_rows)
    rows = crowd()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = sorted(r.doc_id for r in nearcopies.one_each(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == kept(rows) and 1 < len(got) < len(rows) / 2


def test_links_between_connect_what_all_near_pairs_connect():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0, 0.05, 0.12]), rnd.integers(0, 2**63, 60, dtype=np.uint64), base)) for _ in range(int(rnd.integers(2, 12)))]
        n = len(sets)
        query, offer, group = rnd.random(n) < 0.6, rnd.random(n) < 0.8, rnd.integers(0, 2 * n, n)

        def closed(pairs):
            label = group.tolist()
            for i, j in pairs:
                label = [label[i] if x == label[j] else x for x in label]
            return [[x == y for y in label] for x in label]

        tried = [(i, j) for i in range(n) for j in range(n) if i != j and query[i] and offer[j] and nearcopies.jaccard(sets[i], sets[j]) >= 0.8]
        assert closed(nearcopies.links_between(sets, group, query, offer)) == closed(tried)


def test_recall_on_the_given_documents(spark):
    """Of all near pairs of the table, found by an inverted index of shingles, the groups hold nearly all."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").orderBy("doc_id").collect()]
    want = kept_by_index(rows)
    got = {r.doc_id for r in nearcopies.one_each(spark.read.parquet(path)).collect()}
    assert want <= got and len(got - want) <= 0.01 * (len(rows) - len(want)) + 1


def kept_by_index(rows):
    """kept() for many rows: only pairs that share a shingle are tried."""
    sets, at, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, s in enumerate(sets):
        near = {}
        for x in s:
            for i in at.setdefault(x, []):
                near[i] = near.get(i, 0) + 1
            at[x].append(j)
        for i, both in near.items():
            if both / (len(s) + len(sets[i]) - both) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    empty = [k for k, s in enumerate(sets) if not s]
    return {rows[k][0] for k in range(len(rows)) if find(k) == k and (sets[k] or k == empty[0])}


def test_rows_of_one_id_with_unrelated_texts_stay(spark, tmp_path):
    rows = [(1, "a b c"), (1, "other words here"), (1, "a b c"), (None, "a b c"), (None, "q r s"), (None, "q r s"), (None, "t u v")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    out = STAGE(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in out) == [(0, "q r s"), (0, "t u v"), (1, "a b c"), (1, "other words here")]
