import numpy as np
import pyarrow.parquet as pq
import pytest

from sqlume.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, cell int"


def brute(rows, cosine=0.98):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [k for k, (_, v, y) in enumerate(rows) if y is not None and v is not None and None not in v and embeddings.usable(np.array(v, float))]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k in range(n):
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    return {(rows[k][0], links[k], low[find(k)], rows[k][0] == low[find(k)]) for k in range(n)}


def vectors():
    rnd = np.random.default_rng(4)
    rows = []
    for c in range(25):
        centre = rnd.standard_normal(16)
        for _ in range(int(rnd.integers(1, 12))):
            rows.append((centre + rnd.standard_normal(16) * rnd.choice([0, 0.02, 0.1, 0.17]) * np.linalg.norm(centre) / 4, c % 3))
    dense = rnd.standard_normal(16)
    rows += [(dense + rnd.standard_normal(16) * 0.03, 1) for _ in range(150)]  # one large group
    rows += [(rows[0][0] * 3, rows[0][1]), (rows[1][0], rows[1][1]), (rows[1][0], rows[1][1])]
    out = [(i, v.tolist(), y) for i, (v, y) in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    out += [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 10, out[2][1], None), (n + 11, [1.0, 2.0], 1), (n + 12, [2.0, 4.0], 1), (n + 13, [1e300] * 16, 1), (n + 14, [1e-200] * 16, 1)]
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_matches_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
    want = {(i, n, c, k) for i, n, c, k in brute([r if r[1] is None or None in r[1] or not np.isfinite(np.array(r[1], float)).all() or not len(r[1]) or not np.abs(r[1]).max() else (r[0], (np.array(r[1]) / np.abs(r[1]).max()).tolist(), r[2]) for r in rows])}
    assert got == want


def test_recall_on_the_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()]
    want = {(i, n, c, k) for i, n, c, k in brute(rows)}
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    assert len(got & want) >= 0.999 * len(want) and sum(n for _, n, *_ in got) <= sum(n for _, n, *_ in want)


def test_null_ids_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    got = embeddings.near_duplicates(spark.createDataFrame([(None, v, 1, "", 0), (4, v, 1, "", 0), (4, v, 1, "", 0)], SCHEMA)).collect()
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in got) == [(-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_different_vectors_without_ids_link_like_others(spark):
    rows = [(1, [1.0, 0.0, 0.1], 1), (None, [1.0, 0.0, 0.11], 1), (None, [1.0, 0.0, 0.12], 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 0.01], 1), (7, [0.0, 0.0, 1.0], 1), (7, [0.0, 0.01, 1.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id or -1, r.kept) for r in got) == [
        (-1, 1, -1, False), (-1, 1, -1, False), (-1, 2, 1, False), (-1, 2, 1, False), (1, 2, 1, True), (7, 1, 7, True), (7, 1, 7, True)]


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 64])
def test_recall_at_the_least_cosine(dims):
    """Pairs at cosine 0.98 share a cell and collide often enough, whatever the dimensions and the table's size."""
    rnd, n = np.random.default_rng(dims), 4000
    a = rnd.standard_normal((n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rnd.standard_normal((n, dims))
    b -= (a * b).sum(1)[:, None] * a
    b = a if dims == 1 else 0.98001 * a + np.sqrt(1 - 0.98001**2) * b / np.linalg.norm(b, axis=1)[:, None]
    p = directions = embeddings.directions(dims, embeddings.PROJECTIONS)
    hits = (np.abs((a - b) @ directions.T) <= embeddings.WIDTH * embeddings.spread(dims) + 1e-12).sum(1) >= embeddings.min_count()
    assert len(p) == embeddings.PROJECTIONS and hits.mean() > 0.997
    for rows in (100, 10_000, 10_000_000):
        k, t = embeddings.tables(rows)
        met = (embeddings.cells(a, k, t) == embeddings.cells(b, k, t)).any(1)
        assert (met & hits).mean() > 0.99


def test_windows_equal_dense_counts():
    rnd = np.random.default_rng(3)
    p, q = rnd.standard_normal((60, 9)), rnd.standard_normal((30, 9))
    i, j = embeddings._windows(p, q, 0.8, 5)
    want = np.nonzero((np.abs(q[:, None] - p[None]) <= 0.8).sum(2) >= 5)
    assert np.array_equal(i, want[0]) and np.array_equal(j, want[1])


def test_calibration():
    assert 0 < embeddings.min_count() <= embeddings.PROJECTIONS
    assert embeddings.min_count(recall=0.5) >= embeddings.min_count(recall=0.9999)
    (k, t), (k2, t2) = embeddings.tables(5_000), embeddings.tables(5_000_000)
    assert k < k2 and t < t2 < 100 * t
