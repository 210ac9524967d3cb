import random

import numpy as np
import pytest

from sqlume.llm import simhash

SCHEMA = "doc_id long, text string, fp string, rep long"


def brute(rows, limit=3):
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 300))] for _ in range(40)]
    rows = []
    for b in base:
        for k in range(rnd.randint(1, 5)):
            c = list(b)
            for _ in range(k % 3):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            rows.append(" ".join(c))
    big = [rnd.choice(words) for _ in range(600)]
    for _ in range(60):  # one large group of near copies
        c = list(big)
        c[rnd.randrange(len(c))] = rnd.choice(words)
        rows.append(" ".join(c))
    return [*rows, None, "", " \t\n", "A b", "a B", "x" * 100_000]


@pytest.mark.parametrize("bucket_limit", [512, 8])
def test_matches_brute_force(spark, bucket_limit):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in simhash.near_duplicates(df, bucket_limit=bucket_limit).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "", 0), (1, "a b c", "", 0), (None, "a b c", "", 0), (None, "q r s", "", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_equals_scan():
    rnd = np.random.default_rng(3)
    centre = rnd.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (30, 40, 3)).astype(np.uint64)
    words = np.unique(np.concatenate([(centre[:, None] ^ np.bitwise_xor.reduce(flips, 2)).ravel(), rnd.integers(0, 2**63, 500, dtype=np.uint64)]))
    found = set()
    for i, j in simhash.GrayIndex(words).search(words, 3):
        found |= set(zip(i.tolist(), j.tolist()))
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 3
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_fingerprint_of_one_shingle_is_its_hash():
    import xxhash

    assert simhash.fingerprint("A  b\tc") == xxhash.xxh64_intdigest(b"a b c", 42)
