import itertools
import random

import numpy as np

from sqlume.llm import decontam

DOCS, ITEMS = "doc_id long, text string, share double, item_id string", "item_id long, text string, doc_id long"


def brute(docs, items):
    """Every alignment of every item with every document, without seeds."""
    found = {}
    for (d, t), (k, u) in itertools.product(docs, items):
        a, b = decontam.words_of(t), decontam.words_of(u)
        if len(b) < decontam.MIN_ITEM_WORDS:  # found whole and word for word
            if b and any(a[i : i + len(b)] == b for i in range(len(a))):
                found[d, k] = (len(b), len(b))
            continue
        for diag in range(-len(b) + 1, len(a)):
            lo, hi = max(0, diag), min(len(a), diag + len(b))
            same = [a[i] == b[i - diag] for i in range(lo, hi)]
            for x in range(len(same)):
                for y in range(len(same), x, -1):
                    if same[x] and same[y - 1] and y - x >= min(decontam.MIN_WORDS, len(b)) and sum(same[x:y]) >= decontam.MIN_SHARE * (y - x) - 1e-9:
                        found[d, k] = max(found.get((d, k), (0, 0)), (y - x, sum(same[x:y])))
                        break
    return found


def fixture():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 8, 10, 14, 30, 60])))) for i in range(12)]
    docs = []
    for i in range(60):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
        if i % 2:
            cut = items[rnd.randrange(12)][1].split()
            a = rnd.randrange(max(1, len(cut) - 20))
            cut = cut[a : a + rnd.choice([9, 13, 16, 25, 60])]
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                cut[rnd.randrange(len(cut))] = rnd.choice(["other", "Words", rnd.choice(words)])
            at = rnd.randint(0, len(w))
            w[at:at] = cut
        docs.append((i, (", " if i % 3 else " ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    return [*docs, (100, None), (101, ""), (102, docs[1][1])], [*items, (50, None), (51, "")]


def test_matches_brute_force(spark):
    docs, items = fixture()
    want = brute(docs, items)
    left = spark.createDataFrame([(d, t, 0.5, "c") for d, t in docs], DOCS)
    right = spark.createDataFrame([(k, u, 3) for k, u in items], ITEMS)
    for block in (200_000, 50):
        got = {(r.doc_id, r.item_id): (r.n_words, r.n_agree) for r in decontam.overlaps(left, right, block_words=block).collect()}
        assert got == want
    kept = decontam.clean(left, right).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert all(r.share == 0.5 and r.item_id == "c" for r in kept)


def test_all_substitution_patterns_of_short_stretches_are_hit():
    for n in (8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20):
        masks = [np.flatnonzero([c == "1" for c in m]) for m in (decontam.MASKS if n >= decontam.MIN_WORDS else decontam.SHORT_MASKS)]
        for gone in itertools.combinations(range(n), int(n * (1 - decontam.MIN_SHARE) + 1e-9)):
            ok = np.ones(n, bool)
            ok[list(gone)] = False
            assert any(ok[m + s].all() for m in masks for s in range(n - m[-1])), (n, gone)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0.1, "x")], DOCS), spark.createDataFrame([(1, "a b c d e f g h i j", 1)], ITEMS)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.overlaps(docs, none_i).count() == decontam.overlaps(none_d, items).count() == decontam.clean(none_d, items).count() == 0
    assert decontam.clean(docs, none_i).count() == 1


def test_passages_anywhere_in_a_very_long_text_and_many_blocks(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(6)]
    long = [rnd.choice(words) for _ in range(200_000)]
    for k, (_, t) in enumerate(items[:4]):
        at = (0, 70_000, 140_000, 199_960)[k]
        long[at : at + 40] = t.split()
    rows = [(1, " ".join(long)), (2, "x" * 2_000_000), (3, items[5][1])]
    docs, right = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    assert len(decontam.write_blocks(right, block_words=40)) == 6
    for block in (200_000, 40):
        got = {(r.doc_id, r.item_id, r.doc_start, r.n_words, r.n_agree) for r in decontam.overlaps(docs, right, block_words=block).collect()}
        assert got == {(1, 0, 0, 40, 40), (1, 1, 70_000, 40, 40), (1, 2, 140_000, 40, 40), (1, 3, 199_960, 40, 40), (3, 5, 0, 40, 40)}
        assert [r.doc_id for r in decontam.clean(docs, right, block_words=block).collect()] == [2]
    assert decontam.overlaps(docs, right, block_words=40)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
