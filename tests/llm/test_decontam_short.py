import random

from sqlume.llm import decontam


def test_short_items_are_found_whole_and_word_for_word(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rnd.choice(words) for _ in range(n))) for n in range(2, 8)] + [(20, "これは短い問題文です"), (21, "..."), (22, None)]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(60))) for k in range(40)]
    for k, (i, u) in enumerate(items[:7]):
        w = u.split()
        docs += [(100 + k, f"x {u.upper()}, y z"), (200 + k, u), (300 + k, " ".join([*w[:-1], "other"])), (400 + k, " ".join(w[:-1])), (500 + k, " ".join(w[-1:]))]
        docs += [(600 + k, " ".join([w[0], "other", *w[2:]]))] if len(w) > 2 else []
    docs += [(700, None), (701, ""), (702, "これは短い問題文です。 次の文")]
    want = set()
    for d, t in docs:
        a = decontam.words_of(t)
        for i, u in items:
            b = decontam.words_of(u)
            at = next((p for p in range(len(a) - len(b) + 1) if a[p : p + len(b)] == b), None) if b else None
            if at is not None:
                want.add((d, i, at, len(b), len(b), 1.0))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 10):
        assert {tuple(r) for r in decontam.overlaps(left, right, block_words=block).collect()} == want
    assert {r.doc_id for r in decontam.clean(left, right).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert {20} | set(range(2, 8)) == {w[1] for w in want}
