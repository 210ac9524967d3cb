import functools

import numpy as np
import pyarrow.parquet as pq

from sqlume.llm import toxicity

SCHEMA = "doc_id long, text string, grade string, toxic int"
DATA = "/root/testdata/sf0.1"


@functools.cache
def labelled():
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    return [(texts[r["doc_id"]], r["toxic"]) for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["toxic"] is not None]


@functools.cache
def half():
    """The model of every other labelled text."""
    rows = labelled()
    return toxicity.fit([t for t, _ in rows[::2]], [y for _, y in rows[::2]])


def test_held_out_accuracy():
    rows, model = labelled(), half()
    seen = {t for t, _ in rows[::2]}
    rest = [(t, y) for t, y in rows[1::2] if t not in seen]
    p = model.at_least(np.array([model.scorer()(t) for t, _ in rest]))
    y, said = np.array([y for _, y in rest]), p[:, 0] >= toxicity.REJECT_AT
    assert (p[:, 0] >= p[:, 1]).all()
    assert (said & (y == 1)).sum() >= 0.92 * y.sum() and (said & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_scores_and_stage_agree_with_the_formula(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").limit(3000), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    ts = [None, "", "word " * 100_000, *[t for t, y in labelled() if y][:20], *[t for t, y in labelled() if not y][:20]]
    df = spark.createDataFrame([(i if i != 4 else None, t, "g", 1) for i, t in enumerate([*ts, ts[4]])], SCHEMA)
    rows = toxicity.severity(df, model).collect()
    assert len(rows) == len(ts) + 1
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ts):
            p = model.at_least(np.array([sum(model.weights.get(f, 0) * np.log1p(n) for f, n in toxicity.counts_of(ts[r.doc_id]).items())]))[0]
            assert np.allclose([r.p_mild, r.p_severe, r.severity], [p[0], p[1], p.sum()]) and r.toxic == (p[0] >= toxicity.REJECT_AT)
    bad = {r.doc_id for r in rows if r.toxic}
    kept = toxicity.harmless(df, model).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows} - bad and all(r.grade == "g" for r in kept)


def test_tables_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b", "g", 0), (None, None, "g", 0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    labels = "doc_id long, toxic int, text string"
    for own in ([], [(1, None, "x")], [(None, 1, "x")], [(1, 0, "x")], [(1, 1, "x"), (1, 0, "x")], [(99, 1, "x")]):
        model = toxicity.train(docs, spark.createDataFrame(own, labels))
        assert not any(r.toxic for r in toxicity.severity(docs, model).collect()) and toxicity.harmless(docs, model).count() == 2
    model = toxicity.train(none, spark.createDataFrame([(1, 1, "x")], labels))
    assert toxicity.severity(none, model).count() == toxicity.harmless(none, model).count() == 0


def test_training_on_executors_equals_training_on_lists(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(texts[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None]
    want, got = toxicity.fit([t for t, _ in rows], [y for _, y in rows]), toxicity.train(docs, labels)
    assert want.weights and set(want.weights) == set(got.weights)
    assert all(abs(w - got.weights[f]) < 1e-3 for f, w in want.weights.items()) and np.allclose(want.thresholds, got.thresholds, atol=1e-3)


def test_severity_follows_the_share_of_toxic_text():
    """Held out: severity is low for clean texts, higher for toxic ones among clean ones, highest for toxic ones, and grows with each toxic text put to a clean one."""
    rows, model = labelled(), half()
    score = model.scorer()

    def severity(text):
        return float(model.at_least(np.array([score(text)])).sum())

    clean, toxic = [t for t, y in rows[1::2] if not y], [t for t, y in rows[1::2] if y]
    diluted = [" ".join([t, *clean[3 * i : 3 * i + 3]]) for i, t in enumerate(toxic)]
    mean = [np.mean([severity(t) for t in ts]) for ts in (clean, diluted, toxic)]
    assert model.thresholds[0] <= model.thresholds[1] and mean[0] < 0.1 and mean[0] + 0.5 < mean[1] < mean[2]
    short = [t for t in toxic if len(t) < 3000]
    steps = np.mean([[severity(" ".join([c, *short[i : i + k]])) for k in range(4)] for i, c in enumerate(clean[:60])], 0)
    assert (np.diff(steps) > 0).all()
