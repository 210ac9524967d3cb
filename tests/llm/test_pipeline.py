import sys
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from sqlume.llm import decontam, packing, toxicity  # noqa: E402
from test_packing import hold  # noqa: E402
from test_nearcopies import kept as heads  # noqa: E402

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def kept(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    items = [(r.item_id, decontam.words_of(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            want = {r.doc_id for r in rows if model.at_least(__import__("numpy").array([model.scorer()(r.text)]))[0, 0] < toxicity.REJECT_AT}
        elif name == "simhash":
            want = set(heads([(r.doc_id, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]))
        elif name == "decontamination":
            texts = {r.doc_id: " ".join(decontam.words_of(r.text)) for r in rows}
            exact = {i for i, t in texts.items() if any(" ".join(ws) in t for _, ws in items)}
            assert not exact & set(kept(out)) and len(rows) - out.count() <= 3 * len(exact) + 3
            want = set(kept(out))
        else:
            want = {r.doc_id for r in rows}
        if name == "packing":
            pad, _ = hold(out.collect(), [(r.doc_id, r.text) for r in rows])
            assert pad == 0
        else:
            got = kept(out)
            assert set(got) == want and out.columns == columns and 0 < len(got) <= len(rows)
            if name == "secrets":
                assert all(r.n_chars == len(r.text or "") for r in got.values() if r.text is not None)
        docs = out
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, "x", "m"), (None, "a b c d", "en", "s", 7, "x", "m"), (2, "", "en", None, 0, "y", "m"), (3, "w " * 50_000, "en", "s", 1, "y", "m"), (4, "a b c d", "de", "s", 7, "z", "m"), (4, "a b c d", "de", "s", 7, "z", "m")]])
@pytest.mark.parametrize("on_files", [True, False])
def test_stages_take_all_kinds_of_rows(spark, tmp_path, rows, on_files):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, file string, _metadata string")
    if on_files:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert out.count() >= len(rows)
        else:
            assert out.columns == docs.columns
            # null and empty text are one group, the three rows of "a b c d" another
            assert out.count() == (3 if rows and name == "simhash" else len(rows))

