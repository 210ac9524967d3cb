import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sqlume.llm import packing

SCHEMA = "doc_id long, text string, start string, tier int"


def ids_of(text, tok=Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def hold(rows, docs):
    """The contract: each id in exactly one piece, gapless sequences of at most 2048, right digests."""
    ids = {i: ids_of(t) for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    pad = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.tier == at for r in own)
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad, by_seq


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)).collect()
    pad, by_seq = hold(rows, docs)
    assert pad == 0
    step = {}
    for own in by_seq.values():
        step.setdefault(own[0].step_group, []).append(sum(r.length for r in own))
    assert all(len(set(x)) == 1 and sum(x) <= packing.STEP_TOKENS for x in step.values())


@pytest.mark.parametrize("flush", [packing.FLUSH_TOKENS, 3000])
def test_odd_texts(spark, flush):
    rnd = random.Random(6)
    ts = [None, "", " ", "a", "é" * 9000, "<|endoftext|> x", "日本語 テキスト", "\x00\x1f", "word " * 60_000, "İ́ ﬁ 👩‍👩‍👧   x", *("".join(chr(rnd.choice([32, 65, 97, 48, 10, 233, 0x4E00, 0x1F600])) for _ in range(rnd.randint(1, 3000))) for _ in range(40))]
    docs = list(enumerate(ts))
    pad, _ = hold(packing.pack(spark.createDataFrame([(i, t, "s", 1) for i, t in docs], SCHEMA), flush_tokens=flush).collect(), docs)
    assert pad == 0


def test_fast_and_slow_tokenizers_agree(spark):
    encode = packing.encoder()
    rnd = random.Random(1)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA1, 0x180), 9, 10, 13, 0x2019, 0x2026, 0x20AC, 0x2014)]
    for _ in range(400):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 200)))
        assert encode(t).tolist() == ids_of(t)[:-1].tolist()


def test_both_libraries_give_the_same_ids_for_every_given_document():
    encode, slow = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted({t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()})
    for i in range(0, len(texts), 500):
        for t, e in zip(texts[i : i + 500], slow.encode_batch(texts[i : i + 500], add_special_tokens=False)):
            assert np.array_equal(encode(t), np.array(e.ids, "<u4")), t


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = packing.pack(spark.createDataFrame([(None, "a b", "s", 1), (3, "c", "s", 1), (3, "c", "s", 1)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1) for r in rows if r.start == 0) == [-1, 3, 3]
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(0, 2048, (100, 2048))
