import random

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlume.llm import tokencount


def brute(pieces, text):
    have, longest, i, n = set(pieces), max(map(len, pieces), default=0), 0, 0
    while i < len(text):
        k = next((k for k in range(min(longest, len(text) - i), 0, -1) if text[i : i + k] in have), 0)
        n += 1 if k else len(text[i].encode())
        i += k or 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=5), max_size=12), st.text("abcédル", max_size=40))
def test_counts_equal_greedy_longest_match(pieces, text):
    assert tokencount.Automaton(pieces).count(text) == brute(pieces, text)


def test_real_vocabulary_on_words():
    auto = tokencount.automaton()
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    words = {w for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() for w in (r["text"] or "").split()}
    for w in random.Random(1).sample(sorted(words), min(2_000, len(words))):
        assert auto.count(tokencount.MARK + w) == brute(pieces, tokencount.MARK + w)


def test_rows_of_all_kinds(spark):
    schema = "doc_id long, text string, n_tokens string"
    long = "a" * 200_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello  world", "x"), (3, "hello  world", "x"), (None, long, "x"), (5, " \n\t", "x")], schema)
    got = {(r.doc_id, r.n_words, r.n_tokens > 0, r.max_word_tokens <= r.n_tokens) for r in tokencount.token_counts(df).collect()}
    assert got == {(1, 0, False, True), (2, 0, False, True), (3, 2, True, True), (None, 1, True, True), (5, 0, False, True)}
    assert tokencount.token_counts(df).count() == 6 and tokencount.token_counts(spark.createDataFrame([], schema)).count() == 0
