"""Greedy longest-match token counts through a linear automaton.

A trie of the vocabulary gets, for every node, a failure link and the number of tokens popped on the way: when no
child fits the next character, the count grows by that number and matching goes on at the linked node, without
looking at a character twice and without building the pieces. Each word is read with the vocabulary's word-start
mark in front. A character that no piece covers counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 500_000
CACHED_CHARS = 48


class Automaton:
    """Linear-time longest-match counter for a vocabulary of pieces."""

    def __init__(self, pieces: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        weight: list[int] = [0]  # tokens that the node's string is, if it is a piece
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                v = self.next[v][c]
            if v:
                weight[v] = 1
        for c, v in self.next[0].items():
            weight[v] = weight[v] or len(c.encode("utf-8", "surrogatepass"))
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = [0]
        for u in queue:  # breadth first: links lead to shorter strings
            for c, v in self.next[u].items():
                queue.append(v)
                if weight[v]:
                    self.fail[v], self.popped[v] = 0, weight[v]
                    continue
                z, n = self.fail[u], self.popped[u]
                while c not in self.next[z] and z:
                    n += self.popped[z]
                    z = self.fail[z]
                if c in self.next[z]:
                    self.fail[v], self.popped[v] = self.next[z][c], n
                else:  # a character that begins no piece, after all before it was popped
                    self.fail[v], self.popped[v] = 0, n + len(c.encode("utf-8", "surrogatepass"))

    def count(self, text: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        v = n = 0
        for c in text:
            while c not in step[v] and v:
                n += popped[v]
                v = fail[v]
            if c in step[v]:
                v = step[v][c]
            else:
                n += len(c.encode("utf-8", "surrogatepass"))
        while v:
            n += popped[v]
            v = fail[v]
        return n


@functools.cache
def automaton(path: str | None = None) -> Automaton:
    """For the ordinary pieces of a sentencepiece model file."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return Automaton([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_words, n_tokens, max_word_tokens) per document.

    Words are what lies between white space. Null and empty texts have zeros; repeated rows and null ids keep their
    rows; an empty table gives none; other columns are ignored. A word's length does not matter: time is linear.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = automaton(model).count, {}

        def tokens(word: str) -> int:
            n = seen.get(word)
            if n is None:
                n = count(MARK + word)
                if len(word) <= CACHED_CHARS:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[word] = n
            return n

        for b in batches:
            rows = np.zeros((3, b.num_rows), np.int64)
            for i, t in enumerate(b.column(1)):
                if words := (t.as_py() or "").split():
                    each = list(map(tokens, words))
                    rows[:, i] = len(words), sum(each), max(each)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows)], ["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_tokens long, max_word_tokens long")
