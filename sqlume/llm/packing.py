"""Hierarchical multi-length packing of tokenized documents into training sequences.

A document's whole windows of ``max_len`` tokens become sequences of their own; its rest is routed to the smallest
context tier that holds it. Tiers are packed from the longest down: every window starts with a rest of its tier,
its gap is filled best-fit with rests of shorter tiers and finally by cutting one of them, so that windows end up
exactly full. Tier sizes are powers of two, so full windows of any tier need no padding; what remains of a partition
is cut into powers of two. Sequences of a tier are dealt into step groups of equal token count, the costliest
(sum of squared piece lengths) next to the cheapest.

Packing is local to an input partition: no shuffle, no gathering, memory bounded by ``flush_tokens``. A task that
runs again on the same input partition packs the same way.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EOS = 1
MAX_LEN = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 1 << 14
FLUSH_TOKENS = 1 << 21
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Characters on which the two libraries are tested to split alike; other texts go to the reference tokenizer.
_PLAIN = re.compile("[^\t\n\r -~¡-ſ‐-‧‰-⁞₠-₿]")


@functools.cache
def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids of the byte-level BPE in a tokenizers JSON file, without special tokens added.

    Where the same vocabulary lies beside it as ranks, plain texts are encoded with those (same ids, faster).
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    fast = None
    if os.path.exists(ranks) and ranks != path:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and "<|endoftext|>" not in text and not _PLAIN.search(text):
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


class Packer:
    """Packs documents given one after the other; flush() and finish() yield rows of pieces."""

    def __init__(self, first_id: int, max_len: int = MAX_LEN, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        if any(t & (t - 1) for t in tiers) or max(tiers) != max_len:
            raise ValueError("tiers are powers of two up to max_len")
        self.max_len, self.tiers, self.step_tokens = max_len, tuple(sorted(tiers)), step_tokens
        self.next_id, self.next_step = first_id, first_id
        self.docs: list[tuple] = []  # (doc_id, ids)
        self.pool: list[tuple[int, int, int]] = []  # (rest length, document, start), sorted
        self.made: list[list[tuple[int, int, int]]] = []  # sequences of (document, start, length)
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        k = len(self.docs)
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)
        whole = len(ids) // self.max_len * self.max_len
        self.made += [[(k, s, self.max_len)] for s in range(0, whole, self.max_len)]
        if whole < len(ids):
            self.pool.append((len(ids) - whole, k, whole))

    def _fill(self, size: int, head: tuple[int, int, int]) -> None:
        """One full window of ``size`` that begins with ``head``; the pool has tokens enough."""
        pool, gap, out = self.pool, size - head[0], [(head[1], head[2], head[0])]
        while gap:
            at = bisect_right(pool, (gap, len(self.docs), 0)) - 1
            if at >= 0:
                n, k, s = pool.pop(at)
            else:  # all that is left is longer than the gap: cut the shortest
                n, k, s = pool.pop(0)
                insort(pool, (n - gap, k, s + gap))
                n = gap
            out.append((k, s, n))
            gap -= n
        self.made.append(out)

    def _pack(self, last: bool) -> None:
        self.pool.sort()
        have = sum(n for n, _, _ in self.pool)
        for size, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0]):
            while self.pool and self.pool[-1][0] > below and have >= size:
                head = self.pool.pop()
                if head[0] > size:
                    insort(self.pool, (head[0] - size, head[1], head[2] + size))
                    head = (size, *head[1:])
                self._fill(size, head)
                have -= size
        while last and have:  # less than the smallest window, or rests longer than all that is left
            size = 1 << (have.bit_length() - 1)
            size = min(size, self.max_len)
            head = self.pool.pop()
            if head[0] > size:
                insort(self.pool, (head[0] - size, head[1], head[2] + size))
                head = (size, *head[1:])
            self._fill(size, head)
            have -= size

    def flush(self, last: bool = False) -> dict[str, list]:
        self._pack(last)
        rows: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
        by_tier: dict[int, list[int]] = {}
        for q, seq in enumerate(self.made):
            by_tier.setdefault(sum(n for _, _, n in seq), []).append(q)
        step = {}
        for size, own in by_tier.items():
            groups = -(-len(own) * size // self.step_tokens)
            own.sort(key=lambda q: -sum(n * n for _, _, n in self.made[q]))
            for r, q in enumerate(own):  # there and back again
                turn, at = divmod(r, groups)
                step[q] = self.next_step + (groups - 1 - at if turn % 2 else at)
            self.next_step += groups
        for q, seq in enumerate(self.made):
            offset, size = 0, sum(n for _, _, n in seq)
            for k, s, n in seq:
                doc_id, ids = self.docs[k]
                for c, v in zip(rows, (doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), self.next_id, offset, size, step[q])):
                    rows[c].append(v)
                offset += n
            self.next_id += 1
        keep = sorted({k for _, k, _ in self.pool})
        to = {k: i for i, k in enumerate(keep)}
        self.docs = [self.docs[k] for k in keep]
        self.pool = [(n, to[k], s) for n, k, s in self.pool]
        self.made, self.tokens = [], 0
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, tiers: tuple[int, ...] = TIERS,
         flush_tokens: int = FLUSH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null text counts as empty; every document ends with id 1, so an empty one is a single token. Each id lies in
    exactly one piece, sequences are gapless. A null doc_id stays null and repeated rows are packed once each. An
    empty table gives no rows; other columns are ignored. sequence_id and step_group are unique within the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, max_len, tiers)
        end = np.array([EOS], "<u4")

        def out(last: bool) -> pa.RecordBatch:
            schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in COLUMNS.split(", ")])
            return pa.RecordBatch.from_pydict(packer.flush(last), schema)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                packer.add(i.as_py(), np.concatenate([encode(t.as_py() or ""), end]))
                if packer.tokens >= flush_tokens:
                    yield out(False)
        yield out(True)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, COLUMNS)
