"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k). Features are words and
word beginnings, with the logarithm of their counts as values, and the text's length; the fit is L1-regularised, so few features carry
weight and long harmless texts gather none. The model is fitted on at most ``max_train`` labelled documents (chosen
by a hash of their ids) and broadcast; scoring is a map over all documents. Features are counted on the executors: the
driver gets the candidates' names and the counts of those in each text, never a text.

The labels only say whether a text is toxic, so the ordered grades are degrees of how much of a text is: 0 is a text
labelled clean, 2 one labelled toxic, and 1 one labelled toxic among ``DILUTED`` clean ones, whose counts are added to its own. Expected
severity thus grows with the share of toxic text, not with how bad its words are, of which the labels say nothing. The
weights and the first threshold are fitted on the labelled texts, the second threshold on all three grades with those
weights: mixtures in the fit of the weights made it worse at telling toxic texts from clean ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlume.llm.common import materialize, remove

MAX_TRAIN = 6_000
MAX_FEATURES = 384
MIN_DOCS = 3
L1 = 0.6
REJECT_AT = 0.5
GRADES = 3
#: Clean texts put beside a toxic one to make a text of grade 1.
DILUTED = 2
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
#: Feature whose count is that of all words, so that few hits weigh less in a long text than in a short one.
LENGTH = "#words"
_CACHE = 100_000


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in _STEMS if len(word) > k)]


def counts_of(text: str | None) -> Counter:
    c: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        c[LENGTH] += n
        for f in features_of(w):
            c[f] += n
    return c


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by feature and ordered thresholds; without thresholds nothing is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        if not self.thresholds:
            return np.zeros((len(scores), GRADES - 1))
        return _sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])

    def scorer(self):
        """A function from text to its score w.x."""
        seen: dict[str, tuple[str, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hits: Counter = Counter()
            words = _WORD.findall((text or "").lower())
            if LENGTH in weights and words:
                hits[LENGTH] = len(words)
            for w in words:
                own = seen.get(w)
                if own is None:
                    own = tuple(f for f in features_of(w) if f in weights)
                    if len(w) <= 48:
                        if len(seen) >= _CACHE:
                            seen.clear()
                        seen[w] = own
                for f in own:
                    hits[f] += 1
            return sum(weights[f] * float(np.log1p(n)) for f, n in sorted(hits.items()))

        return score


def feature_counts(rows: Iterable[tuple[str | None, int]], most: int = 200_000) -> Iterator[dict[str, list[int]]]:
    """In parts: how many of the texts have a feature, and how many of those are toxic."""
    out: dict[str, list[int]] = {}
    for text, label in rows:
        for f in counts_of(text):
            n = out.setdefault(f, [0, 0])
            n[0] += 1
            n[1] += label > 0
        if len(out) >= most:
            yield out
            out = {}
    yield out


def gain_of(k, p, n, pos):
    """How strongly a feature of k of n texts, p of them toxic, speaks for the pos toxic ones; columns or numbers."""
    return (p * n - k * pos) * (p * n - k * pos) / (k * pos * (n - k + 1e-9) * (n - pos))


def fit(texts: list[str], labels: list[int], max_features: int = MAX_FEATURES, l1: float = L1, rounds: int = 60) -> Model:
    """The ordinal model for texts labelled 0 or 1; equal texts count once, as toxic if one of them is."""
    once: dict[str, int] = {}
    for t, y in zip(texts, labels):
        once[t or ""] = max(once.get(t or "", 0), int(y > 0))
    n, pos = len(once), sum(once.values())
    if not pos or pos == n:
        return Model()
    found = next(feature_counts(once.items(), 1 << 62))
    gain = {f: gain_of(k, p, n, pos) for f, (k, p) in found.items() if f != LENGTH and p >= MIN_DOCS and p * n > k * pos}
    names = sorted(gain, key=lambda f: (-gain[f], len(f), f))[: 4 * max_features]
    few = {LENGTH, *names}
    return fit_counts([({f: c for f, c in counts_of(t).items() if f in few}, y) for t, y in sorted(once.items())], names, max_features, l1, rounds)


def fit_counts(rows: list[tuple[dict[str, int], int]], names: list[str], max_features: int = MAX_FEATURES, l1: float = L1, rounds: int = 60) -> Model:
    """The ordinal model for the counts of the named features in each text, and its label; names in the order of their gain."""
    if not names:
        return Model()
    rows = sorted(rows, key=lambda r: (sorted(r[0].items()), r[1]))  # whatever order they come in
    bags, n = [bag for bag, _ in rows], len(rows)
    held: dict[str, list] = {f: [] for f in names}
    for r, bag in enumerate(bags):
        for f, c in bag.items():
            if f != LENGTH:
                held[f].append((r, c))
    first: dict[tuple, str] = {}
    for f in names:  # a word and its beginnings often have the same counts everywhere: the shortest stands for all
        first.setdefault(tuple(held[f]), f)
    names = [*list(first.values())[:max_features], LENGTH]
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((n, len(names)), np.float32)
    for r, bag in enumerate(bags):
        for f, c in bag.items():
            if f in at:
                x[r, at[f]] = np.log1p(c)
    above = np.array([[y] for _, y in rows], np.float32)

    # Newton steps; the L1 penalty is a ridge that is weighted anew each step
    k = len(names)
    w, theta = np.zeros(k), np.array([2.0])

    def loss(w: np.ndarray, theta: np.ndarray) -> float:
        z = (x @ w)[:, None] - theta
        return float(np.where(above > 0, np.logaddexp(0, -z), np.logaddexp(0, z)).sum() + l1 * np.abs(w).sum())

    now = loss(w, theta)
    for _ in range(rounds):
        p = _sigmoid((x @ w)[:, None] - theta)
        d, h = p - above, p * (1 - p) + 1e-9
        pull = l1 / (np.abs(w) + 1e-2)
        grad = np.r_[x.T @ d.sum(1) + pull * w, -d.sum(0)]
        hess = np.zeros((k + 1, k + 1))
        hess[:k, :k] = (x * h.sum(1).astype(np.float32)[:, None]).T @ x
        hess[:k, :k][np.diag_indices(k)] += pull
        hess[:k, k:] = -(x.T @ h)
        hess[k:, :k] = hess[:k, k:].T
        hess[k:, k:] = np.diag(h.sum(0) + 1e-3)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-3 and (then := loss(w - size * move[:k], theta - size * move[k:])) > now:
            size /= 2
        if size <= 1e-3 or now - then < 1e-4:
            break
        w, theta, now = w - size * move[:k], theta - size * move[k:], then
    model = Model({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3})
    score = lambda bag: sum(model.weights[f] * float(np.log1p(c)) for f, c in sorted(bag.items()) if f in model.weights)
    clean, toxic = [bag for bag, y in rows if not y], [bag for bag, y in rows if y]
    mixed = []
    for i, bag in enumerate(toxic):
        mixed.append(Counter(bag))
        for j in range(DILUTED):
            mixed[-1].update(clean[(i * DILUTED + j) % len(clean)])
    full, less = (np.array([score(b) for b in bags]) for bags in (toxic, [*clean, *mixed]))
    lo, hi = float(theta[0]), float(theta[0]) + 40
    for _ in range(60):  # the threshold at which as many texts are expected above it as are
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _sigmoid(full - mid).sum() + _sigmoid(less - mid).sum() > len(full) else (lo, mid)
    model.thresholds = (float(theta[0]), lo)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Fits on at most max_train labelled ids. Null ids and labels are left out; of several labels of an id or text the highest counts."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("_i"), (F.col(label_col).cast("int") > 0).cast("int").alias("_y")).where("_i is not null and _y is not null")
    own = own.groupBy("_i").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_i"), "_i").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("_i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(own), "_i")
    texts = texts.groupBy(F.xxhash64("_t").alias("_h")).agg(F.any_value("_t").alias("_t"), F.max("_y").alias("_y"))
    texts, path = materialize(texts.repartition(-(-max_train // 400)), "labelled")  # few bytes, but each is read twice for many features

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1)))
        for part in feature_counts(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.string()), *(pa.array([c[k] for c in part.values()], pa.int64()) for k in range(2))], ["f", "k", "p"])

    n, pos = texts.agg(F.count("*"), F.coalesce(F.sum((F.col("_y") > 0).cast("long")), F.lit(0))).first()
    if not pos or pos == n:
        remove(spark, path)
        return Model()
    counts = texts.select("_t", "_y").mapInArrow(count, "f string, k long, p long").groupBy("f").agg(F.sum("k").cast("double").alias("k"), F.sum("p").cast("double").alias("p"))
    best = counts.where((F.col("f") != LENGTH) & (F.col("p") >= MIN_DOCS) & (F.col("p") * n > F.col("k") * pos)).select("f", gain_of(F.col("k"), F.col("p"), float(n), float(pos)).alias("gain"))
    names = [r[0] for r in best.orderBy(F.desc("gain"), F.length("f"), "f").limit(4 * max_features).collect()]
    few = {LENGTH: len(names), **{f: i for i, f in enumerate(names)}}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [{few[f]: c for f, c in counts_of(t.as_py()).items() if f in few} for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([list(x) for x in bags], pa.list_(pa.int32())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int64()))], ["h", "y", "at", "n"])

    # at most max_train rows of at most 4 * max_features + 1 counts
    rows = texts.select("_t", "_h", "_y").mapInArrow(bag, "h long, y int, at array<int>, n array<long>").orderBy("h").collect()
    remove(spark, path)
    all_ = [*names, LENGTH]
    return fit_counts([({all_[i]: c for i, c in zip(r["at"], r["n"])}, r["y"]) for r in rows], names, max_features)


def _scores(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for s in batches:
            yield s.map(of, na_action=None).astype(float) if len(s) else s.astype(float)

    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)
    return score(text.cast("string"))


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """One row (doc_id, p_mild, p_severe, severity, grade, toxic) per document.

    severity is the expected grade, the sum of P(grade >= k); toxic says whether P(grade >= 1) reaches reject_at.
    Null and empty texts have no features and score the bare thresholds; repeated rows and null ids keep their rows;
    an empty table gives none; other columns are ignored. A model without thresholds finds nothing toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        of = m.scorer()
        for b in batches:
            p = m.at_least(np.fromiter((of(t.as_py()) for t in b.column(1)), float, b.num_rows))
            grade = (p >= 0.5).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1)), pa.array(grade), pa.array(p[:, 0] >= reject_at)],
                ["doc_id", "p_mild", "p_severe", "severity", "grade", "toxic"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, p_mild double, p_severe double, severity double, grade int, toxic boolean")


def harmless(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that are not rejected, with all their columns, without a shuffle."""
    if not model.thresholds:
        return docs
    limit = model.thresholds[0] + float(np.log(reject_at / (1 - reject_at)))
    return docs.where(_scores(model, F.col(text_col)) < limit)
