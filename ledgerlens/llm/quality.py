"""Quality classifier: ordinal regression with cumulative links over hashed text.

Graded ratings 0 < 1 < ... < K share one weight vector over hashed features of
the text; ordered thresholds cut its score into grades, so that
P(grade >= k) = sigmoid(w . x - threshold_k).  The expected grade is the sum of
these tails, and a document is kept when the probability of the top grade
reaches a cutoff chosen on rows the weights were not fitted to.

The weights are fitted in one task on a bounded sample of the labelled rows
(``sample_rows``, the ones with the smallest seeded hash); all documents are
scored where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import CACHE_BYTES, Cache, own_prefix, prepare, stage, utf8, worker_cache

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 12_000
#: Least chi-square value of a feature that the fit looks at: a constant, and a share of the rows.
SLOT_TEST = (12.0, 0.01)
_UPPER = bytes(range(65, 91))
_MARKS = b"!#$%&*|@^~<>=_"
_EDGE = b".,;:!?\"'()#$%&*|@^~<>=_"


def _slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh32_intdigest(kind + value) % DIMENSIONS


def _word_slots(word: bytes) -> tuple[int, ...]:
    core = word.lower().strip(_EDGE)
    tail = word[len(word.rstrip(_MARKS)) :]
    return tuple({_slot(b"w", core), _slot(b"o", core[:3]), _slot(b"p", core[:4]), _slot(b"q", core[:5]), _slot(b"t", tail)})


class Features:
    """Slots of the features present in a text; those of a word are remembered."""

    def __init__(self):
        self.words = Cache(_word_slots, CACHE_BYTES // 2)  # five numbers a word need about twice what a cache counts

    def __call__(self, text: bytes) -> set[int]:
        words = text.split()
        different = set(words)
        slots = set().union(*map(self.words.__getitem__, different))
        n, size = max(1, len(words)), max(1, len(text))
        shape = {
            b"repeats": 10 * len(different) // n, b"length": n.bit_length(), b"mean": size // n,
            b"upper": 10 * (size - len(text.translate(None, _UPPER))) // size,
            b"marks": min(10, 40 * (size - len(text.translate(None, _MARKS))) // size),
        }
        slots.update(_slot(name, b"%d" % value) for name, value in shape.items())
        return slots


class OrdinalModel:
    """Weights shared by all grades, ordered thresholds, and the cutoff for selection."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cutoff: float):
        self.weights, self.thresholds, self.cutoff = weights, thresholds, cutoff

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, a column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_ordinal(
    rows: list, grades: list[int], top: int, steps: int = 400, rate: float = 0.1, penalty: float = 2e-6,
) -> OrdinalModel:
    """Fit by full-batch Adam; a fifth of the rows is held out to choose the cutoff."""
    grades = np.asarray(grades)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    flat = np.concatenate([np.asarray(rows[i], np.int64) for i in train])
    owner = np.repeat(np.arange(len(train)), [len(rows[i]) for i in train])
    y = grades[train]
    # Rare grades count for more, by a power of their rarity.
    share = np.bincount(y, minlength=top + 1) / len(y)
    weight = 1.0 / np.maximum(share[y], 1e-3) ** 0.75
    weight /= weight.sum()
    # A slot counts when enough documents have it and its documents are graded differently from the others.
    kept_slots = _telling(flat, y[owner], share, len(train))
    known = np.isin(flat, kept_slots)
    used, flat = np.unique(flat[known], return_inverse=True)
    owner = owner[known]
    # Parameters: a weight per used slot, the first threshold, the logarithms of the gaps between thresholds.
    p = np.zeros(len(used) + top)
    first, second = np.zeros_like(p), np.zeros_like(p)
    rate_of = np.full(len(p), rate)
    for step in range(1, steps + 1):
        w, low, gaps = p[: len(used)], p[len(used)], np.exp(p[len(used) + 1 :])
        thresholds = low + np.r_[0.0, np.cumsum(gaps)]
        score = np.bincount(owner, w[flat], len(train))
        tail = np.c_[np.ones(len(train)), _sigmoid(score[:, None] - thresholds), np.zeros(len(train))]
        own = np.maximum(tail[np.arange(len(y)), y] - tail[np.arange(len(y)), y + 1], 1e-9)
        slope = tail * (1 - tail)
        upper, lower = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        to_score = -weight * (upper - lower) / own
        to_threshold = np.zeros(top)
        np.add.at(to_threshold, y[y > 0] - 1, (weight * upper / own)[y > 0])
        np.add.at(to_threshold, y[y < top], -(weight * lower / own)[y < top])
        after = np.cumsum(to_threshold[::-1])[::-1]
        gradient = np.r_[np.bincount(flat, to_score[owner], len(used)) + penalty * w, after[0], after[1:] * gaps]
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        p -= rate_of * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = p[: len(used)]
    thresholds = p[len(used)] + np.r_[0.0, np.cumsum(np.exp(p[len(used) + 1 :]))]
    model = OrdinalModel(weights, thresholds, 0.5)
    if held.any():
        scores = np.array([weights[np.asarray(rows[i], np.int64)].sum() for i in np.flatnonzero(held)])
        model.cutoff = _cutoff(model.tails(scores)[:, -1], grades[held] == top)
    return model


def _telling(flat: np.ndarray, grade: np.ndarray, share: np.ndarray, rows: int) -> np.ndarray:
    """Slots of enough rows whose grades differ from all rows' shares by a chi-square test."""
    many, least = np.bincount(flat, minlength=DIMENSIONS), max(3, rows // 400)
    test = np.zeros(DIMENSIONS)
    for g, s in enumerate(share):
        if s > 0:
            test += (np.bincount(flat[grade == g], minlength=DIMENSIONS) - many * s) ** 2 / np.maximum(many * s, 1e-9)
    return np.flatnonzero((many >= least) & (test >= SLOT_TEST[0] + SLOT_TEST[1] * rows))


def _cutoff(tail: np.ndarray, good: np.ndarray) -> float:
    """The probability that best separates top-graded rows from others (both error rates count alike)."""
    if good.all() or not good.any():
        return 0.5
    grid = np.linspace(0.02, 0.98, 97)
    fair = np.array([((tail >= c) & good).sum() / good.sum() + ((tail < c) & ~good).sum() / (~good).sum() for c in grid])
    best = grid[fair >= fair.max() - 1e-12]
    return float(best[np.argmin(abs(best - 0.5))])


def _features() -> Features:
    features = worker_cache(Features)
    features.words.trim()
    return features


def train_quality(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> OrdinalModel | None:
    """Fit to ratings (doc_id, grade int from 0); rows with null grade or without a document do not count.

    None if there is no rated document.
    """
    spark = docs.sparkSession
    prepare(spark)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["grade", "slots"])
        features.words.forget()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            rows += batch.column("slots").to_pylist()
            grades += batch.column("grade").to_pylist()
        if rows:
            model = fit_ordinal(rows, grades, max(1, max(grades)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()]), pa.array([model.cutoff])],
                names=["weights", "thresholds", "cutoff"])

    # The sample is bounded by sample_rows, so its ids may go to every executor.
    sample = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").select(
        "doc_id", F.col("grade").cast("int").alias("grade"), F.xxhash64(F.lit(seed), "doc_id").alias("place"))
    sample = sample.orderBy("place", "doc_id", "grade").limit(sample_rows)
    rated = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(sample), "doc_id")
    found = rated.select("grade", "text").mapInArrow(slots, "grade int, slots array<int>")
    one = found.repartition(1).sortWithinPartitions("slots", "grade")
    row = one.mapInArrow(fit, "weights binary, thresholds array<double>, cutoff double").first()
    if row is None:
        return None
    return OrdinalModel(np.frombuffer(bytes(row["weights"]), np.float32), np.array(row["thresholds"]), row["cutoff"])


def score_quality(docs: DataFrame, model: OrdinalModel | None, into: str = "quality") -> DataFrame:
    """Every row with a struct ``into``: expected_grade, top_probability (of the best grade), keep.

    All columns of ``docs`` stay, but for one named ``into``.  A null or empty
    text has only the features of its shape; equal texts score alike.  Without
    a model nothing is known against a document: both figures are null and
    keep is true.
    """
    spark = docs.sparkSession
    prepare(spark)
    if model is None:
        unknown = F.lit(None).cast("double")
        return docs.withColumn(into, F.struct(unknown.alias("expected_grade"), unknown.alias("top_probability"), F.lit(True).alias("keep")))
    cutoff = model.cutoff
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds.tolist()))

    @F.pandas_udf("struct<expected_grade:double,top_probability:double,keep:boolean>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value
        features = _features()
        for texts in batches:
            out = []
            for text in texts:
                slots = features(bytes(text))
                total = math.fsum(weights[np.fromiter(slots, np.int64, len(slots))].tolist())
                tails = [0.5 * (1.0 + math.tanh(0.5 * (total - t))) for t in thresholds]
                out.append((sum(tails), tails[-1], tails[-1] >= cutoff))
            features.words.trim()
            yield pd.DataFrame(out, columns=["expected_grade", "top_probability", "keep"])
        # The worker serves other operators next, which need the memory.
        features.words.forget()

    return docs.withColumn(into, score(utf8()))


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Grades: 0 for poor quality, 1 for good but toxic text, 2 for good clean text."""
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNull(), None).when(toxic, 1).otherwise(2).alias("grade"))


def quality_decisions(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, into: str = "quality") -> DataFrame:
    """Train on the labelled documents and score all of them."""
    return score_quality(docs, train_quality(docs, ratings_from_labels(labels), sample_rows), into)


def drop_poor(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, of any name."""
    into = f"{own_prefix(docs)}quality"
    return quality_decisions(docs, labels, sample_rows, into).filter(F.col(into)["keep"]).select(*docs.columns)
