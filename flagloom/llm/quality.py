"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is the set of its hashed features (words, word beginnings, word
endings, its share of repeated words). One weight per hash bucket, shared by all grades, gives a score; a
grade of at most ``k`` has probability ``sigmoid(threshold[k] - score)`` with
ordered thresholds. The fit is batch gradient with a per-weight step and an
L1 penalty, which leaves the uninformative buckets at exactly zero: scoring
looks at a few thousand buckets only, and a long text gathers no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagloom.llm.common import Words, first_ids, mix, slices, windows_hash

BITS = 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(words: Words, bits: int = BITS) -> list[np.ndarray]:
    """Bucket of every word's three features: the lower-cased word without
    trailing punctuation, its first five bytes, its last two bytes and case."""
    if not len(words):
        return [np.zeros(0, np.int64)] * 3
    low = _LOWER[words.data].astype(np.uint64) + np.uint64(1)
    start, end = words.start, words.end
    bare = end.copy()
    for _ in range(3):
        bare -= _MARK[words.data[bare - 1]] & (bare - start > 1)
    last, size = words.data[end - 1].astype(np.uint64), end - start
    before = np.where(size > 1, words.data[np.maximum(end - 2, start)], 0).astype(np.uint64)
    upper = (words.data[start] >= 65) & (words.data[start] <= 90)
    second = words.data[np.minimum(start + 1, end - 1)]
    shape = upper.astype(np.uint64) + (upper & (second >= 65) & (second <= 90))
    kinds = (windows_hash(low, start, bare), windows_hash(low, start, np.minimum(start + 5, bare)),
             (last << np.uint64(16)) + (before << np.uint64(8)) + shape)
    return [(mix(x * np.uint64(4) + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64)
            for i, x in enumerate(kinds)]


def repetition(words: Words, bits: int = BITS) -> np.ndarray:
    """Bucket of every text's share of words that repeat the word before, in tenths rounded up."""
    h = windows_hash(words.data.astype(np.uint64) + np.uint64(1), words.start, words.end)
    again = np.zeros(len(h) + 1, np.int64)
    again[1:-1] = h[1:] == h[:-1]
    inner = words.first[(words.first > 0) & (words.first < len(h))]
    again[inner] = 0  # a text's first word repeats none
    total = np.concatenate(([0], np.cumsum(again[:len(h)])))
    counts = np.diff(words.first)
    tenth = -(-10 * (total[words.first[1:]] - total[words.first[:-1]]) // np.maximum(counts, 1))
    return (mix(tenth.astype(np.uint64) * np.uint64(4) + np.uint64(3)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Ordinal model; ``thresholds`` has one entry fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def rated_sample(ratings: DataFrame, id_col: str, grade_col: str, per_grade: int) -> DataFrame:
    """At most ``per_grade`` rated ids of every grade, least hashes first: the
    documented bound on what the fit sees. Null ids and grades take no part."""
    rated = (ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
             .select(id_col, grade_col).distinct())
    return first_ids(rated, grade_col, id_col, per_grade)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", grades: int = 3, per_grade: int = 2000, bits: int = BITS,
        penalty: float = 2.0, rounds: int = 120) -> Model | None:
    """Fit on a sample of ``grades * per_grade`` rated documents at most.

    Grades are integers from 0. The sample is even by grade and weighted back
    to the grades' true shares. ``None`` if fewer than two grades are rated.
    """
    shares = {r[0]: r[1] for r in ratings.where(F.col(grade_col).between(0, grades - 1))
              .groupBy(grade_col).count().collect()}  # one row per grade
    if len(shares) < 2:
        return None
    sample = rated_sample(ratings.where(F.col(grade_col).between(0, grades - 1)), id_col, grade_col, per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = Words(batch.column("_text"))
            found = np.stack(features(words, bits))
            sets = [np.unique(np.append(found[:, a:b], own)).astype(np.int32).tobytes()
                    for a, b, own in zip(words.first[:-1], words.first[1:], repetition(words, bits))]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(sets, pa.binary())], ["grade", "x"])

    # bounded by grades * per_grade ids, so it may be broadcast
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(sample.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade"))),
                  "_id").select("grade", "_text")
            .mapInArrow(run, "grade int, x binary").collect())
    rows.sort(key=lambda r: (r["grade"], bytes(r["x"])))  # the same fit whatever the tasks' order
    sets = [np.frombuffer(r["x"], np.int32) for r in rows]
    y = np.array([r["grade"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    have = np.bincount(y, minlength=grades)
    weight = np.array([shares.get(k, 0) / max(have[k], 1) for k in range(grades)])[y]
    return learn(sets, y, weight / weight.mean(), grades, bits, penalty, rounds)


def learn(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, grades: int, bits: int,
          penalty: float, rounds: int) -> Model:
    """Proximal AdaGrad on the cumulative-link loss of feature sets."""
    size = 1 << bits
    cols = np.concatenate(sets)
    common = np.bincount(cols, minlength=size) >= 3  # a bucket of one or two texts cannot be learned
    sets = [s[common[s]] for s in sets]
    cols = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    w, gain = np.zeros(size), np.full(size, 1e-8)
    share = np.cumsum(np.bincount(y, weights=weight, minlength=grades))[:-1] / weight.sum()
    share = np.clip(share, 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    for k in range(1, len(theta)):
        theta[k] = max(theta[k], theta[k - 1] + 0.1)
    theta_gain = np.full(len(theta), 1e-8)
    for _ in range(rounds):
        score = np.bincount(rows, weights=w[cols], minlength=len(sets))
        cut = np.concatenate(([-60.0], theta, [60.0]))
        lower, upper = (1 / (1 + np.exp(-np.clip(cut[y + k] - score, -60, 60))) for k in (0, 1))
        p = np.maximum(upper - lower, 1e-9)
        pull = weight * (1 - upper - lower)
        g = np.bincount(cols, weights=pull[rows], minlength=size)
        gain += g * g
        step = 0.5 / np.sqrt(gain)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        push = np.zeros(len(theta) + 2)
        np.add.at(push, y + 1, -weight * upper * (1 - upper) / p)
        np.add.at(push, y, weight * lower * (1 - lower) / p)
        push = push[1:-1]
        theta_gain += push * push
        theta = theta - 0.5 / np.sqrt(theta_gain) * push
        for k in range(1, len(theta)):
            theta[k] = max(theta[k], theta[k - 1] + 0.1)
    return Model(w, theta)


def score_words(words: Words, model: Model) -> np.ndarray:
    """Score of every text: the weights of its feature set."""
    n = len(words.first) - 1
    total, bits = np.zeros(n), len(model.weights).bit_length() - 1
    heavy = model.weights != 0
    found = [(np.arange(n) << bits) | repetition(words, bits)]
    for bucket in features(words, bits):
        at = np.flatnonzero(heavy[bucket])
        doc = np.searchsorted(words.first, at, side="right") - 1
        found.append((doc.astype(np.int64) << bits) | bucket[at])
    pairs = np.unique(np.concatenate(found))  # a feature counts once per text
    np.add.at(total, pairs >> bits, model.weights[pairs & ((1 << bits) - 1)])
    return total


def grade(docs: DataFrame, model: Model | None, text_col: str = "text", target: int = 2,
          least_tail: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_prob`` (P(grade >= target)) and
    ``accepted`` (``tail_prob >= least_tail``).

    A null, empty or blank text has score 0. Without a model nothing can be
    judged: the two figures are null and every row is accepted. Existing
    columns of these names are replaced; no rows give none.
    """
    docs = docs.drop("expected_grade", "tail_prob", "accepted")
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias("expected_grade"),
                           F.lit(None).cast("double").alias("tail_prob"), F.lit(True).alias("accepted"))
    names = docs.columns
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("expected_grade", "double"), ("tail_prob", "double"), ("accepted", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            tails = model.tails(score_words(Words(batch.column(text_col)), model))
            tail = tails[:, target - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least_tail)],
                [*names, "expected_grade", "tail_prob", "accepted"])

    return docs.mapInArrow(run, schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 good; rows without the needed label have no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))
