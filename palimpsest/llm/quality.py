"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds on the score separate them:
P(grade <= k) = logistic(threshold_k - score). A document is kept when P(grade >= ``good``) reaches ``least``.

Features are hashed words, triples of bytes, and words that follow themselves, each group as shares of the
document, so a score needs one pass over the whole text. The model is fitted on at most ``fit_rows`` rated
documents, those with the smallest hashes of their ids; every document is scored.

Defined results: of several ratings of a document the lowest grade counts; NULL ratings and ratings of
unknown documents count for nothing; a text without words (NULL, empty) has tail probability 0 and expected grade 0;
with no usable rating, or ratings of one grade only, all texts with words are kept with probability 1; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import LETTERS, LOWER, SLICE_BYTES, give_back, mixed, slices, utf8, with_fields, word_bounds, word_hashes

BITS = 18
FIT_ROWS = 3000
STEPS = 500
SCALE = 30.0
LEAST = 0.5
# 0 leaves the features as they are, 0.5 gives all the same variance.
EVEN = 0.25
# Bytes of text whose features are made at once, about a hundred bytes for each of text.
SCORED_BYTES = SLICE_BYTES // 4


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature number, value and text of every feature of the texts, and the number of words of each text."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, text = word_bounds(low, offsets, LETTERS)
    words = np.bincount(text, minlength=n)
    hashes = word_hashes(low, starts, ends)
    groups = [(hashes, text)]
    if len(data) > 2:
        three = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        whole = owner[:-2] == owner[2:]
        groups.append((mixed(three[whole] + np.uint64(1 << 24)), owner[:-2][whole]))
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    groups.append((np.full(len(again), 0x5EED << 48, np.uint64), text[again]))
    kept = [(h >> np.uint64(64 - bits)).astype(np.int64) for h, _ in groups]
    sizes = [np.bincount(t, minlength=n) for _, t in groups]
    sizes[-1] = words  # repeats as a share of the words
    values = [SCALE / np.maximum(s, 1)[t] for s, (_, t) in zip(sizes, groups)]
    return np.concatenate(kept), np.concatenate(values), np.concatenate([t for _, t in groups]), words


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(column)
        number, value, text, words = features(data, offsets, self.bits)
        return np.bincount(text, self.weights[number] * value, minlength=len(words)), words

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(number: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, top: int,
        bits: int = BITS, steps: int = STEPS, rate: float = 4.0, ridge: float = 1e-3,
        least_seen: int = 10) -> OrdinalModel:
    """Penalised maximum likelihood by accelerated gradient steps; thresholds are a first one and positive gaps."""
    # Features of few documents only learn their noise; the others are brought closer in scale.
    seen = np.bincount(number, minlength=1 << bits) >= least_seen
    power = np.bincount(number, value * value, minlength=1 << bits) / len(grade)
    scale = np.where(seen, (power + 1e-9) ** -EVEN, 0.0)
    used = seen[number]
    number, row, value = number[used], row[used], (value * scale[number])[used]
    w, w_before = np.zeros(1 << bits), np.zeros(1 << bits)
    free, free_before = np.concatenate([[-1.0], np.zeros(top - 1)]), np.concatenate([[-1.0], np.zeros(top - 1)])
    n = len(grade)
    norms = np.bincount(row, value * value, minlength=n)
    rate, pace = rate / (np.quantile(norms, 0.9) + 1.0), 0.2
    best, since = (np.inf, w, free), 0
    for _ in range(steps):
        push = since / (since + 3.0)
        w_at, free_at = w + push * (w - w_before), free + push * (free - free_before)
        gaps = np.exp(free_at[1:])
        cut = np.concatenate([[-np.inf], free_at[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, w_at[number] * value, minlength=n)
        above = 1 / (1 + np.exp(-np.clip(cut[grade + 1] - score, -500, 500)))
        below = 1 / (1 + np.exp(-np.clip(cut[grade] - score, -500, 500)))
        p = np.maximum(above - below, 1e-12)
        loss = float(-np.log(p).mean() + ridge / 2 * (w_at @ w_at))
        if not loss <= best[0] + 0.01:
            # A step that leads uphill is taken back, and the next ones are shorter.
            rate, pace, since = rate / 2, pace / 2, 0
            w = w_before = best[1]
            free = free_before = best[2]
            continue
        if loss < best[0]:
            best = (loss, w_at, free_at)
        since += 1
        d_above, d_below = above * (1 - above) / p, below * (1 - below) / p
        per_cut = np.zeros(top + 2)
        np.add.at(per_cut, grade + 1, -d_above / n)
        np.add.at(per_cut, grade, d_below / n)
        tail = np.cumsum(per_cut[1:-1][::-1])[::-1]
        slope = np.bincount(number, ((d_above - d_below) / n)[row] * value, minlength=len(w)) + ridge * w_at
        w_before, free_before = w, free
        w = w_at - rate * slope
        free = free_at - pace * np.clip(np.concatenate([[tail[0]], tail[1:] * gaps]), -0.5, 0.5)
    _, w, free = best
    thresholds = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
    return OrdinalModel(w * scale, thresholds, bits)


def train(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade",
          fit_rows: int = FIT_ROWS, bits: int = BITS) -> OrdinalModel | None:
    """The model of at most ``fit_rows`` rated documents; None where there is nothing to learn."""
    place = F.xxhash64(F.col("_id"))
    chosen = (
        ratings.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg(F.min(grade).cast("int").alias("_grade"))
        .orderBy(place, "_id").limit(fit_rows)
    )

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for part in slices(batch, "_text", SCORED_BYTES):
                number, value, row, words = features(*utf8(part.column(2)), bits)
                key, where = np.unique(row * (1 << bits) + number, return_inverse=True)
                summed = np.bincount(where, value, minlength=len(key))
                ends = np.searchsorted(key, np.arange(len(words) + 1) << bits).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(words),
                    pa.ListArray.from_arrays(ends, pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(summed.astype(np.float32))),
                ], names=["_id", "_grade", "_words", "_number", "_value"])
        give_back()

    # At most fit_rows ids are sent to the executors.
    rated = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = (
        rated.select("_id", "_grade", "_text")
        .mapInArrow(featurize, "_id long, _grade int, _words long, _number array<int>, _value array<float>")
        .where("_words > 0").orderBy(place, "_id", F.xxhash64("_number", "_value")).limit(fit_rows).toArrow()
    )
    grades = rows["_grade"].to_numpy()
    levels = np.unique(grades)
    if len(levels) < 2:
        return None
    number = rows["_number"].combine_chunks()
    sizes = np.diff(number.offsets.to_numpy())
    return fit(
        number.flatten().to_numpy().astype(np.int64), rows["_value"].combine_chunks().flatten().to_numpy().astype(float),
        np.repeat(np.arange(len(grades)), sizes), grades.astype(np.int64), int(levels[-1]), bits,
    )


def classify(docs: DataFrame, ratings: DataFrame, *, good: int, doc_id: str = "doc_id", text: str = "text",
             grade: str = "grade", least: float = LEAST, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with _expected_grade, _tail_probability = P(grade >= good) and _kept."""
    model = train(docs, ratings, doc_id=doc_id, text=text, grade=grade, fit_rows=fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_expected_grade", "_tail_probability", "_kept")
    schema = with_fields(docs, "_expected_grade double, _tail_probability double, _kept boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = shared.value
        for batch in batches:
            for part in slices(batch, text, SCORED_BYTES):
                column = part.column(part.schema.get_field_index(text))
                if known is None:
                    words = features(*utf8(column))[3]
                    tails = np.ones((len(words), good))
                else:
                    score, words = known.scores(column)
                    tails = known.tails(score)
                tails = np.where((words > 0)[:, None], tails, 0.0)
                tail = tails[:, good - 1] if good <= tails.shape[1] else np.zeros(len(words))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tails.sum(1)), pa.array(tail), pa.array((tail >= least) & (words > 0))],
                    names=[*part.schema.names, "_expected_grade", "_tail_probability", "_kept"],
                )
        give_back()

    return docs.mapInArrow(judge, schema)
