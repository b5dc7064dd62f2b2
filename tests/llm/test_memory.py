"""What text work holds at once: Arrow batches, counted columns, features."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_join, quality
from palimpsest.llm.textops import BATCH_BYTES, BATCH_SETTING, in_small_batches, slices, utf8


def peak(run) -> tuple[int, object]:
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def largest_batch(df):
    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return df.mapInArrow(measure, "n long").agg(F.max("n")).first()[0]


def test_batches_follow_the_bytes_of_the_rows(spark):
    docs = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("x"), 3000).alias("text"))
    assert largest_batch(docs) > 5 * BATCH_BYTES
    assert in_small_batches(largest_batch)(docs) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH_SETTING, None) is None
    with pytest.raises(ZeroDivisionError):
        in_small_batches(lambda df: 1 / 0)(docs)
    assert spark.conf.get(BATCH_SETTING, None) is None


def test_a_sessions_own_setting_stands(spark):
    spark.conf.set(BATCH_SETTING, "123456")
    try:
        assert in_small_batches(lambda df: df.sparkSession.conf.get(BATCH_SETTING))(spark.range(1)) == "123456"
        assert spark.conf.get(BATCH_SETTING) == "123456"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_jobs_of_the_join_run_in_small_batches(spark, monkeypatch):
    seen, real = [], ngram_join.staged

    def noted(df, name):
        seen.append(df.sparkSession.conf.get(BATCH_SETTING, None))
        return real(df, name)

    monkeypatch.setattr(ngram_join, "staged", noted)
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (2, "x")]
    groups = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen and set(seen) == {str(BATCH_BYTES)}
    assert {r.doc_id: r.component_id for r in groups.collect()} == {0: 0, 1: 0, 2: 2}
    assert spark.conf.get(BATCH_SETTING, None) is None


@pytest.mark.parametrize("n", [0, 1, 50_000])
def test_columns_are_counted_exactly(n):
    rng = np.random.default_rng(n)
    parts, step = 7, -(-(1 << ngram_join.COUNTED_BITS) // 7)
    values = rng.integers(0, 1 << ngram_join.COUNTED_BITS, n, dtype=np.uint64)
    values = np.concatenate([values, np.repeat(values[: n // 3], 9)])
    blobs = [ngram_join.packed_columns(list(np.array_split(half, 5)), parts, step) for half in np.array_split(values, 2)]
    found = [ngram_join.added_columns([(c[p], k[p]) for c, k in blobs], p * step, 8) for p in range(parts)]
    every, counts = np.unique(values, return_counts=True)
    assert np.array_equal(np.concatenate([c for c, _ in found]), every[counts > 8].astype(np.int64))
    assert np.array_equal(np.concatenate([k for _, k in found]), counts[counts > 8])


def test_counting_holds_few_bytes_for_each_column():
    rng = np.random.default_rng(1)
    n, blobs, step = 1_000_000, [], 1 << ngram_join.COUNTED_BITS
    for _ in range(4):
        held = np.array_split(rng.integers(0, 1 << ngram_join.COUNTED_BITS, n // 4, dtype=np.uint64), 10)
        columns, counts = ngram_join.packed_columns(held, 1, step)
        assert held == []
        blobs.append((columns[0], counts[0]))
    most, _ = peak(lambda: ngram_join.added_columns(blobs, 0, 8))
    assert blobs == [] and most < 45 * n


def test_features_are_made_for_few_texts_at_once():
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(1500)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    model = quality.OrdinalModel(rng.normal(size=1 << quality.BITS), np.array([0.0, 1.0]))
    most, scores = peak(lambda: [model.scores(p.column(0))[0] for p in slices(batch, "text", quality.SCORED_BYTES)])
    assert most < 100e6
    assert np.array_equal(np.concatenate(scores), model.scores(texts)[0])
    assert len(utf8(texts)[0]) > 2 * quality.SCORED_BYTES
