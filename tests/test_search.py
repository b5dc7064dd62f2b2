from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators import search as X
from palimpsest.sources import archive, segments

TEXTS = [
    (1, "The quick brown Fox, the FOX!"), (2, "Un café très noir; cafe noir"), (3, "brown the quick"),
    (4, ""), (5, None), (6, "fox-trot über_alles x"),
]


def index(spark):
    return X.build_index(spark.createDataFrame(TEXTS, "id long, content string"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_positions(spark):
    rows = {(r["token"], r["id"]): r["positions"] for r in index(spark).collect()}
    assert rows[("fox", 1)] == [3, 5] and rows[("the", 1)] == [0, 4] and rows[("cafe", 2)] == [1, 4]
    assert ("uber", 6) in rows and ("trot", 6) in rows and not any(i in (4, 5) for _, i in rows)


def test_queries(spark):
    postings = index(spark)
    assert ids(X.search_all(postings, ["quick", "FOX"])) == [1]
    assert ids(X.search_any(postings, ["fox", "café"])) == [1, 2, 6]
    assert ids(X.search_phrase(postings, "quick brown")) == [1]
    assert ids(X.search_phrase(postings, "the fox")) == [1]
    assert ids(X.search_phrase(postings, "café noir")) == [2]
    assert ids(X.search_prefix(postings, "CA")) == [2]
    assert ids(X.search_not(X.search_any(postings, ["quick"]), X.search_any(postings, ["fox"]))) == [3]
    assert ids(X.search_near(postings, "quick", "fox", 1)) == [1]
    assert ids(X.search_near(postings, "quick", "fox", 0)) == []
    assert ids(X.search_near(postings, "fox", "fox", 1)) == [1]


def test_highlight(spark):
    df = spark.createDataFrame(TEXTS, "id long, content string").select(
        "id", X.highlight("content", ["quick brown", "fox", "cafe"], "[", "]").alias("h")
    )
    got = {r["id"]: r["h"] for r in df.collect()}
    assert got[1] == "The [quick brown] [Fox], the [FOX]!"
    assert got[2] == "Un [café] très noir; [cafe] noir"
    assert got[6] == "[fox]-trot über_alles x"


CHANGE = "id long, content string"


def test_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.write_index(index(spark), path)
    segments.append_changes(spark, path, spark.createDataFrame([(1, "new words"), (2, None), (7, "fox")], CHANGE))
    after = segments.read_index(spark, path)
    assert ids(X.search_any(after, ["fox"])) == [6, 7] and ids(X.search_any(after, ["new"])) == [1]
    assert after.where(F.col("id") == 2).count() == 0
    segments.append_changes(spark, path, spark.createDataFrame([(2, "back again"), (7, None), (1, "the fox")], CHANGE))
    # The state before the last batch can still be read.
    assert ids(X.search_any(segments.read_index(spark, path, 2), ["fox"])) == [6, 7]
    after = segments.read_index(spark, path)
    assert ids(X.search_any(after, ["fox", "back", "new"])) == [1, 2, 6]


def test_null_id_is_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.write_index(X.build_index(spark.createDataFrame([(None, "old"), (1, "old")], CHANGE)), path)
    segments.append_changes(spark, path, spark.createDataFrame([(None, "new")], CHANGE))
    assert sorted((r["token"], r["id"] or 0) for r in segments.read_index(spark, path).collect()) == [("new", 0), ("old", 1)]


def test_merges_keep_the_postings(spark, tmp_path):
    path, rng = str(tmp_path / "index"), random.Random(5)
    texts = {i: f"word{i % 5} the fox" for i in range(60)}
    segments.write_index(X.build_index(spark.createDataFrame(list(texts.items()), CHANGE)), path)
    merges = 0
    for batch in range(6):
        changes = {rng.randrange(80): rng.choice([f"batch{batch} fox", "other words", None]) for _ in range(6)}
        before = max(archive.read_commits(spark, path, segments.TABLES)[0].folders)
        reader = segments.read_index(spark, path)
        expected_before = sorted(reader.collect())
        segments.append_changes(spark, path, spark.createDataFrame(list(changes.items()), CHANGE), merge_at=3)
        # A reader opened before the batch and its merge still sees the old state.
        assert sorted(reader.collect()) == expected_before
        texts |= changes
        live = archive.read_commits(spark, path, segments.TABLES)[0].folders
        merges += before not in live
        assert len(live) <= 6
        whole = X.build_index(spark.createDataFrame(list(texts.items()), CHANGE))
        assert sorted(segments.read_index(spark, path).collect()) == sorted(whole.collect())
    assert merges
    archive.vacuum(spark, path)
    assert sorted(segments.read_index(spark, path).collect()) == sorted(whole.collect())
    assert len(list((tmp_path / "index").glob("data/*/postings/*"))) == len(live)


def test_a_batch_without_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.write_index(index(spark), path)
    before = sorted(segments.read_index(spark, path).collect())

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(segments, "add_commit", die)
        with pytest.raises(OSError):
            segments.append_changes(spark, path, spark.createDataFrame([(1, None)], CHANGE))
    assert sorted(segments.read_index(spark, path).collect()) == before
    segments.append_changes(spark, path, spark.createDataFrame([(1, None)], CHANGE))
    assert not ids(X.search_any(segments.read_index(spark, path), ["quick"])) == ids(X.search_any(index(spark), ["quick"]))


def test_due_segments():
    assert segments.due_segments({0: 1000, 1: 5, 2: 6, 3: 7}) == []
    assert segments.due_segments({0: 1000, 1: 5, 2: 6, 3: 7, 4: 5}) == [1, 2, 3, 4]
    assert segments.due_segments({0: 1000, 1: 20, 2: 1, 3: 30, 4: 40, 5: 50}) == [1, 2, 3, 4, 5]
    # Each posting is written a bounded number of times, and few segments stay.
    rows, written = {0: 64}, 0
    for n in range(1, 400):
        rows[n] = 5
        due = segments.due_segments(rows)
        if due:
            total = sum(rows.pop(s) for s in due)
            rows[due[-1]], written = total, written + total
        assert len(rows) <= 20
    assert written <= 400 * 5 * 8


def test_terms_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.write_index(index(spark), path)
    segments.append_changes(spark, path, spark.createDataFrame([(1, "the quick")], CHANGE))
    for found, pushed in (
        (X.search_all(segments.read_index(spark, path), ["quick", "fox"]), "In(token, [fox,quick])"),
        (X.search_prefix(segments.read_index(spark, path), "ca"), "StringStartsWith(token,ca)"),
    ):
        assert found._jdf.queryExecution().executedPlan().toString().count(pushed) == 2


def test_words_of_ascii_text(spark):
    rows = spark.createDataFrame([(1, " A-b_c9\x00D\x7fE\t"), (2, " A-b_c9\x00D\x7fÉ\t"), (3, None), (4, "--"), (5, "")], "id long, content string")
    got = {r["id"]: r["w"] for r in rows.select("id", tokens("content").alias("w")).collect()}
    assert got == {1: ["a", "b", "c9", "d", "e"], 2: ["a", "b", "c9", "d", "e"], 3: None, 4: [], 5: []}


def test_an_index_is_computed_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def seen(i):
        count.add(1)
        return i

    # Uneven tasks, which a search for ranges reads once more.
    rows = spark.range(3000).select((F.col("id") + 0).alias("id")).repartition(1).union(spark.range(3000, 3001))
    postings = rows.select(F.concat(F.lit("w"), F.col("id")).alias("token"), F.udf(seen, "long")("id").alias("id"), F.array(F.lit(0)).alias("positions"))
    segments.write_index(postings, str(tmp_path / "index"))
    assert count.value == 3001
    assert segments.read_index(spark, str(tmp_path / "index")).count() == 3001


def test_texts_of_one_file_are_spread(spark, tmp_path):
    spark.createDataFrame([(i, "some words") for i in range(100)], "id long, content string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    postings = X.build_index(spark.read.parquet(str(tmp_path / "texts")))
    assert postings.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
