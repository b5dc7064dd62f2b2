"""Merges into the stored archive: touched buckets only, older states, NULL keys and parents."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import capture as C
from palimpsest.operators.merge import merge_batch
from palimpsest.plans.ordered import newest
from palimpsest.sources import archive

SCHEMA = "id long, parent_id long, ts long, seq long, name string, _extra string"
SHOW = ["id", "parent_id", "ts", "name"]


def by_rows(batches):
    """One row at a time, a batch in order of time and arrival: current rows, older rows, and the result of each row."""
    current, older, results = {}, [], []
    for id_, parent, ts, seq, name, _ in (r for batch in batches for r in sorted(batch, key=lambda r: r[2:4])):
        now = current.get(id_)
        if now is None:
            results.append("first")
        elif now[3] == name:
            results.append("same")
            continue
        elif ts <= now[2]:
            results.append("rejected")
            continue
        else:
            results.append("another")
            older.append(now)
        current[id_] = (id_, parent, ts, name)
    return sorted(current.values(), key=str), sorted(older, key=str), results


def start(spark, path, buckets=8, **more):
    empty = spark.createDataFrame([], SCHEMA)
    archive.write_archive({
        "current": (empty.drop("seq").withColumn("_deleted", F.lit(None).cast("long")), "parent_id", ["id"]),
        "previous": (empty.drop("seq"), "parent_id", ["id", "ts"]),
    }, path, buckets=buckets)


def merge(spark, path, rows, **how):
    return merge_batch(spark, path, spark.createDataFrame(rows, SCHEMA), ["id"], ["name"], immutable=["parent_id"], **how)


def stored(spark, path, name, **how):
    return sorted((tuple(r) for r in archive.read_latest(spark, path, name, SHOW, **how).collect()), key=str)


def files(path, name):
    return {f[len(path):] for f in glob.glob(f"{path}/data/*/{name}/bucket=*/*.parquet")}


def test_batches_equal_a_row_by_row_archive(spark, tmp_path, hot_mode):
    rng = random.Random(4)
    path = str(tmp_path / "archive")
    start(spark, path)
    every, seq = [], 0
    for _ in range(4):
        rows = []
        for _ in range(30):
            id_ = rng.choice([None, *range(8)])
            seq += 1
            ts = 10 * seq if rng.random() < 0.8 else rng.randrange(1, 10 * seq)
            rows.append((id_, None if id_ in (None, 3) else id_ % 3, ts, seq, rng.choice([None, "a", "b"]), None))
        every.append(rows)
        results = merge(spark, path, rows, most_folders=2)
        current, older, want = by_rows(every)
        assert [r["result"] for r in results.orderBy("ts", "seq").collect()] == want[-len(rows):]
        assert stored(spark, path, "current") == current and stored(spark, path, "previous") == older
    # Old states stay readable until they are given up.
    assert len(stored(spark, path, "current", sequence=2)) <= len(current)
    assert archive.vacuum(spark, path) > 0
    assert stored(spark, path, "current") == current and stored(spark, path, "previous") == older
    with pytest.raises(ValueError):
        archive.read_latest(spark, path, "current", sequence=2)
    assert archive.vacuum(spark, path) == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "archive")
    start(spark, path)
    merge(spark, path, [(i, i, 1, i, "a", None) for i in range(40)])
    (before,) = archive.read_commits(spark, path, ["current"])
    on_disk = files(path, "current")
    results = merge(spark, path, [(7, 7, 5, 1, "b", None), (9, 9, 5, 2, "a", None), (11, 11, 0, 3, "c", None)])
    assert sorted(r["result"] for r in results.collect()) == ["another", "rejected", "same"]
    after, older = archive.read_commits(spark, path, ["current", "previous"])
    touched = spark.range(1).select(archive.bucket_of(F.lit(7).cast("long"), 8).alias("b")).first()["b"]
    assert {b for b in after.folders if after.folders[b] != before.folders[b]} == {touched}
    assert on_disk < files(path, "current") and older.folders.keys() == {touched}
    # Nothing kept: no commit, no folder.
    merge(spark, path, [(7, 7, 6, 1, "b", None)])
    assert archive.read_commits(spark, path, ["current"])[0] == after
    archive.vacuum(spark, path)
    assert {f.split("/")[4] for f in files(path, "current")} == {f"bucket={b}" for b in after.folders}
    kept = {os.path.dirname(f)[1:] for f in files(path, "current")}
    assert kept == set(after.paths())
    assert archive.read_children(spark, path, "current", 7).select("name").collect() == [("b",)]


def test_older_rows_are_appended_and_joined_now_and_then(spark, tmp_path):
    path = str(tmp_path / "archive")
    start(spark, path, buckets=1)
    counts = []
    for n in range(5):
        merge(spark, path, [(1, 1, n, n, f"v{n}", None)], most_folders=2)
        (past,) = archive.read_commits(spark, path, ["previous"])
        counts.append(len(past.paths()))
    assert counts == [0, 1, 2, 1, 2]
    assert [r[3] for r in stored(spark, path, "previous")] == [f"v{n}" for n in range(4)]


def test_a_writer_that_read_an_older_state_is_refused(spark, tmp_path):
    path = str(tmp_path / "archive")
    start(spark, path)
    (state,) = archive.read_commits(spark, path, ["current"])
    merge(spark, path, [(1, 1, 1, 1, "a", None)])
    with pytest.raises(RuntimeError):
        archive.add_commit(spark, path, "v", [state])
    assert len(stored(spark, path, "current")) == 1


def test_null_keys_in_all_merges(spark, hot_mode):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    current = frame([(None, 1, "a", None, None), (1, 1, "a", None, None)], "id long, ts long, name string, _extra string, _deleted long")
    previous = frame([], "id long, ts long, name string, _extra string")
    batch = frame([(i, ts, seq, n, None) for seq, (i, ts, n) in enumerate([(None, 2, "a"), (None, 3, "b"), (1, 2, "a"), (1, 3, "b")])],
                  "id long, ts long, seq long, name string, _extra string")
    after, older, results = C.apply_batch(current, previous, batch, ["id"], ["name"])
    assert sorted((tuple(r) for r in after.select("id", "ts", "name").collect()), key=str) == [(1, 3, "b"), (None, 3, "b")]
    assert sorted((tuple(r) for r in older.select("id", "ts", "name").collect()), key=str) == [(1, 1, "a"), (None, 1, "a")]
    assert [r["result"] for r in results.orderBy("seq").collect()] == ["same", "another", "same", "another"]

    stored_members = frame([(None, 5, 1, True, False, 9), (2, None, 1, False, True, 9)],
                           "guild_id long, user_id long, ts long, deaf boolean, mute boolean, joined_at long")
    joins = frame([(None, 5, 2, 1, None, None, 9), (2, None, 2, 2, None, True, 9), (2, None, 3, 3, True, None, 9)],
                  "guild_id long, user_id long, ts long, seq long, deaf boolean, mute boolean, joined_at long")
    filled = C.fill_partial(joins, ["guild_id", "user_id"], ["deaf", "mute"], F.lit(False), latest=newest(
        stored_members, ["guild_id", "user_id"], ["ts"]))
    assert [(r["deaf"], r["mute"]) for r in filled.orderBy("seq").collect()] == [(True, False), (False, True), (True, True)]
    added = C.members_append(stored_members, joins, joins.limit(0), ["deaf", "mute", "joined_at"])
    assert [(r["seq"], r["result"]) for r in added.orderBy("seq").collect()] == [(3, "another")]
