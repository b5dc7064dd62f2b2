from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import capture as C
from palimpsest.operators.temporal import as_of_join
from palimpsest.plans.ordered import find_hot_keys, newest

SCHEMA = "id long, ts long, seq long, v string, _extra string"


def results(rows, spark, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    marked = C.classify_snapshots(df, ["id"], C.state_of(["v"]), **how)
    return {r["seq"]: r["result"] for r in marked.collect()}


@pytest.mark.parametrize("first,second,expected", [
    (("a", None), ("a", None), "same"),
    (("a", None), ("b", None), "another"),
    ((None, None), (None, None), "same"),
    (("a", '{"x":1,"y":[1]}'), ("a", '{"y":[1],"x":1.0}'), "same"),
    (("a", '{"x":1}'), ("a", '{"x":2}'), "another"),
    (("a", '{"x":null}'), ("a", None), "another"),
])
def test_equality(spark, first, second, expected):
    got = results([(1, 2, 1, *first), (1, 4, 2, *second)], spark)
    assert got == {1: "first", 2: expected}


def test_not_newer_is_rejected_unless_equal(spark, hot_mode):
    rows = [(1, 2, 1, "a", None), (1, 2, 2, "b", None), (1, 2, 3, "a", None), (1, 4, 4, "a", None), (1, 6, 5, "b", None)]
    assert results(rows, spark) == {1: "first", 2: "rejected", 3: "same", 4: "same", 5: "another"}


def test_late_rows_against_stored(spark, hot_mode):
    stored = spark.createDataFrame([(1, 10, 0, "a", None)], SCHEMA)
    rows = [(1, 9, 1, "b", None), (1, 8, 2, "a", None), (1, 12, 3, "a", None), (1, 14, 4, "c", None), (2, 1, 5, "z", None)]
    assert results(rows, spark, latest=stored) == {1: "rejected", 2: "same", 3: "same", 4: "another", 5: "first"}


def one_by_one(rows):
    """What the archive does, row by row."""
    last, out = {}, {}
    for id_, ts, seq, v, extra in sorted(rows, key=lambda r: (r[1], r[2])):
        if id_ not in last:
            out[seq], last[id_] = "first", (ts, v)
        elif last[id_][1] == v:
            out[seq] = "same"
        elif ts <= last[id_][0]:
            out[seq] = "rejected"
        else:
            out[seq], last[id_] = "another", (ts, v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_row_by_row(spark, hot_mode, seed):
    rng = random.Random(seed)
    # A third of the rows belong to one key; times tie often.
    rows = [
        (0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.randrange(60), seq, rng.choice(["a", "b", None]), None)
        for seq in range(400)
    ]
    # Ties with a rejected row between equal ones differ from the rule only in arrival order.
    assert results(rows, spark) == one_by_one(rows)


def test_hot_keys_are_found(spark):
    spark.conf.set("spark.palimpsest.hotKeyRows", "50")
    df = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("k"))
    (hot,) = find_hot_keys(df, ["k"])
    spark.conf.unset("spark.palimpsest.hotKeyRows")
    assert hot.table.count() == 1 and hot.slices == 2


def test_every_hot_key_has_its_own_slices(spark):
    spark.conf.set("spark.palimpsest.hotKeyRows", "2")
    df = spark.range(9000).select(F.when(F.col("id") < 40, None).otherwise(F.floor(F.col("id") / 3)).alias("k"))
    (hot,) = find_hot_keys(df, ["k"])
    spark.conf.unset("spark.palimpsest.hotKeyRows")
    # NULL holds 40 rows and is cut into 32 slices, thousands of others into 2.
    assert {r["_doublings"]: r["count"] for r in hot.table.groupBy("_doublings").count().collect()} == {5: 1, 1: 2986}


def test_null_keys(spark, hot_mode):
    rows = [(None if i % 2 else 3, 2 * (i // 2) + 2, i, "aabbcc"[i // 2 % 6], None) for i in range(48)]
    kept = C.compact_snapshots(spark.createDataFrame(rows, SCHEMA).repartition(5), ["id"], ["v"])
    found = {k: [] for k in (None, 3)}
    for r in sorted(kept.collect(), key=lambda r: r.ts):
        found[r.id].append((r.v, r.result))
    want = [("a", "first")] + [(v, "another") for v in "bcabcabcabc"]
    assert found == {None: want, 3: want}


def test_as_of_join_with_null_keys(spark, hot_mode):
    facts = spark.createDataFrame([(None if i % 2 else 1, 10 * i) for i in range(12)], "k long, ms long")
    versions = spark.createDataFrame([(None if i % 2 else 1, 2 * 20 * i, f"n{i}") for i in range(8)], "k long, ts long, name string")
    got = as_of_join(facts, versions, ["k"], ["name"])
    want = {}
    for i in range(12):
        past = [j for j in range(8) if j % 2 == i % 2 and 20 * j <= 10 * i]
        want[(None if i % 2 else 1, 10 * i)] = f"n{max(past)}" if past else None
    assert {(r.k, r.ms): r.name for r in got.collect()} == want


def test_compacting_twice_is_once(spark):
    rows = [(i % 3, 2 * i, i, "ab"[i % 5 > 2], None) for i in range(60)]
    once = C.compact_snapshots(spark.createDataFrame(rows, SCHEMA), ["id"], ["v"]).drop("result")
    twice = C.compact_snapshots(once, ["id"], ["v"]).drop("result")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_two_batches_are_one(spark, hot_mode):
    rows = [(i % 4, 2 * i + 2, i, "abc"[(i * i) % 3], None) for i in range(80)]
    empty = spark.createDataFrame([], "id long, ts long, v string, _extra string, _deleted long")
    none = spark.createDataFrame([], "id long, ts long, v string, _extra string")

    def run(batches):
        current, previous = empty, none
        for batch in batches:
            current, previous, _ = C.apply_batch(current, previous, spark.createDataFrame(batch, SCHEMA), ["id"], ["v"])
        return sorted(map(str, current.collect())), sorted(map(str, previous.collect()))

    assert run([rows]) == run([rows[:30], rows[30:]])
    # Running a batch again changes nothing.
    assert run([rows]) == run([rows, rows[-4:]])


def test_immutables_and_deletion_stay(spark):
    current = spark.createDataFrame([(1, "text", 2, "a", None, 9)], "id long, kind string, ts long, v string, _extra string, _deleted long")
    previous = spark.createDataFrame([], "id long, ts long, v string, _extra string")
    batch = spark.createDataFrame([(1, "voice", 4, 1, "b", None), (2, "text", 4, 2, "c", None)],
                                  "id long, kind string, ts long, seq long, v string, _extra string")
    after, before, _ = C.apply_batch(current, previous, batch, ["id"], ["v"], immutable=["kind"])
    assert sorted(map(tuple, after.collect())) == [(1, "text", 4, "b", None, 9), (2, "text", 4, "c", None, None)]
    assert [tuple(r) for r in before.collect()] == [(1, 2, "a", None)]


MEMBER = "guild_id long, user_id long, ts long, seq long, nick string, deaf boolean, mute boolean, joined_at long"


def test_members(spark, hot_mode):
    joins = spark.createDataFrame([
        (1, 1, 2, 1, "n", True, None, 5),    # first, mute never known
        (1, 1, 4, 2, "n", None, None, 5),    # deaf comes from before: the same
        (1, 1, 8, 4, "n", None, False, 6),   # rejoined: deaf is forgotten
        (1, 1, 10, 5, "m", None, None, 6),   # another nick, mute carried
    ], MEMBER)
    leaves = spark.createDataFrame([
        (1, 1, 6, 3), (1, 1, 7, 33), (1, 2, 3, 9),  # leaves, leaves again, one never seen
    ], "guild_id long, user_id long, ts long, seq long")
    state = ["nick", "deaf", "mute", "joined_at"]
    kept = C.members_append(None, joins, leaves, state).orderBy("user_id", "ts").collect()
    assert [(r["user_id"], r["ts"], r["nick"], r["deaf"], r["mute"]) for r in kept] == [
        (1, 2, "n", True, None), (1, 6, None, None, None), (1, 8, "n", None, False), (1, 10, "m", None, False),
        (2, 3, None, None, None),
    ]


def test_sync_members_twice(spark):
    history = spark.createDataFrame([(1, 1, 2, "a", 5), (1, 2, 2, "b", 5), (1, 3, 2, None, None)],
                                    "guild_id long, user_id long, ts long, nick string, joined_at long")
    live = spark.createDataFrame([(1, 1)], "guild_id long, user_id long")
    parents = spark.createDataFrame([(1, 8)], "guild_id long, at long")
    gone = C.sync_members(history, live, parents)
    assert [tuple(r) for r in gone.collect()] == [(1, 2, 8, None, None)]
    assert C.sync_members(history.unionByName(gone), live, parents).count() == 0


def test_deletions(spark):
    current = spark.createDataFrame([(1, 10, None), (2, 10, 3), (3, 11, None)], "id long, parent_id long, _deleted long")
    marks = spark.createDataFrame([(1, 7, 1), (1, 5, 2), (2, 9, 1), (99, 1, 1)], "id long, _deleted long, seq long")
    assert {r["id"]: r["_deleted"] for r in C.mark_deleted(current, marks).collect()} == {1: 5, 2: 9, 3: None}
    matched = {(r["id"], r["matched"]) for r in C.deletion_results(current, marks).collect()}
    assert matched == {(1, True), (2, True), (99, False)}
    # An empty complete list deletes what was live; other parents stay.
    listing = spark.createDataFrame([], "parent_id long, id long")
    parents = spark.createDataFrame([(10, 8)], "parent_id long, at long")
    after = {r["id"]: r["_deleted"] for r in C.sync_deletions(current, listing, parents).collect()}
    assert after == {1: 8, 2: 3, 3: None}


def test_signed_urls_are_no_edit(spark):
    def media(url):
        return F.struct(F.lit(url).alias("url"), F.lit(url).alias("proxy_url"))

    base = "https://cdn.discordapp.com/attachments/1/2/a.png"
    none = F.lit(None).cast("struct<url:string,proxy_url:string>")
    rows = None
    for ts, url in ((2, base + "?ex=1"), (4, base + "?ex=2"), (6, base + "x?ex=2"), (8, "https://o.org/a?1"), (10, "https://o.org/a?2")):
        row = spark.range(1).select(
            F.col("id"), F.lit(ts).cast("long").alias("ts"), F.lit(ts).cast("long").alias("seq"), F.lit("t").alias("content"),
            F.array(F.struct(media(url).alias("image"), none.alias("thumbnail"), none.alias("video"))).alias("embeds"),
        )
        rows = row if rows is None else rows.unionByName(row)
    kept = C.compact_messages(rows, mutable=["content"], extra=None)
    assert sorted(r["ts"] for r in kept.collect()) == [2, 6, 8, 10]


def test_number_rows_is_dense_and_repeatable(spark):
    df = spark.range(500).select((F.col("id") * 17).alias("n"))
    keys = [r["k"] for r in C.number_rows(df, ["n"], "k", 10).collect()]
    assert sorted(keys) == list(range(11, 511))
    again = {r["n"]: r["k"] for r in C.number_rows(df.repartition(7), ["n"], "k", 10).collect()}
    assert again == {r["n"]: r["k"] for r in C.number_rows(df, ["n"], "k", 10).collect()}


def test_newest_is_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 5, None)], "id long, ts long, v string")
    assert sorted(map(tuple, newest(df, ["id"], ["ts"]).collect())) == [(1, 3, "b"), (2, 5, None)]
