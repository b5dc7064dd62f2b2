from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import temporal as T
from palimpsest.operators.capture import compact_snapshots

HISTORY = [(1, 0, "created"), (1, 21, "live edit at 10"), (1, 40, "found edit at 20"), (2, 30, "first seen at 15")]


def state(spark, t):
    df = spark.createDataFrame(HISTORY, "id long, ts long, v string")
    return {r["id"]: r["v"] for r in T.as_of(df, t).collect()}


def test_as_of(spark):
    assert state(spark, 9) == {1: "created"}
    assert state(spark, 10) == {1: "live edit at 10"}
    assert state(spark, 15) == {1: "live edit at 10", 2: "first seen at 15"}
    assert state(spark, 20)[1] == "found edit at 20"
    assert state(spark, None) == {1: "found edit at 20", 2: "first seen at 15"}


def test_children_keep_their_deletion(spark):
    history = spark.createDataFrame(HISTORY, "id long, ts long, v string")
    current = spark.createDataFrame([(1, 7, 99), (2, None, None)], "id long, parent_id long, _deleted long")
    rows = T.as_of_children(history, current, 9, [7]).collect()
    assert [(r["id"], r["v"], r["_deleted"]) for r in rows] == [(1, "created", 99)]
    rows = T.as_of_children(history, current, 50, [None]).collect()
    assert [r["id"] for r in rows] == [2]


def test_as_of_join_at_each_time(spark, hot_mode):
    history = spark.createDataFrame([(1, 2 * i, f"v{i}") for i in range(20)], "id long, ts long, v string")
    facts = spark.createDataFrame([(1, i, i) for i in range(30)] + [(5, 1, 31)], "id long, ms long, n long")
    got = {r["n"]: r["v"] for r in T.as_of_join(facts, history, ["id"], ["v"]).collect()}
    assert got == {i: f"v{min(i, 19)}" for i in range(30)} | {31: None}


def test_intervals_and_differences(spark, hot_mode):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], i // 2) for i in range(12)], "id long, ts long, v string, n long")
    ends = {r["ts"]: r["valid_to"] for r in T.history_intervals(df).collect()}
    assert ends == {i: i + 1 for i in range(11)} | {11: None}
    changes = {(r["ts"], r["column"], r["old_value"], r["new_value"]) for r in T.version_diff(df, ["v", "n"]).collect()}
    assert (2, "n", "0", "1") in changes and (1, "v", "a", "b") in changes and len(changes) == 11 + 5


def test_members_as_of(spark):
    df = spark.createDataFrame(
        [(1, 1, 2, 5, "n"), (1, 1, 7, None, None), (1, 2, 4, None, None)],
        "guild_id long, user_id long, ts long, joined_at long, nick string",
    )
    def at(t):
        return {r["user_id"]: r["left_at"] for r in T.members_as_of(df, t, guild=1).collect()}

    assert at(1) == {1: None} and at(2) == {1: None, 2: 4} and at(3) == {1: 7, 2: 4}


def test_reference_codes_round_trip(spark):
    channels = spark.createDataFrame([(10, 1), (11, None)], "id long, guild_id long")
    threads = spark.createDataFrame([(20, 10)], "id long, parent_id long")
    messages = spark.createDataFrame(
        [(1, 10, 10, 1), (2, 20, 10, 1), (3, 20, 20, 5), (4, 11, 77, None), (5, 10, None, None)],
        "id long, channel_id long, ref_channel_id long, ref_guild_id long",
    )
    codes = T.encode_reference(messages, channels, threads)
    assert {tuple(r) for r in codes.collect()} == {
        (1, 10, 0, 0), (2, 20, 1, 0), (3, 20, 0, 5), (4, 11, 77, None), (5, 10, None, None)
    }
    assert sorted(map(str, T.resolve_reference(codes, channels, threads).collect())) == sorted(map(str, messages.collect()))


def test_referenced_only_for_replies(spark):
    stored = spark.createDataFrame([(1, "hi")], "id long, content string")
    messages = spark.createDataFrame(
        [(5, 19, 1, 9), (6, 0, 1, 9), (7, 21, 2, 9), (8, 19, 1, None)],
        "id long, type int, ref_message_id long, ref_channel_id long",
    )
    got = {r["id"]: r["referenced"] for r in T.join_referenced(messages, stored, ["content"]).collect()}
    assert got[5]["content"] == "hi" and got[6] is None and got[7] is None and got[8] is None


def observations(spark, path):
    rows = [(k, 2 * (i // 2), i, "abca"[i * i % 4], i // 5, None) for k in (1, 2, None) for i in range(30)]
    spark.createDataFrame(rows, "id long, ts long, seq long, v string, n long, _extra string").write.parquet(path)
    return spark.read.parquet(path)


def test_one_count_for_compaction_and_neighbours(spark, tmp_path, hot_mode):
    obs = observations(spark, str(tmp_path / "obs"))
    kept = compact_snapshots(obs, ["id"], ["v", "n"]).select("id", "ts", "v", "n")
    intervals = T.observed_intervals(obs, ["id"], ["v", "n"])
    diff = T.observed_diff(obs, ["id"], ["v", "n"])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (intervals, diff)]
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(intervals) == order(T.history_intervals(kept)) and order(diff) == order(T.version_diff(kept, ["v", "n"]))
    if hot_mode == "plain":
        for plan in plans:
            assert plan.count("Scan parquet") == 1 and plan.count("Exchange") == 1


def test_rows_without_interaction_are_dealt(spark):
    messages = spark.range(4000).select(
        "id", F.when(F.col("id") % 100 == 0, F.col("id") % 7).cast("int").alias("interaction_user_id"),
        F.when(F.col("id") % 50 == 0, F.col("id") % 5).alias("interaction_target_id"), F.array("id").alias("many"),
    )
    users = spark.createDataFrame([(i, 0, f"u{i}") for i in range(6)] + [(None, 0, "nobody")], "id long, ts long, username string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        full = T.hydrate_interaction(messages, users, None)
        assert full.columns == [
            "interaction_target_id", "interaction_user_id", "id", "many", "interaction_user", "interaction_target"]
        rows = full.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000
    for r in rows:
        user, target = r["interaction_user_id"], r["interaction_target_id"]
        assert r["interaction_user"] == (None if user is None or user > 5 else f"u{user}")
        assert r["interaction_target"] == (None if target is None else f"u{target}")
    tasks = [r["task"] for r in rows]
    assert max(map(tasks.count, set(tasks))) < 1000
