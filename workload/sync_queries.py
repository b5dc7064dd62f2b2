"""I: incremental sync and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as P
from palimpsest.operators import sync as I
from palimpsest.operators.capture import classify_snapshots, state_of
from workload.registry import query
from workload.stand_ins import OBS_SQL, obs

# Customers are channels and orders their messages; the mark is the last order before 1998.
MARKS_SQL = """marks AS (SELECT o_custkey AS channel_id, max(o_orderkey) AS last_synced_id FROM orders
  WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' GROUP BY 1),
newest AS (SELECT c_custkey AS channel_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN n END AS newest_id
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey)"""


def messages(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel_id"))


def marks(t):
    early = t.orders.where("o_orderdate < timestamp_ntz'1996-01-01' AND o_orderstatus = 'F'")
    return early.groupBy(F.col("o_custkey").alias("channel_id")).agg(F.max("o_orderkey").alias("last_synced_id"))


def newest(t):
    known = t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("n"))
    return t.customer.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("channel_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("n")).alias("newest_id")
    )


@query("I1_high_water_mark", f"""WITH {MARKS_SQL}
SELECT o_custkey AS channel_id, CASE WHEN c_custkey IS NOT NULL THEN coalesce(last_synced_id, 0) END AS mark
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN marks ON channel_id = o_custkey
  LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def _(t):
    ids = t.orders.select(F.col("o_custkey").alias("channel_id")).distinct()
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("channel_id"))
    return I.high_water_mark(ids, known, marks(t))


@query("I2_sync_needed", f"""WITH {MARKS_SQL}
SELECT n.channel_id, newest_id, coalesce(last_synced_id, 0) AS last_synced_id FROM newest n LEFT JOIN marks m ON m.channel_id = n.channel_id
WHERE newest_id IS NULL OR coalesce(last_synced_id, 0) < newest_id""")
def _(t):
    return I.sync_needed(marks(t), newest(t))


SLICE_SQL = MARKS_SQL + """, page AS (SELECT o_orderkey AS id, o_custkey AS channel_id, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderkey) AS position
  FROM orders LEFT JOIN marks ON channel_id = o_custkey WHERE o_orderkey > coalesce(last_synced_id, 0)),
slice AS (SELECT * FROM page WHERE position <= 5)"""


@query("I3_incremental_slice", f"WITH {SLICE_SQL} SELECT id, channel_id, position FROM slice")
def _(t):
    return I.incremental_slice(messages(t), marks(t), 5).select("id", "channel_id", F.col("position").cast("long").alias("position"))


@query("I4_advance_mark", f"""WITH {SLICE_SQL},
p AS (SELECT channel_id, count(*) AS n, max(id) AS last FROM slice GROUP BY 1)
SELECT coalesce(m.channel_id, p.channel_id) AS channel_id,
  CASE WHEN coalesce(p.n, 0) >= 5 THEN coalesce(last, last_synced_id, 0)
    ELSE greatest(coalesce(last, last_synced_id, 0), newest_id) END AS last_synced_id
FROM marks m FULL JOIN p ON p.channel_id = m.channel_id LEFT JOIN newest w ON w.channel_id = coalesce(m.channel_id, p.channel_id)""")
def _(t):
    page = I.incremental_slice(messages(t), marks(t), 5)
    return I.advance_mark(marks(t), page, newest(t), 5)


# What comes live while half of the channels are in sync with their newest message.
@query("I4_raise_live_marks", f"""WITH {MARKS_SQL},
live AS (SELECT o_custkey AS channel_id, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT m.channel_id, CASE WHEN m.channel_id % 2 = 0 THEN greatest(last_synced_id, last) ELSE last_synced_id END AS last_synced_id
FROM marks m LEFT JOIN live l ON l.channel_id = m.channel_id""")
def _(t):
    live = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("id"))
    return I.raise_live_marks(marks(t), live, F.col("channel_id") % 2 == 0).select("channel_id", "last_synced_id")


STATS_SQL = MARKS_SQL + """, stats AS (
  SELECT o_custkey AS channel_id, count(*) FILTER (o_orderstatus <> 'P') AS seen, min(o_orderkey) AS first_id,
    max(o_orderkey) FILTER (o_orderstatus <> 'P') AS last_seen_id FROM orders GROUP BY 1),
progress AS (
  SELECT s.channel_id, CASE WHEN last_seen_id <> first_id THEN
      round(CAST(seen AS DOUBLE) / (last_seen_id - first_id) * (newest_id - first_id), 4) END AS total,
    CASE WHEN newest_id IS NULL THEN NULL WHEN coalesce(last_synced_id, 0) = 0 THEN 0
      WHEN newest_id <> first_id THEN round(CAST(last_synced_id - first_id AS DOUBLE) / (newest_id - first_id), 6) END AS progress
  FROM stats s LEFT JOIN newest n ON n.channel_id = s.channel_id LEFT JOIN marks m ON m.channel_id = s.channel_id)"""


def progress(t):
    stored = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    stats = t.orders.groupBy(F.col("o_custkey").alias("channel_id")).agg(
        F.count(stored).alias("seen"), F.min("o_orderkey").alias("first_id"), F.max(stored).alias("last_seen_id")
    )
    full = stats.join(newest(t), "channel_id", "left").join(marks(t), "channel_id", "left").withColumn(
        "mark", F.coalesce("last_synced_id", F.lit(0))
    )
    return I.estimate_progress(full).select(
        "channel_id", F.round("total", 4).alias("total"), F.round("progress", 6).alias("progress")
    )


@query("I5_estimate_progress", f"WITH {STATS_SQL} SELECT channel_id, total, progress FROM progress")
def _(t):
    return progress(t)


@query("I6_slowest_channels", f"""WITH {STATS_SQL}
SELECT channel_id, total, progress, (SELECT count(*) FROM progress) - 10 AS others
FROM progress ORDER BY progress ASC NULLS LAST, channel_id LIMIT 10""")
def _(t):
    return I.slowest_channels(progress(t))


@query("I7_assemble_chunks", """WITH r AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) = 6)
SELECT DISTINCT l_orderkey % 50 AS guild_id, l_orderkey AS request, l_suppkey AS user_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM r)""")
def _(t):
    chunks = t.lineitem.select(
        (F.col("l_orderkey") % 50).alias("guild_id"), F.col("l_orderkey").alias("request"),
        (F.col("l_linenumber") - 1).alias("chunk_index"), F.lit(6).alias("chunk_count"), F.col("l_suppkey").alias("user_id"),
    )
    _, members = I.assemble_chunks(chunks)
    return members


@query("I8_archived_threads_slice", """SELECT id, parent_id, position FROM (
  SELECT o_orderkey AS id, o_custkey AS parent_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0
  WHERE o_orderstatus <> 'O' AND (c_custkey IS NULL OR o_orderdate < TIMESTAMP '1997-01-01')) WHERE position <= 3""")
def _(t):
    threads = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"),
        F.when(F.col("o_orderstatus") != "O", P.ntz_millis("o_orderdate")).alias("archived_at"),
    )
    # 1997-01-01T00:00:00Z
    before = t.customer.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("parent_id"), F.lit(852_076_800_000).alias("before")
    )
    page = I.archived_threads_slice(threads, before, 3)
    return page.select("id", "parent_id", F.col("position").cast("long").alias("position"))


@query("I9_run_stats", f"""WITH {OBS_SQL}, m AS (
  SELECT *, row_number() OVER w AS rn, lag(kind) OVER w AS pk, lag(lvl) OVER w AS pl
  FROM obs WINDOW w AS (PARTITION BY id ORDER BY ts, seq))
SELECT kind, CASE WHEN rn = 1 THEN 'first' WHEN kind = pk AND lvl = pl THEN 'same' ELSE 'another' END AS result, count(*) AS n
FROM m GROUP BY 1, 2""")
def _(t):
    return I.run_stats(classify_snapshots(obs(t), ["id"], state_of(["kind", "lvl"], None)))
