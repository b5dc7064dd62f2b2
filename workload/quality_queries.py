"""F: checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import documents as D
from palimpsest.functions import scalars as P
from palimpsest.operators import quality as Q
from palimpsest.plans.ordered import newest
from workload.registry import query
from workload.stand_ins import MIDDLE, OBS_SQL, obs


@query("F1_check_derived_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    ms = P.ntz_millis("o_orderdate")
    messages = t.orders.select(
        "o_orderkey", P.snowflake_from_millis(ms).alias("id"),
        F.when(F.col("o_orderstatus") == "P", ms + 1).otherwise(ms).alias("timestamp_ms"),
    )
    return Q.check_derived_timestamp(messages).select("o_orderkey")


@query("F2_check_parent_exists", """
SELECT o_orderkey AS id, o_custkey AS channel_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
  AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def _(t):
    messages = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel_id"))
    channels = t.customer.where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("id"))
    threads = t.supplier.select(F.col("s_suppkey").alias("id"))
    return Q.check_parent_exists(messages, channels, threads).select("id", "channel_id")


@query("F3_check_required", """
SELECT event_id, CASE WHEN value < 20 AND event_type = 'error' THEN 'kind,num'
  WHEN value < 20 THEN 'kind' ELSE 'num' END AS reason
FROM events WHERE value < 20 OR event_type = 'error'""")
def _(t):
    rows = t.events.select(
        "event_id", "props",
        F.when(F.col("value") >= 20, F.col("event_type")).alias("kind"),
        F.concat(F.when(F.col("event_type") == "error", "x").otherwise(""), F.col("event_id").cast("string")).alias("num"),
    )
    return Q.check_required(rows, {"kind": None, "num": "bigint", "props": "string"}).select("event_id", "reason")


@query("F4_check_immutable", """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'o_custkey,kind'
  WHEN o_orderpriority = '1-URGENT' THEN 'o_custkey' ELSE 'kind' END AS reason
FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'""")
def _(t):
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    old = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(status != "P", status).alias("kind"))
    new = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(urgent, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), status.alias("kind"),
    )
    return Q.check_immutable(new, old, ["o_custkey", "kind"]).select("id", "reason")


@query("F5_check_fill_once", """
SELECT o_orderkey, o_custkey AS id, CAST(o_orderkey % 25 AS BIGINT) AS uploader, CAST(c_nationkey AS BIGINT) AS stored_uploader
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment <> 'BUILDING' AND o_orderstatus <> 'O' AND o_orderkey % 25 <> c_nationkey""")
def _(t):
    stored = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("long")).alias("uploader"),
    )
    batch = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 25).alias("uploader"),
    )
    return Q.check_fill_once(batch, stored, "uploader").select("o_orderkey", "id", "uploader", "stored_uploader")


@query("F6_check_order", f"""WITH {OBS_SQL}, latest AS (
  SELECT id, max(ts) AS ts, arg_max(kind, ts) AS kind, arg_max(lvl, ts) AS lvl FROM obs
  WHERE ts <= {MIDDLE * 2 + 1} GROUP BY id)
SELECT o.id, o.ts, o.kind, CASE WHEN l.id IS NULL THEN 'first'
  WHEN o.kind IS NOT DISTINCT FROM l.kind AND o.lvl IS NOT DISTINCT FROM l.lvl THEN 'same'
  WHEN o.ts <= l.ts THEN 'rejected' ELSE 'another' END AS result
FROM obs o LEFT JOIN latest l ON l.id = o.id""")
def _(t):
    rows = obs(t)
    latest = newest(rows.where(F.col("ts") <= P.time_bound(MIDDLE)), ["id"], ["ts"])
    return Q.check_order(rows, latest, ["kind", "lvl"]).select("id", "ts", "kind", "result")


REPORT_SPEC = (
    D.Leaf("o_orderkey", "integer"), D.Leaf("o_custkey", "integer"),
    D.Group("meta", (D.Leaf("a", "string"),), D.ABSENT), D.Ignored("o_orderdate"),
)


@query("F7_unknown_keys_report", """
SELECT o_orderstatus AS type, '' AS path, 'o_totalprice' AS key, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, '', 'o_orderstatus', count(*) FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, 'meta', 'b', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def _(t):
    meta = F.when(F.col("o_orderpriority") == "1-URGENT", F.struct(F.lit("x").alias("a"), F.lit("y").alias("b")))
    docs = t.orders.select(
        F.col("o_orderstatus").alias("type"),
        F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", meta.alias("meta")))
        .alias("payload"),
    )
    return Q.unknown_keys_report(docs, REPORT_SPEC)


@query("F8_flags_mismatch", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_returnflag <> 'N' AND l_linenumber <> CAST(l_quantity AS BIGINT)""")
def _(t):
    users = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("long")).alias("flags"),
        F.col("l_quantity").cast("long").alias("public_flags"),
    )
    return Q.flags_mismatch(users).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("F9_reaction_count_mismatch", """
WITH listed AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
declared AS (SELECT l_orderkey, l_returnflag, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2)
SELECT l_orderkey AS message_id, l_returnflag AS emoji, CAST(coalesce(d.n, 0) AS BIGINT) AS declared, coalesce(l.n, 0) AS listed
FROM declared d FULL JOIN listed l USING (l_orderkey, l_returnflag) WHERE coalesce(d.n, 0) <> coalesce(l.n, 0)""")
def _(t):
    key = [F.col("l_orderkey").alias("message_id"), F.col("l_returnflag").alias("emoji")]
    declared = t.lineitem.where("l_linenumber < 5").groupBy(*key).agg(F.max("l_linenumber").alias("count"))
    listed = t.lineitem.where("l_linestatus = 'F'").select(*key)
    return Q.reaction_count_mismatch(declared, listed, ["message_id", "emoji"])


@query("F10_page_order_check", """
SELECT event_id, user_id AS id, previous_id FROM (
  SELECT event_id, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS previous_id FROM events)
WHERE previous_id <= user_id""")
def _(t):
    rows = t.events.select("event_type", "event_id", F.col("user_id").alias("id"))
    return Q.page_order_check(rows, ["event_type"], "event_id").select("event_id", "id", "previous_id")


@query("F11_missing_uploaders", """
SELECT p_brand AS _guild_id, bool_or(p_type <> 'PROMO' AND p_size < 3) AS missing FROM part GROUP BY 1""")
def _(t):
    emojis = t.part.select(
        F.col("p_brand").alias("_guild_id"), F.when(F.col("p_size") >= 3, F.col("p_partkey")).alias("user__id"),
        F.when(F.col("p_type") == "PROMO", 2).alias("_deleted"),
    )
    return Q.missing_uploaders(emojis)


@query("F12_uploader_exists", """
SELECT l_orderkey, l_linenumber, l_suppkey AS user__id FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def _(t):
    users = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    updates = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user__id"))
    return Q.uploader_exists(updates, users).select("l_orderkey", "l_linenumber", "user__id")


@query("F13_archive_gate", """
SELECT event_id, event_type FROM events JOIN customer ON c_custkey = user_id
WHERE CASE event_type WHEN 'click' THEN c_mktsegment <> 'BUILDING' WHEN 'view' THEN c_acctbal > 0
  WHEN 'error' THEN c_acctbal > 0 WHEN 'signup' THEN c_nationkey < 10
  ELSE c_nationkey > 5 AND c_mktsegment = 'MACHINERY' END""")
def _(t):
    names = {
        "click": "MESSAGE_CREATE", "view": "MESSAGE_UPDATE", "error": "MESSAGE_DELETE",
        "signup": "GUILD_MEMBER_ADD", "purchase": "MESSAGE_REACTION_ADD",
    }
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    # Every seventh object is new: only its parent has options.
    new = F.col("event_id") % 7 == 0
    events = t.events.select(
        "event_id", "event_type", F.when(new, -1 - F.col("event_id")).otherwise(F.col("user_id")).alias("object_id"),
        F.when(new, F.col("user_id")).alias("parent_id"), F.create_map(*pairs)[F.col("event_type")].alias("t")
    )
    options = t.customer.select(
        F.col("c_custkey").alias("id"),
        (F.col("c_mktsegment") != "BUILDING").alias("storeNewMessages"),
        (F.col("c_acctbal") > 0).alias("storeMessageEdits"),
        (F.col("c_nationkey") < 10).alias("storeMemberEvents"),
        (F.col("c_nationkey") > 5).alias("storeReactionEvents"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "users").otherwise("none").alias("reactionArchivalMode"),
        *[F.lit(False).alias(n) for n in ("storeServerEdits", "storeNewChannels", "storeChannelEdits", "archiveThreads")],
    )
    return Q.archive_gate(events, options).select("event_id", "event_type")


@query("F14_private_thread_filter", "SELECT p_partkey, p_size FROM part WHERE p_size <> 12")
def _(t):
    return Q.private_thread_filter(t.part, "p_size").select("p_partkey", "p_size")
