"""T: reads of the archive as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as P
from palimpsest.operators import temporal as T
from palimpsest.operators.capture import MEMBER_KEY, compact_snapshots, mark_deleted, members_append
from workload.capture_queries import DELETIONS_SQL, MEMBER_STATE, deletions, order_messages
from workload.registry import query
from workload.stand_ins import (
    KEPT_SQL, MEMBERS_KEPT_SQL, MIDDLE, MIDDLE_ORDERS, USERS_SQL, member_obs, ms_of, obs,
    user_history, users_at_sql,
)

BOUND = MIDDLE * 2 + 1
ORDER_BOUND = MIDDLE_ORDERS * 2 + 1
STATE = ["id", "ts", "kind", "lvl"]


def kept(t):
    return compact_snapshots(obs(t), ["id"], ["kind", "lvl"]).select("id", "ts", "kind", "lvl")


@query("T1_latest", f"""WITH {KEPT_SQL}
SELECT id, max(ts) AS ts, arg_max(kind, ts) AS kind, arg_max(lvl, ts) AS lvl FROM kept GROUP BY id""")
def _(t):
    return T.latest(kept(t))


@query("T2_as_of", f"""WITH {KEPT_SQL}
SELECT id, max(ts) AS ts, arg_max(kind, ts) AS kind, arg_max(lvl, ts) AS lvl FROM kept WHERE ts <= {BOUND} GROUP BY id""")
def _(t):
    return T.as_of(kept(t), MIDDLE)


# Two versions of each order: as created, and with its status from the order date on.
ORDER_HISTORY_SQL = f"""order_history AS (
  SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS ts, 'new' AS status FROM orders WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT o_orderkey, {ms_of('o_orderdate')} * 2 + 1, o_orderstatus FROM orders)"""


def order_history(t):
    created = t.orders.where("o_orderpriority <> '1-URGENT'").select(
        F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("ts"), F.lit("new").alias("status")
    )
    changed = t.orders.select(
        F.col("o_orderkey").alias("id"), P.encode_timing(P.ntz_millis("o_orderdate"), F.lit(True)).alias("ts"),
        F.col("o_orderstatus").alias("status"),
    )
    return created.unionByName(changed)


def order_current(t):
    gone = F.when(F.col("o_orderpriority") == "5-LOW", P.encode_timing(P.ntz_millis("o_orderdate"), F.lit(False)))
    return order_messages(t, gone).select("id", "parent_id", "_deleted")


@query("T3_as_of_children", f"""WITH {ORDER_HISTORY_SQL}
SELECT id, max(ts) AS ts, arg_max(status, ts) AS status, o_custkey AS parent_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN {ms_of('o_orderdate')} * 2 END AS _deleted
FROM order_history JOIN orders ON o_orderkey = id WHERE ts <= {ORDER_BOUND}
GROUP BY id, o_custkey, o_orderpriority, o_orderdate""")
def _(t):
    return T.as_of_children(order_history(t), order_current(t), MIDDLE_ORDERS)


@query("T4_as_of_join", f"""WITH {USERS_SQL}, facts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS id, {ms_of('l_shipdate')} * 2 + 1 AS at FROM lineitem)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.id, u.username
FROM facts f ASOF LEFT JOIN user_history u ON u.id = f.id AND f.at >= u.ts""")
def _(t):
    facts = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("id"), P.ntz_millis("l_shipdate").alias("ms")
    )
    return T.as_of_join(facts, user_history(t), ["id"], ["username"]).drop("ms")


@query("T5_history_intervals", f"""WITH {KEPT_SQL}
SELECT id, ts, kind, lvl, ts AS valid_from, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS valid_to FROM kept""")
def _(t):
    return T.observed_intervals(obs(t), ["id"], ["kind", "lvl"])


@query("T6_version_diff", f"""WITH {KEPT_SQL}, pairs AS (
  SELECT id, ts, kind, lvl, lag(kind) OVER w AS pk, lag(lvl) OVER w AS pl, row_number() OVER w AS n FROM kept
  WINDOW w AS (PARTITION BY id ORDER BY ts))
SELECT id, ts, 'kind' AS "column", pk AS old_value, kind AS new_value FROM pairs WHERE n > 1 AND pk IS DISTINCT FROM kind
UNION ALL
SELECT id, ts, 'lvl', CAST(pl AS VARCHAR), CAST(lvl AS VARCHAR) FROM pairs WHERE n > 1 AND pl IS DISTINCT FROM lvl""")
def _(t):
    return T.observed_diff(obs(t), ["id"], ["kind", "lvl"])


def member_history(t):
    rows = member_obs(t)
    gone = F.col("joined_at").isNull()
    history = members_append(None, rows.where(~gone), rows.where(gone), MEMBER_STATE)
    return history.select(*MEMBER_KEY, "ts", *MEMBER_STATE)


@query("T7_members_as_of", f"""WITH {MEMBERS_KEPT_SQL}
SELECT guild_id, user_id, ts, nick, CASE WHEN joined_at IS NULL THEN ts END AS left_at
FROM (SELECT *, row_number() OVER (PARTITION BY guild_id, user_id ORDER BY ts DESC) AS back
  FROM members WHERE ts <= {BOUND}) WHERE back = 1""")
def _(t):
    at = T.members_as_of(member_history(t), MIDDLE)
    return at.select("guild_id", "user_id", "ts", "nick", "left_at")


@query("T8_hydrate_messages", f"""WITH {users_at_sql(MIDDLE_ORDERS)}
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN a.username ELSE 'hook ' || o_custkey END AS author_name,
  coalesce(m1.username, '?') || ',' || coalesce(m2.username, '?') AS mentions,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE p1.p_name || ',' || coalesce(p2.p_name, '?') END AS attachments,
  (o_orderkey >> 22) + 1420070400000 AS created_ms, CASE WHEN o_orderstatus = 'F' THEN a.ts END AS author_ts,
  coalesce(CAST(m1.ts AS VARCHAR), '?') || ',' || coalesce(CAST(m2.ts AS VARCHAR), '?') AS mention_ts,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE p1.p_size || ',' || coalesce(CAST(p2.p_size AS VARCHAR), '?') END AS sizes
FROM orders LEFT JOIN users_at a ON a.id = o_custkey
  LEFT JOIN users_at m1 ON m1.id = o_custkey + 7 LEFT JOIN users_at m2 ON m2.id = o_custkey + 3
  LEFT JOIN part p1 ON p1.p_partkey = o_custkey LEFT JOIN part p2 ON p2.p_partkey = o_custkey + 900""")
def _(t):
    author = F.col("o_custkey")
    messages = t.orders.select(
        F.col("o_orderkey").alias("id"), author.alias("author_id"),
        F.when(F.col("o_orderstatus") == "F", "user").otherwise("webhook").alias("author_kind"),
        F.array(author + 7, author + 3).alias("mention_ids"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.array(author, author + 900)).alias("attachment_ids"),
    )
    webhooks = t.customer.select(
        F.col("c_custkey").alias("internal_id"), F.concat(F.lit("hook "), F.col("c_custkey").cast("string")).alias("username")
    )
    files = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"), F.col("p_size").alias("size"))
    full = T.hydrate_messages(messages, user_history(t), files, webhooks, MIDDLE_ORDERS)
    return full.select(
        "id", "author_name",
        F.array_join("mentions", ",", "?").alias("mentions"), F.array_join("attachments", ",", "?").alias("attachments"),
        "created_ms", F.col("author_user.ts").alias("author_ts"),
        F.array_join(F.transform("mention_users", lambda u: u["ts"].cast("string")), ",", "?").alias("mention_ts"),
        F.array_join(F.transform("attachment_files", lambda f: f["size"].cast("string")), ",", "?").alias("sizes"),
    )


# A third of the channels are threads of the customer one below; the code depends on the status.
# Other channels have ids of their own, as a real id that equals the channel's would be coded.
REFERENCE_SQL = """m AS (
  SELECT o_orderkey AS id, o_custkey AS channel_id, o_custkey % 3 = 1 AS in_thread,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN CASE WHEN o_custkey % 3 = 1 THEN 1 END ELSE o_orderkey + 1000000000 END AS c,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 7777 ELSE 0 END AS g,
    CASE WHEN o_custkey % 3 = 1 THEN o_custkey - 1 END AS parent
  FROM orders),
r AS (SELECT m.*, CASE c WHEN 0 THEN channel_id WHEN 1 THEN parent ELSE c END AS ref_channel_id,
    CASE WHEN g = 0 THEN 1000 + n.c_nationkey ELSE g END AS ref_guild_id
  FROM m LEFT JOIN customer n ON n.c_custkey = coalesce(m.parent, m.channel_id))"""


def places(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("guild_id"))
    thread = F.col("id") % 3 == 1
    return customers.where(~thread), customers.where(thread).select("id", (F.col("id") - 1).alias("parent_id"))


@query("T9_resolve_reference", f"""WITH {REFERENCE_SQL}
SELECT id, ref_channel_id, ref_guild_id, CAST(c AS BIGINT) AS code_channel, CAST(g AS BIGINT) AS code_guild FROM r""")
def _(t):
    channels, threads = places(t)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    in_thread = F.col("o_custkey") % 3 == 1
    messages = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel_id"),
        F.when(status == "F", 0).when(status == "O", F.when(in_thread, 1)).otherwise(F.col("o_orderkey") + 1_000_000_000)
        .cast("long").alias("ref_channel_id"),
        F.when(priority == "1-URGENT", F.lit(None)).when(priority == "5-LOW", 7777).otherwise(0).cast("long").alias("ref_guild_id"),
    )
    real = T.resolve_reference(messages, channels, threads)
    codes = T.encode_reference(real, channels, threads)
    return real.select("id", "ref_channel_id", "ref_guild_id").join(
        codes.select("id", F.col("ref_channel_id").alias("code_channel"), F.col("ref_guild_id").alias("code_guild")), "id"
    )


@query("T10_join_referenced", """
SELECT a.conv_id * 1000 + a.turn AS id, CASE WHEN a.role = 'assistant' THEN b.conv_id * 1000 + b.turn END AS referenced_id,
  CASE WHEN a.role = 'assistant' THEN b.text END AS referenced_text
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def _(t):
    turns = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", 19).otherwise(0).alias("type"), "conv_id", "turn",
    )
    messages = turns.select(
        "id", "type", F.when(F.col("turn") > 0, F.col("id") - 1).alias("ref_message_id"),
        F.col("conv_id").alias("ref_channel_id"),
    )
    joined = T.join_referenced(messages, turns, ["id", "content"])
    return joined.select(
        "id", F.col("referenced.id").alias("referenced_id"), F.col("referenced.content").alias("referenced_text")
    )


@query("T11_hydrate_interaction", f"""WITH {users_at_sql(MIDDLE_ORDERS)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u.username AS interaction_user, s_name AS interaction_target
FROM lineitem LEFT JOIN users_at u ON u.id = CASE WHEN l_returnflag = 'A' THEN l_partkey END
  LEFT JOIN supplier ON s_suppkey = CASE WHEN l_linenumber > 3 THEN l_suppkey END""")
def _(t):
    messages = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("interaction_user_id"),
        F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")).alias("interaction_target_id"),
    )
    targets = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.lit(0).cast("long").alias("ts"), F.col("s_name").alias("username")
    )
    full = T.hydrate_interaction(messages, user_history(t), MIDDLE_ORDERS, targets=targets)
    return full.drop("interaction_user_id", "interaction_target_id")


# Parts as emojis: named at creation, renamed when their size is above 25.
@query("T12_emojis_as_of", f"""WITH {users_at_sql(MIDDLE_ORDERS)}
SELECT p_partkey AS id, p_brand AS _guild_id, CASE WHEN p_size BETWEEN 26 AND 40 THEN p_type ELSE p_name END AS name,
  u.username AS uploader_name
FROM part LEFT JOIN users_at u ON u.id = CASE WHEN p_size < 30 THEN p_partkey END""")
def _(t):
    named = t.part.select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("ts"), F.col("p_name").alias("name"))
    renamed = t.part.where("p_size > 25").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 40, ORDER_BOUND + 2).otherwise(ORDER_BOUND).cast("long").alias("ts"),
        F.col("p_type").alias("name"),
    )
    current = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("_guild_id"), F.lit(None).cast("long").alias("_deleted"),
        F.when(F.col("p_size") < 30, F.col("p_partkey")).alias("user__id"),
    )
    rows = T.emojis_as_of(named.unionByName(renamed), current, user_history(t), MIDDLE_ORDERS)
    return rows.select("id", "_guild_id", "name", "uploader_name")


@query("T13_tags_as_of", """
SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS name, CAST(c_nationkey AS BIGINT) AS channel_id
FROM customer WHERE c_nationkey IN (3, 4)""")
def _(t):
    early = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("ts"), F.col("c_name").alias("name"))
    later = t.customer.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("id"), F.lit(9).cast("long").alias("ts"), F.col("c_mktsegment").alias("name")
    )
    current = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("channel_id"),
        F.lit(None).cast("long").alias("_deleted"),
    )
    return T.tags_as_of(early.unionByName(later), current, MIDDLE, [3, 4]).select("id", "name", "channel_id")


@query("T14_deleted_objects", f"""WITH {DELETIONS_SQL}
SELECT o_orderkey AS id, o_orderstatus AS status, d._deleted // 2 AS deleted_ms, d._deleted % 2 = 1 AS seen_live
FROM orders JOIN (SELECT id, arg_max(_deleted, seq) AS _deleted FROM deletions GROUP BY id) d ON d.id = o_orderkey""")
def _(t):
    marked = mark_deleted(order_messages(t), deletions(t))
    return T.deleted_objects(marked).select("id", "status", "deleted_ms", "seen_live")


@query("T15_server_at", f"""WITH {USERS_SQL}, {MEMBERS_KEPT_SQL}
SELECT 'member' AS type, guild_id, user_id AS id, ts, nick AS name, CAST(NULL AS BIGINT) AS _deleted
FROM (SELECT *, row_number() OVER (PARTITION BY guild_id, user_id ORDER BY ts DESC) AS back
  FROM members WHERE ts <= {ORDER_BOUND}) WHERE back = 1 AND joined_at IS NOT NULL
UNION ALL
SELECT 'channel' AS type, CAST(c_nationkey AS BIGINT) AS guild_id, c_custkey AS id, u.ts, u.name, CAST(NULL AS BIGINT) AS _deleted
FROM customer JOIN (SELECT id, max(ts) AS ts, arg_max(username, ts) AS name FROM user_history
  WHERE ts <= {ORDER_BOUND} GROUP BY id) u ON u.id = c_custkey
UNION ALL
SELECT 'role', s_nationkey, s_suppkey, 0, s_name, CASE WHEN s_acctbal < 0 THEN 3 END FROM supplier
UNION ALL
SELECT 'guild', n_nationkey, n_nationkey, 0, n_name, NULL FROM nation""")
def _(t):
    none = F.lit(None).cast("long")

    def part(rows, id_, guild, name, deleted):
        history = rows.select(F.col(id_).cast("long").alias("id"), F.lit(0).cast("long").alias("ts"), F.col(name).alias("name"))
        current = rows.select(
            F.col(id_).cast("long").alias("id"), F.col(guild).cast("long").alias("guild_id"), deleted.alias("_deleted")
        )
        return history, current

    channels = user_history(t).withColumnRenamed("username", "name")
    return T.server_at({
        "channel": (channels, part(t.customer, "c_custkey", "c_nationkey", "c_name", none)[1]),
        "role": part(t.supplier, "s_suppkey", "s_nationkey", "s_name", F.when(F.col("s_acctbal") < 0, 3).cast("long")),
        "guild": part(t.nation, "n_nationkey", "n_nationkey", "n_name", none),
    }, MIDDLE_ORDERS, members=member_history(t))
