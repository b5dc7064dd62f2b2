"""C: from observations to history."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as P
from palimpsest.operators import capture as C
from palimpsest.operators.merge import merge_batch
from palimpsest.plans.ordered import join_by_key, newest
from palimpsest.plans.staging import staged, work_dir
from palimpsest.sources import archive
from workload.registry import query
from workload.stand_ins import (
    KEPT_SQL, MEMBERS_KEPT_SQL, MIDDLE, member_obs, ms_of, obs,
)


@query("C1_compact_snapshots", f"WITH {KEPT_SQL} SELECT id, ts, seq, kind, lvl, result FROM kept")
def _(t):
    return C.compact_snapshots(obs(t), ["id"], ["kind", "lvl"]).select("id", "ts", "seq", "kind", "lvl", "result")


PAGE_VERSIONS = """versions AS (
  SELECT page_id, v, url || '&sig=' || (CASE WHEN v = 1 THEN 'a' ELSE 'b' END) AS url,
         CASE WHEN v = 3 AND html LIKE '%lang="fr"%' THEN 'edited' ELSE 'as sent' END AS content
  FROM pages, (VALUES (1), (2), (3)) AS n(v))"""


@query("C2_compact_messages", f"""WITH {PAGE_VERSIONS}, compared AS (
  SELECT *, CASE WHEN url LIKE 'https://%' THEN split_part(url, '?', 1) ELSE url END AS bare FROM versions),
marked AS (SELECT *, lag(bare) OVER w AS pb, lag(content) OVER w AS pc FROM compared
  WINDOW w AS (PARTITION BY page_id ORDER BY v))
SELECT page_id AS id, CAST(v AS BIGINT) AS ts, url, content FROM marked
WHERE v = 1 OR bare IS DISTINCT FROM pb OR content IS DISTINCT FROM pc""")
def _(t):
    version = t.pages.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("v"))
    url = F.concat("url", F.lit("&sig="), F.when(F.col("v") == 1, "a").otherwise("b"))
    media = F.struct(url.alias("url"), url.alias("proxy_url"))
    none = F.lit(None).cast("struct<url:string,proxy_url:string>")
    messages = version.select(
        F.col("page_id").alias("id"), F.col("v").cast("long").alias("ts"), F.col("v").cast("long").alias("seq"),
        F.when((F.col("v") == 3) & F.col("html").contains('lang="fr"'), "edited").otherwise("as sent").alias("content"),
        F.array(F.struct(media.alias("image"), none.alias("thumbnail"), none.alias("video"))).alias("embeds"),
    )
    kept = C.compact_messages(messages, mutable=["content"], extra=None, prefixes=["https://"])
    return kept.select("id", "ts", F.col("embeds")[0]["image"]["url"].alias("url"), "content")


@query("C3_apply_batch", f"""WITH {KEPT_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS back FROM kept)
SELECT CASE WHEN back = 1 THEN 'current' ELSE 'previous' END AS part, id, ts, kind, lvl FROM ranked
UNION ALL
SELECT CASE WHEN k.id IS NULL THEN 'same' ELSE k.result END, o.id, o.ts, o.kind, o.lvl
FROM obs o LEFT JOIN kept k ON k.id = o.id AND k.ts = o.ts WHERE o.ts > {MIDDLE * 2 + 1}""")
def _(t):
    columns = ["id", "ts", "kind", "lvl", "_extra"]
    bound = P.time_bound(MIDDLE)
    # What is stored is a table, so it is one here.
    kept = staged(
        C.compact_snapshots(obs(t).where(F.col("ts") <= bound), ["id"], ["kind", "lvl"]).select(*columns), "history"
    )
    current = newest(kept, ["id"], ["ts"]).withColumn("_deleted", F.lit(None).cast("long"))
    previous = kept.join(current.select("id", F.col("ts").alias("head")), "id").where("ts < head").drop("head")
    after, before, results = C.apply_batch(
        current, previous, obs(t).where(F.col("ts") > bound), ["id"], ["kind", "lvl"]
    )
    show = ["id", "ts", "kind", "lvl"]
    return (
        after.select(F.lit("current").alias("part"), *show)
        .unionByName(before.select(F.lit("previous").alias("part"), *show))
        .unionByName(results.select(F.col("result").alias("part"), *show))
    )


@query("C3_merge_archive", f"""WITH {KEPT_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS back FROM kept)
SELECT CASE WHEN back = 1 THEN 'current' ELSE 'previous' END AS part, id % 50 AS parent_id, id, ts, kind, lvl FROM ranked""")
def _(t):
    columns = ["id", "parent_id", "ts", "kind", "lvl", "_extra"]
    rows = obs(t).withColumn("parent_id", F.col("id") % 50)
    cuts = [P.time_bound(MIDDLE - 30 * 86_400_000), P.time_bound(MIDDLE)]
    first = rows.where(F.col("ts") <= cuts[0])
    kept = staged(C.compact_snapshots(first, ["id"], ["kind", "lvl"]).select(*columns), "history")
    current = newest(kept, ["id"], ["ts"]).withColumn("_deleted", F.lit(None).cast("long"))
    previous = join_by_key(kept, current.select("id", F.col("ts").alias("head")), ["id"], "inner").where("ts < head").drop("head")
    path = work_dir(t.spark, "archive")
    archive.write_archive(
        {"current": (current, "parent_id", ["id"]), "previous": (previous, "parent_id", ["id", "ts"])}, path, buckets=8)
    for batch in (rows.where((F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1])), rows.where(F.col("ts") > cuts[1])):
        merge_batch(t.spark, path, batch, ["id"], ["kind", "lvl"], immutable=["parent_id"])
    archive.vacuum(t.spark, path)
    parts = [archive.read_latest(t.spark, path, name).select(F.lit(name).alias("part"), "parent_id", "id", "ts", "kind", "lvl")
             for name in ("current", "previous")]
    return parts[0].unionByName(parts[1])


@query("C4_fill_partial", f"WITH {MEMBERS_KEPT_SQL} SELECT guild_id, user_id, ts, deaf, mute FROM filled")
def _(t):
    filled = C.fill_partial(
        member_obs(t), C.MEMBER_KEY, ["deaf", "mute"], F.col("joined_at").isNull()
    )
    return filled.select("guild_id", "user_id", "ts", "deaf", "mute")


MEMBER_STATE = ["nick", "joined_at", "deaf", "mute"]


@query("C5_members_append", f"""WITH {MEMBERS_KEPT_SQL}
SELECT guild_id, user_id, ts, nick, joined_at, deaf, mute FROM members""")
def _(t):
    rows = member_obs(t)
    early = F.col("ts") <= P.time_bound(MIDDLE)
    gone = F.col("joined_at").isNull()
    columns = ["guild_id", "user_id", "ts", *MEMBER_STATE]
    first = staged(
        C.members_append(None, rows.where(early & ~gone), rows.where(early & gone), MEMBER_STATE).select(*columns), "history"
    )
    second = C.members_append(first, rows.where(~early & ~gone), rows.where(~early & gone), MEMBER_STATE)
    return first.unionByName(second.select(*columns))


DELETIONS_SQL = f"""deletions AS (
  SELECT event_id AS id, {ms_of('ts')} * 2 + 1 AS _deleted, event_id AS seq FROM events WHERE event_type = 'error'
  UNION ALL
  SELECT user_id, {ms_of('ts')} * 2, event_id FROM events WHERE event_type = 'purchase')"""


def deletions(t):
    ms = P.ntz_millis("ts")
    live = t.events.where("event_type = 'error'").select(
        F.col("event_id").alias("id"), P.encode_timing(ms, F.lit(True)).alias("_deleted"), F.col("event_id").alias("seq")
    )
    found = t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("id"), P.encode_timing(ms, F.lit(False)).alias("_deleted"), F.col("event_id").alias("seq")
    )
    return live.unionByName(found)


def order_messages(t, deleted=None):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"),
        F.col("o_orderstatus").alias("status"),
        (F.lit(None).cast("long") if deleted is None else deleted).alias("_deleted"),
    )


@query("C6_mark_deleted", f"""WITH {DELETIONS_SQL}
SELECT o_orderkey AS id, o_orderstatus AS status, d._deleted
FROM orders LEFT JOIN (SELECT id, arg_max(_deleted, seq) AS _deleted FROM deletions GROUP BY id) d ON d.id = o_orderkey""")
def _(t):
    return C.mark_deleted(order_messages(t), deletions(t)).select("id", "status", "_deleted")


@query("C7_sync_deletions", """
SELECT o_orderkey AS id, o_custkey AS parent_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 5
       WHEN c.c_custkey IS NOT NULL AND o_orderstatus = 'P' THEN 2000 + c_nationkey END AS _deleted
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""")
def _(t):
    current = order_messages(t, F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(5).cast("long")))
    listing = current.where("status <> 'P'").select("parent_id", "id")
    parents = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).select(
        F.col("c_custkey").alias("parent_id"), (F.col("c_nationkey") + 2000).cast("long").alias("at")
    )
    return C.sync_deletions(current, listing, parents).select("id", "parent_id", "_deleted")


@query("C8_sync_members", """
SELECT c_nationkey AS guild_id, c_custkey AS user_id, CAST(900000 + n_regionkey AS BIGINT) AS ts
FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_acctbal >= 0 AND n_regionkey < 4
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t):
    history = t.customer.select(
        F.col("c_nationkey").alias("guild_id"), F.col("c_custkey").alias("user_id"), F.lit(2).cast("long").alias("ts"),
        F.when(F.col("c_acctbal") >= 0, F.lit(1).cast("long")).alias("joined_at"), F.col("c_name").alias("nick"),
    )
    live = (
        t.orders.where("o_orderpriority = '1-URGENT'")
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(F.col("c_nationkey").alias("guild_id"), F.col("c_custkey").alias("user_id"))
    )
    listed = t.nation.where("n_regionkey < 4").select(
        F.col("n_nationkey").alias("guild_id"), (F.col("n_regionkey") + 900_000).cast("long").alias("at")
    )
    return C.sync_members(history, live, listed).select("guild_id", "user_id", "ts")


@query("C9_set_uploader", """
SELECT p_partkey AS id, coalesce(u, CASE WHEN p_size >= 10 THEN p_partkey END) AS user__id
FROM part LEFT JOIN (
  SELECT l_partkey, arg_max(l_suppkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) AS u
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def _(t):
    emojis = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 10, F.col("p_partkey")).alias("user__id")
    )
    updates = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("user__id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("seq"),
    )
    return C.set_uploader(emojis, updates)


@query("C10_webhook_dimension", """WITH personas AS (
  SELECT o_custkey AS webhook_id, o_orderpriority AS username,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS avatar, count(*) AS n
  FROM orders GROUP BY 1, 2, 3),
stored AS (SELECT c_custkey + 1 AS internal_id, c_custkey AS webhook_id, '1-URGENT' AS username, NULL AS avatar
  FROM customer WHERE c_mktsegment = 'BUILDING'),
fresh AS (SELECT p.* FROM personas p WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.webhook_id = p.webhook_id AND s.username = p.username
    AND s.avatar IS NOT DISTINCT FROM p.avatar)),
numbered AS (SELECT *, (SELECT max(internal_id) FROM stored) + row_number() OVER (
  ORDER BY md5(webhook_id || chr(31) || username || chr(31) || coalesce(avatar, chr(30)))) AS internal_id FROM fresh)
SELECT internal_id, webhook_id, username, avatar, n FROM numbered
UNION ALL
SELECT s.internal_id, s.webhook_id, s.username, s.avatar, coalesce(p.n, 0) FROM stored s LEFT JOIN personas p
  ON s.webhook_id = p.webhook_id AND s.username = p.username AND s.avatar IS NOT DISTINCT FROM p.avatar""")
def _(t):
    stored = t.customer.where("c_mktsegment = 'BUILDING'").select(
        (F.col("c_custkey") + 1).alias("internal_id"), F.col("c_custkey").alias("webhook_id"),
        F.lit("1-URGENT").alias("username"), F.lit(None).cast("string").alias("avatar"),
    )
    messages = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("webhook_id"), F.col("o_orderpriority").alias("username"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("avatar"),
    )
    dimension, keyed = C.webhook_dimension(stored, messages)
    used = keyed.groupBy("internal_id").agg(F.count("*").alias("n"))
    return dimension.join(used, "internal_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("C11_insert_if_absent", """
SELECT l_partkey AS id, l_orderkey AS message_id, l_linenumber AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
WHERE rn = 1 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def _(t):
    stored = t.part.where("p_size > 40").select(F.col("p_partkey").alias("id"))
    rows = t.lineitem.select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("line")
    )
    return C.insert_if_absent(stored, rows, ["id"], ["message_id", "line"])


@query("C12_explode_message_users", f"""WITH m AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_orderpriority AS p, {ms_of('o_orderdate')} * 2 AS ts FROM orders),
seen AS (
  SELECT o_orderkey, ts, o_custkey + 1 AS id, 'm' AS name FROM m
  UNION ALL SELECT o_orderkey, ts, o_custkey + 2, 'm' FROM m
  UNION ALL SELECT o_orderkey, ts, o_custkey + 3, 'i' FROM m WHERE s = 'P'
  UNION ALL SELECT o_orderkey, ts, o_custkey + 4, 't' FROM m WHERE p = '1-URGENT'
  UNION ALL SELECT o_orderkey, ts, o_custkey, 'a' FROM m WHERE NOT (s = 'F' AND p <> '2-HIGH')
  UNION ALL SELECT o_orderkey, ts, o_custkey + 5, 'ra' FROM m WHERE s = 'O'
  UNION ALL SELECT o_orderkey, ts, o_custkey + 6, 'rm' FROM m WHERE s = 'O')
SELECT o_orderkey AS message_id, ts, id, name FROM seen""")
def _(t):
    def user(offset, name):
        return F.struct((F.col("o_custkey") + offset).alias("id"), F.lit(name).alias("name"))

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.lit(None).cast("struct<id:bigint,name:string>")
    referenced = F.struct(
        user(5, "ra").alias("author"), F.lit(None).cast("long").alias("webhook_id"),
        F.lit(None).cast("long").alias("application_id"), F.array(user(6, "rm")).alias("mentions"),
        none.alias("interaction_user"), none.alias("interaction_target"),
    )
    messages = t.orders.select(
        F.col("o_orderkey").alias("id"), P.ntz_millis("o_orderdate").alias("received_ms"),
        user(0, "a").alias("author"),
        F.when(status == "F", F.col("o_custkey")).alias("webhook_id"),
        F.when(priority == "2-HIGH", F.col("o_custkey")).alias("application_id"),
        F.array(user(1, "m"), user(2, "m")).alias("mentions"),
        F.when(status == "P", user(3, "i")).alias("interaction_user"),
        F.when(priority == "1-URGENT", user(4, "t")).alias("interaction_target"),
        F.when(status == "O", referenced).alias("referenced"),
    )
    return C.explode_message_users(messages).select("message_id", "ts", "id", "name")


@query("C13_explode_referenced_messages", """
SELECT conv_id * 1000 + turn AS id, role, 1 AS seq FROM conversations
UNION ALL
SELECT b.conv_id * 1000 + b.turn, b.role, 0 FROM conversations a
JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def _(t):
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "turn")
    before = turns.select((F.col("id") + 1).alias("id"), F.struct("id", "role").alias("referenced"))
    return C.explode_referenced_messages(turns.join(before, "id", "left"), ["id", "role"])


@query("C14_explode_forum_tags", """
SELECT p_partkey AS channel_id, CAST(pos AS INTEGER) AS position, p_partkey * 10 + pos AS id, name
FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS name,
  unnest(range(len(string_split(p_name || ' ' || p_type, ' ')))) AS pos FROM part)""")
def _(t):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    tags = F.transform(words, lambda w, i: F.struct((F.col("p_partkey") * 10 + i).alias("id"), w.alias("name")))
    channels = t.part.select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("ts"), tags.alias("available_tags"))
    return C.explode_forum_tags(channels).select("channel_id", "position", "id", "name")


@query("C15_explode_guild", """WITH docs AS (SELECT c_custkey AS g, c_nationkey AS n FROM customer),
parts AS (
  SELECT 'guild' AS part, g AS guild_id, g AS id FROM docs
  UNION ALL SELECT 'role', g, g * 100 + i FROM docs, range(3) r(i) WHERE i <= n % 3
  UNION ALL SELECT 'emoji', g, g * 100 + 10 + i FROM docs, range(5) r(i) WHERE i <= n % 5
  UNION ALL SELECT 'channel', g, g * 100 + 20 + i FROM docs, range(4) r(i) WHERE i <= n % 4
  UNION ALL SELECT 'thread', g, g * 100 + 30 FROM docs)
SELECT part, guild_id, id FROM parts
UNION ALL SELECT 'listed ' || part, guild_id, id FROM parts WHERE part IN ('role', 'emoji', 'channel')""")
def _(t):
    def items(base, count):
        last = (F.col("c_nationkey") % count).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            (F.col("c_custkey") * 100 + base + i).cast("string").alias("id"), F.lit("x").alias("name")
        ))

    docs = t.customer.select(
        F.lit(2).cast("long").alias("ts"),
        F.to_json(F.struct(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
            items(0, 3).alias("roles"), items(10, 5).alias("emojis"), items(20, 4).alias("channels"),
            items(30, 1).alias("threads"),
        )).alias("payload"),
    )
    parts = C.explode_guild(docs)
    listed = parts.pop("listed").select(F.concat(F.lit("listed "), "type").alias("part"), "guild_id", "id")
    for name, rows in parts.items():
        listed = listed.unionByName(rows.select(F.lit(name).alias("part"), "guild_id", "id"))
    return listed


@query("C16_member_user_observation", """
SELECT c_custkey AS id, c_name AS username, CAST(c_nationkey AS BIGINT) * 2 AS ts FROM customer""")
def _(t):
    members = t.customer.select(
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("username")).alias("user"),
        (F.col("c_nationkey").cast("long") * 2 + 1).alias("ts"),
    )
    return C.member_user_observation(members)
