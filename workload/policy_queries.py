"""A: permissions, and O: options."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import policy as A
from workload.registry import query

VIEW, READ, CONNECT, THREADS, ADMIN = 1 << 10, 1 << 16, 1 << 20, 1 << 34, 1 << 3
GUILD, ROLE, USER, CHANNEL = 1000, 10_000_000, 20_000_000, 30_000_000

# Parts are roles of five servers; nations are the archiving accounts; customers are channels.
ROLES_SQL = f"""roles AS (
  SELECT {ROLE} + p_partkey AS id, (CAST(1 AS BIGINT) << p_size) | CASE WHEN p_type = 'PROMO' THEN {READ} ELSE 0 END
    | CASE WHEN p_size > 40 THEN {VIEW} ELSE 0 END AS permissions FROM part
  UNION ALL SELECT {GUILD} + r_regionkey, {CONNECT} | CASE WHEN r_regionkey < 2 THEN {VIEW} ELSE 0 END FROM region)"""


def roles(t):
    parts = t.part.select(
        (F.col("p_partkey") + ROLE).alias("id"),
        F.expr("shiftleft(1L, p_size)")
        .bitwiseOR(F.when(F.col("p_type") == "PROMO", READ).otherwise(0).cast("long"))
        .bitwiseOR(F.when(F.col("p_size") > 40, VIEW).otherwise(0).cast("long")).alias("permissions"),
    )
    everyone = t.region.select(
        (F.col("r_regionkey") + GUILD).cast("long").alias("id"),
        F.lit(CONNECT).cast("long").bitwiseOR(F.when(F.col("r_regionkey") < 2, VIEW).otherwise(0).cast("long")).alias("permissions"),
    )
    return parts.unionByName(everyone)


def guilds(t):
    return t.region.select(
        (F.col("r_regionkey") + GUILD).cast("long").alias("id"), (F.col("r_regionkey") + USER).cast("long").alias("owner_id")
    )


# Suppliers as accounts with three roles each: the set that grows.
@query("A1_server_permissions", f"""WITH {ROLES_SQL},
a AS (SELECT {GUILD} + n_regionkey AS g, {USER} + s_suppkey AS u, s_suppkey AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey),
held AS (SELECT g, u, unnest([g, {ROLE} + s, {ROLE} + s + 5, {ROLE} + s * 2]) AS role FROM a),
bits AS (SELECT g, u, bit_or(permissions) AS b FROM held JOIN roles ON id = role GROUP BY g, u)
SELECT CAST(g AS BIGINT) AS guild_id, u AS user_id,
  CASE WHEN u = {USER} + g - {GUILD} OR b & {ADMIN} <> 0 THEN -1 ELSE b END AS permissions FROM bits""")
def _(t):
    s = F.col("s_suppkey")
    accounts = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        (F.col("n_regionkey") + GUILD).cast("long").alias("guild_id"), (s + USER).alias("user_id"),
        F.array(s + ROLE, s + ROLE + 5, s * 2 + ROLE).alias("roles"),
    )
    return A.server_permissions(accounts, roles(t), guilds(t)).select("guild_id", "user_id", "permissions")


ACCOUNTS_SQL = ROLES_SQL + f""", accounts AS (
  SELECT CAST({GUILD} + n_regionkey AS BIGINT) AS g, CAST({USER} + n_nationkey AS BIGINT) AS u, n_nationkey AS n FROM nation),
held AS (SELECT g, u, CAST(unnest([{ROLE} + n, {ROLE} + n + 30, {ROLE} + n + 60]) AS BIGINT) AS role FROM accounts),
server AS (SELECT a.g, a.u, CASE WHEN a.u = {USER} + a.g - {GUILD} OR b.b & {ADMIN} <> 0 THEN -1 ELSE b.b END AS p FROM accounts a
  JOIN (SELECT g, u, bit_or(permissions) AS b FROM (SELECT * FROM held UNION ALL SELECT g, u, g FROM accounts) x
        JOIN roles ON id = role GROUP BY g, u) b ON b.g = a.g AND b.u = a.u)"""


def accounts(t):
    n = F.col("n_nationkey").cast("long")
    return t.nation.select(
        (F.col("n_regionkey") + GUILD).cast("long").alias("guild_id"), (n + USER).alias("user_id"),
        F.array(n + ROLE, n + ROLE + 30, n + ROLE + 60).alias("roles"), (n % 2 == 0).alias("bot"),
    )


def server(t):
    return A.server_permissions(accounts(t), roles(t), guilds(t))


# Orders are overwrites of their customer's channel: for everyone, for a role or for an account.
CHANNELS_SQL = ACCOUNTS_SQL + f""", channels AS (
  SELECT {CHANNEL} + c_custkey AS c, CAST({GUILD} + n_regionkey AS BIGINT) AS g, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END AS type
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
overwrites AS (
  SELECT {CHANNEL} + o_custkey AS c, CASE o_orderstatus WHEN 'O' THEN {GUILD} + n_regionkey
      WHEN 'F' THEN {ROLE} + o_orderkey % 90 ELSE {USER} + o_orderkey % 25 END AS target,
    CASE WHEN o_orderpriority < '3' THEN {VIEW | READ} ELSE {THREADS} END AS allow,
    CASE WHEN o_orderpriority > '3' THEN {VIEW} ELSE {CONNECT} END AS deny
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
aimed AS (
  SELECT g, u, 'everyone' AS kind, g AS target FROM server WHERE p & {ADMIN} = 0
  UNION ALL SELECT h.g, h.u, 'role', role FROM held h JOIN server s ON s.g = h.g AND s.u = h.u WHERE p & {ADMIN} = 0
  UNION ALL SELECT g, u, 'member', u FROM server WHERE p & {ADMIN} = 0),
ruled AS (
  SELECT a.g, a.u, o.c,
    coalesce(bit_or(deny) FILTER (kind = 'everyone'), 0) AS ed, coalesce(bit_or(allow) FILTER (kind = 'everyone'), 0) AS ea,
    coalesce(bit_or(deny) FILTER (kind = 'role'), 0) AS rd, coalesce(bit_or(allow) FILTER (kind = 'role'), 0) AS ra,
    coalesce(bit_or(deny) FILTER (kind = 'member'), 0) AS md, coalesce(bit_or(allow) FILTER (kind = 'member'), 0) AS ma
  FROM overwrites o JOIN channels c ON c.c = o.c JOIN aimed a ON a.g = c.g AND a.target = o.target GROUP BY 1, 2, 3),
seen AS (
  SELECT s.g AS guild_id, s.u AS user_id, c.c AS channel_id, c.type,
    CASE WHEN s.p & {ADMIN} <> 0 THEN -1
      ELSE (((((s.p & ~coalesce(ed, 0)) | coalesce(ea, 0)) & ~coalesce(rd, 0)) | coalesce(ra, 0)) & ~coalesce(md, 0)) | coalesce(ma, 0) END AS permissions
  FROM server s JOIN channels c ON c.g = s.g LEFT JOIN ruled r ON r.g = s.g AND r.u = s.u AND r.c = c.c)"""


def channels(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        (F.col("c_custkey") + CHANNEL).alias("id"), (F.col("n_regionkey") + GUILD).cast("long").alias("guild_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0).alias("type"),
    )


def overwrites(t):
    homes = channels(t).select(F.col("id").alias("channel_id"), "guild_id")
    low = F.col("o_orderpriority") < "3"
    rows = t.orders.withColumn("channel_id", F.col("o_custkey") + CHANNEL).join(homes, "channel_id")
    held = rows.select(
        "channel_id",
        F.when(F.col("o_orderstatus") == "O", F.col("guild_id"))
        .when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 90 + ROLE)
        .otherwise(F.col("o_orderkey") % 25 + USER).cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("type"),
        F.when(low, VIEW | READ).otherwise(THREADS).cast("string").alias("allow"),
        F.when(F.col("o_orderpriority") > "3", VIEW).otherwise(CONNECT).cast("string").alias("deny"),
    )
    # As channel documents have them.
    documents = held.groupBy(F.col("channel_id").alias("id")).agg(
        F.to_json(F.collect_list(F.struct("id", "type", "allow", "deny"))).alias("permission_overwrites"))
    return A.overwrites_from_json(documents)


@query("A2_channel_permissions", f"WITH {CHANNELS_SQL} SELECT guild_id, user_id, channel_id, type, permissions FROM seen")
def _(t):
    return A.channel_permissions(server(t), channels(t), overwrites(t))


@query("A3_access_matrix", f"""WITH {CHANNELS_SQL}, entered AS (
  SELECT *, permissions & {VIEW} <> 0 AND (type <> 2 OR permissions & {CONNECT} <> 0) AS inside FROM seen)
SELECT guild_id, user_id, channel_id, inside AND permissions & {READ} <> 0 AS can_read,
  inside AND permissions & {THREADS} <> 0 AS can_manage_threads FROM entered""")
def _(t):
    rows = A.access_matrix(A.channel_permissions(server(t), channels(t), overwrites(t)))
    return rows.select("guild_id", "user_id", "channel_id", "can_read", "can_manage_threads")


@query("A4_expression_permission", f"""WITH {ROLES_SQL},
a AS (SELECT {GUILD} + n_regionkey AS g, {USER} + s_suppkey AS u, s_suppkey AS s, s_acctbal < 0 AS bot
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
held AS (SELECT g, u, bot, unnest([g, {ROLE} + s, {ROLE} + s + 5, {ROLE} + s * 2]) AS role FROM a),
bits AS (SELECT g, u, bot, bit_or(permissions) AS b FROM held JOIN roles ON id = role GROUP BY ALL),
p AS (SELECT g, u, bot, CASE WHEN u = {USER} + g - {GUILD} OR b & {ADMIN} <> 0 THEN -1 ELSE b END AS p FROM bits)
SELECT CAST(g AS BIGINT) AS guild_id, u AS user_id, bot FROM p
WHERE p & {1 << 30} <> 0 OR (NOT bot AND p & {1 << 43} <> 0)""")
def _(t):
    s = F.col("s_suppkey")
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        (F.col("n_regionkey") + GUILD).cast("long").alias("guild_id"), (s + USER).alias("user_id"),
        F.array(s + ROLE, s + ROLE + 5, s * 2 + ROLE).alias("roles"), (F.col("s_acctbal") < 0).alias("bot"),
    )
    allowed = A.expression_permission(A.server_permissions(rows, roles(t), guilds(t)))
    return allowed.select("guild_id", "user_id", "bot")


@query("A5_overwrites_changed", """
WITH o AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS t, l_suppkey AS a, l_linenumber AS d FROM lineitem WHERE l_returnflag <> 'R'),
n AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS t, l_suppkey AS a,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 ELSE l_linenumber END AS d FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 7)
SELECT DISTINCT c AS channel_id FROM ((SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM o))""")
def _(t):
    rows = t.lineitem.where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("channel_id"), F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("allow"),
        "l_linenumber", "l_returnflag", "l_linestatus",
    )
    zero = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    old = rows.withColumn("deny", F.col("l_linenumber"))
    new = rows.where("l_linenumber <> 7").withColumn("deny", F.when(zero, 0).otherwise(F.col("l_linenumber")))
    return A.overwrites_changed(old, new)


SHOWN = ["archive", "archiveThreads", "storeMessageEdits", "downloadAttachments", "reactionArchivalMode"]

# Nations are servers, customers their channels, orders the threads of their customer.
OPTIONS_SQL = """servers AS (
  SELECT n_nationkey AS id, n_regionkey <> 1 AS archive, n_regionkey <> 1 AS archiveThreads,
    n_regionkey NOT IN (1, 2) AS storeMessageEdits, n_regionkey = 3 AS downloadAttachments,
    CASE WHEN n_regionkey = 1 THEN 'none' ELSE 'users' END AS reactionArchivalMode,
    n_regionkey <> 1 AS archiveChannels FROM nation),
channel_rows AS (
  SELECT c_custkey AS id, p.archive AND c_mktsegment <> 'BUILDING' AS ok, p.archive AND c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 AS archiveThreads,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN true ELSE p.storeMessageEdits END AS storeMessageEdits,
    p.downloadAttachments, CASE WHEN c_acctbal < 0 THEN 'none' ELSE p.reactionArchivalMode END AS reactionArchivalMode
  FROM customer JOIN servers p ON p.id = c_nationkey),
channels AS (SELECT id, ok AS archive, ok AND archiveThreads AS archiveThreads, ok AND storeMessageEdits AS storeMessageEdits,
    ok AND downloadAttachments AS downloadAttachments, CASE WHEN ok THEN reactionArchivalMode ELSE 'none' END AS reactionArchivalMode FROM channel_rows),
threads AS (SELECT o_orderkey, o_orderstatus, p.*,
    p.archive AND CASE WHEN o_orderstatus = 'P' THEN true ELSE p.archiveThreads END AS ok FROM orders JOIN channels p ON p.id = o_custkey)"""


@query("O1_resolve_options", f"""WITH {OPTIONS_SQL}
SELECT 'server' AS type, CAST(id AS BIGINT) AS id, archive, archiveThreads, storeMessageEdits, downloadAttachments, reactionArchivalMode FROM servers
UNION ALL SELECT 'channel', id, archive, archiveThreads, storeMessageEdits, downloadAttachments, reactionArchivalMode FROM channels
UNION ALL SELECT 'thread', o_orderkey, ok, ok, ok AND storeMessageEdits,
  ok AND (downloadAttachments OR o_orderstatus = 'P'), CASE WHEN ok THEN reactionArchivalMode ELSE 'none' END
FROM threads""")
def _(t):
    servers = t.nation.select(F.col("n_nationkey").cast("long").alias("id"))
    channel_rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("guild_id"))
    threads = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"))
    columns = ["archiveServers", "archiveChannels", "archiveThreads", "storeMessageEdits", "downloadAttachments", "reactionArchivalMode"]

    def rules(rows, kind, id_, **values):
        return rows.select(
            F.lit(0).alias("seq"), F.lit(kind).alias("type"), F.col(id_).cast("long").alias("id"),
            *[
                values.get(c, F.lit(None)).cast("string" if c == "reactionArchivalMode" else "boolean").alias(c)
                for c in columns
            ],
        )

    region = F.col("n_regionkey")
    overrides = rules(
        t.nation, "server", "n_nationkey", archiveServers=F.when(region == 1, False),
        storeMessageEdits=F.when(region == 2, False), downloadAttachments=F.when(region == 3, True),
        # Below a server that is not archived this changes nothing.
        archiveChannels=F.when(region == 1, True),
    ).unionByName(rules(
        t.customer, "channel", "c_custkey",
        archiveChannels=F.when(F.col("c_mktsegment") == "BUILDING", False),
        archiveThreads=F.when(F.col("c_acctbal") < 0, False),
        storeMessageEdits=F.when(F.col("c_mktsegment") == "HOUSEHOLD", True),
        reactionArchivalMode=F.when(F.col("c_acctbal") < 0, F.lit("none")),
    )).unionByName(rules(
        t.orders.where("o_orderstatus = 'P'"), "thread", "o_orderkey",
        archiveThreads=F.lit(True), downloadAttachments=F.lit(True),
    ))
    # A later override of the same object does not count.
    late = rules(t.customer, "channel", "c_custkey", archiveChannels=F.lit(False)).withColumn("seq", F.lit(1))
    rows = A.resolve_options(
        servers, channel_rows, threads, overrides.unionByName(late), {"reactionArchivalMode": "users"}
    )
    return rows.select("type", "id", *SHOWN)


@query("O2_needs_files", "SELECT bool_or(o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS needs_files FROM orders")
def _(t):
    rows = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW").alias("downloadAttachments"),
        F.lit(None).cast("boolean").alias("downloadExpressions"),
    )
    return A.needs_files(rows)
