"""The archive's tables as views on the driver tables, in Spark and as SQL text side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import encode_timing, ntz_millis
from workload.registry import Tables

# 2024-01-15T00:00:00Z, the middle of the events.
MIDDLE = 1_705_276_800_000
# 1998-01-01T00:00:00Z, in the middle of the orders.
MIDDLE_ORDERS = 883_612_800_000

OBS_SQL = """obs AS (
  SELECT user_id AS id,
         (epoch_us(ts) // 1000) * 2 + CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS ts,
         event_id AS seq, event_type AS kind, CAST(floor(value / 100) AS BIGINT) AS lvl,
         CASE WHEN value > 50 THEN '{"big":true}' END AS _extra
  FROM events)"""


def obs(t: Tables) -> DataFrame:
    """Observations of users: state (kind, lvl) and the residual ``_extra``."""
    return t.events.select(
        F.col("user_id").alias("id"),
        encode_timing(ntz_millis("ts"), F.col("event_type").isin("view", "click")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") / 100).alias("lvl"),
        # Two spellings of one residual: equal when compared.
        F.when(
            F.col("value") > 50, F.when(F.col("event_id") % 2 == 0, '{"big": true}').otherwise('{"big":true}')
        ).alias("_extra"),
    )


# State of one observation against the one before, and the rows that are kept.
KEPT_SQL = OBS_SQL + """, marked AS (
  SELECT *, row_number() OVER w AS rn,
         lag(kind) OVER w AS pk, lag(lvl) OVER w AS pl, lag(_extra) OVER w AS pe
  FROM obs WINDOW w AS (PARTITION BY id ORDER BY ts, seq)),
kept AS (
  SELECT id, ts, seq, kind, lvl, _extra, CASE WHEN rn = 1 THEN 'first' ELSE 'another' END AS result
  FROM marked
  WHERE rn = 1 OR kind IS DISTINCT FROM pk OR lvl IS DISTINCT FROM pl OR _extra IS DISTINCT FROM pe)"""

MEMBER_SQL = """member_obs AS (
  SELECT user_id % 10 AS guild_id, user_id,
         (epoch_us(ts) // 1000) * 2 + CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS ts,
         event_id AS seq, event_type = 'error' AS is_leave,
         CASE WHEN event_type = 'error' OR value < 20 THEN NULL ELSE event_id % 2 = 1 END AS deaf,
         CASE WHEN event_type = 'error' OR value > 60 THEN NULL ELSE event_id % 3 = 1 END AS mute,
         CASE WHEN event_type IN ('click', 'view') THEN 'reader'
              WHEN event_type = 'error' THEN NULL ELSE 'buyer' END AS nick,
         CASE WHEN event_type <> 'error' THEN user_id END AS joined_at
  FROM events)"""


def member_obs(t: Tables) -> DataFrame:
    """Partial member updates; an error is a leave."""
    gone = F.col("event_type") == "error"
    return t.events.select(
        (F.col("user_id") % 10).alias("guild_id"),
        "user_id",
        encode_timing(ntz_millis("ts"), F.col("event_type").isin("view", "click")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(~gone & (F.col("value") >= 20), F.col("event_id") % 2 == 1).alias("deaf"),
        F.when(~gone & (F.col("value") <= 60), F.col("event_id") % 3 == 1).alias("mute"),
        F.when(F.col("event_type").isin("click", "view"), "reader").when(~gone, "buyer").alias("nick"),
        F.when(~gone, F.col("user_id")).alias("joined_at"),
    )


# The filled values and the kept rows of the membership history.
MEMBERS_KEPT_SQL = MEMBER_SQL + """, runs AS (
  SELECT *, sum(CASE WHEN is_leave THEN 1 ELSE 0 END) OVER (
    PARTITION BY guild_id, user_id ORDER BY ts, seq) AS run FROM member_obs),
filled AS (
  SELECT guild_id, user_id, ts, seq, is_leave, nick, joined_at,
    CASE WHEN is_leave THEN NULL ELSE last_value(deaf IGNORE NULLS) OVER w END AS deaf,
    CASE WHEN is_leave THEN NULL ELSE last_value(mute IGNORE NULLS) OVER w END AS mute
  FROM runs WINDOW w AS (PARTITION BY guild_id, user_id, run ORDER BY ts, seq
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
compared AS (
  SELECT *, row_number() OVER w AS rn, lag(nick) OVER w AS pn, lag(joined_at) OVER w AS pj,
         lag(deaf) OVER w AS pd, lag(mute) OVER w AS pm
  FROM filled WINDOW w AS (PARTITION BY guild_id, user_id ORDER BY ts, seq)),
members AS (
  SELECT guild_id, user_id, ts, seq, nick, joined_at, deaf, mute FROM compared
  WHERE rn = 1 OR nick IS DISTINCT FROM pn OR joined_at IS DISTINCT FROM pj
     OR deaf IS DISTINCT FROM pd OR mute IS DISTINCT FROM pm)"""

LOG_SQL = """log AS (
  SELECT user_id % 10 AS message_id,
         CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN NULL
              ELSE 'e' || (event_id % 4) END AS emoji,
         CASE WHEN event_type <> 'purchase' THEN CAST(event_id % 2 AS INTEGER) END AS type,
         CASE WHEN event_type <> 'purchase' THEN user_id % 7 END AS user_id,
         CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add'
              WHEN 'error' THEN 'remove' ELSE 'clear' END AS action,
         (epoch_us(ts) // 1000) * 2 + 1 AS ts, event_id AS seq
  FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase'))"""


def reaction_log(t: Tables) -> DataFrame:
    """click, view = add; error = remove; purchase = clear (of one emoji, or of all)."""
    clear = F.col("event_type") == "purchase"
    return t.events.where(F.col("event_type").isin("click", "view", "error", "purchase")).select(
        (F.col("user_id") % 10).alias("message_id"),
        F.when(~clear | (F.col("event_id") % 4 != 0), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")))
        .alias("emoji"),
        F.when(~clear, (F.col("event_id") % 2).cast("int")).alias("type"),
        F.when(~clear, F.col("user_id") % 7).alias("user_id"),
        F.when(F.col("event_type").isin("click", "view"), "add")
        .when(F.col("event_type") == "error", "remove").otherwise("clear").alias("action"),
        encode_timing(ntz_millis("ts"), F.lit(True)).alias("ts"),
        F.col("event_id").alias("seq"),
    )


# Clears are spread over the keys of their message, then each key is read in order.
INTERVALS_SQL = LOG_SQL + """, keys AS (
  SELECT DISTINCT message_id, emoji, type, user_id FROM log WHERE action = 'add'),
timeline AS (
  SELECT message_id, emoji, type, user_id, action, ts, seq FROM log WHERE action <> 'clear'
  UNION ALL
  SELECT k.message_id, k.emoji, k.type, k.user_id, 'clear', l.ts, l.seq
  FROM log l JOIN keys k ON k.message_id = l.message_id AND (l.emoji IS NULL OR l.emoji = k.emoji)
  WHERE l.action = 'clear'),
placed AS (
  SELECT *, lag(action) OVER w AS before,
         min(CASE WHEN action <> 'add' THEN ts END) OVER (
           PARTITION BY message_id, emoji, type, user_id ORDER BY ts, seq
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing
  FROM timeline WINDOW w AS (PARTITION BY message_id, emoji, type, user_id ORDER BY ts, seq)),
intervals AS (
  SELECT message_id, emoji, type, user_id, ts AS "start", closing AS "end" FROM placed
  WHERE action = 'add' AND before IS DISTINCT FROM 'add')"""

ROWS_SQL = """reaction_rows AS (
  SELECT l_orderkey AS message_id, l_returnflag AS emoji,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS type, l_suppkey AS user_id,
         (epoch_us(l_shipdate) // 1000) * 2 AS "start",
         CASE WHEN l_linenumber % 2 = 1
              THEN (epoch_us(l_shipdate) // 1000 + CAST(l_quantity AS BIGINT) * 86400000) * 2 END AS "end",
         l_partkey
  FROM lineitem)"""


def reaction_rows(t: Tables) -> DataFrame:
    """Reaction intervals of line items: the ship date, open or for a number of days."""
    ms = ntz_millis("l_shipdate")
    return t.lineitem.select(
        F.col("l_orderkey").alias("message_id"),
        F.col("l_returnflag").alias("emoji"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("type"),
        F.col("l_suppkey").alias("user_id"),
        encode_timing(ms, F.lit(False)).alias("start"),
        F.when(
            F.col("l_linenumber") % 2 == 1,
            encode_timing(ms + F.col("l_quantity").cast("long") * 86_400_000, F.lit(False)),
        ).alias("end"),
        "l_partkey",
    )


USERS_SQL = """user_history AS (
  SELECT c_custkey AS id, CAST(0 AS BIGINT) AS ts, c_name AS username FROM customer
  UNION ALL
  SELECT o_custkey AS id, (epoch_us(o_orderdate) // 1000) * 2 AS ts,
         max('renamed ' || o_orderkey) AS username
  FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""


def user_history(t: Tables) -> DataFrame:
    """Names of customers: as created, and changed by each pending order."""
    created = t.customer.select(
        F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("ts"), F.col("c_name").alias("username")
    )
    renamed = (
        t.orders.where(F.col("o_orderstatus") == "P")
        .groupBy(F.col("o_custkey").alias("id"), encode_timing(ntz_millis("o_orderdate"), F.lit(False)).alias("ts"))
        .agg(F.max(F.concat(F.lit("renamed "), F.col("o_orderkey").cast("string"))).alias("username"))
    )
    return created.unionByName(renamed)


def users_at_sql(t_ms: int | None) -> str:
    """``USERS_SQL`` and the name of each user at a time."""
    bound = "" if t_ms is None else f"WHERE ts <= {t_ms * 2 + 1}"
    return USERS_SQL + f""", users_at AS (
  SELECT id, max(ts) AS ts, arg_max(username, ts) AS username FROM user_history {bound} GROUP BY id)"""


SERVER_SQL = """places AS (
  SELECT c_custkey AS channel_id, c_name AS channel_name, c_nationkey AS nation,
         n_name, n_regionkey, r_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def ms_of(column: str) -> str:
    return f"(epoch_us({column}) // 1000)"


def iso_of(ms: str) -> str:
    """SQL text for ``format_iso_millis``."""
    return (
        f"(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.') || "
        f"lpad(CAST((({ms}) % 1000 + 1000) % 1000 AS VARCHAR), 3, '0') || 'Z')"
    )
