"""R: reaction intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as P
from palimpsest.operators import reactions as R
from workload.registry import query
from workload.stand_ins import INTERVALS_SQL, MIDDLE, ROWS_SQL, ms_of, reaction_log, reaction_rows

BOUND = MIDDLE * 2 + 1
# The intervals of the first half of the log, with those still open then.
HALF_SQL = INTERVALS_SQL.replace("event_type IN ('click', 'view', 'error', 'purchase'))",
                                 f"event_type IN ('click', 'view', 'error', 'purchase') "
                                 f"AND epoch_us(ts) // 1000 <= {MIDDLE})") + f""", later AS (
  SELECT * FROM (SELECT user_id % 10 AS message_id,
         CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN NULL ELSE 'e' || (event_id % 4) END AS emoji,
         CAST(event_id % 2 AS INTEGER) AS type, user_id % 7 AS user_id, event_type, user_id AS whole_user,
         (epoch_us(ts) // 1000) * 2 + 1 AS ts, event_id AS seq FROM events WHERE epoch_us(ts) // 1000 > {MIDDLE}))"""


def first_half(t):
    return R.fold_reaction_log(reaction_log(t).where(F.col("ts") <= BOUND))


def later(t, action):
    return reaction_log(t).where((F.col("ts") > BOUND) & (F.col("action") == action))


@query("R1_initial_reactions", f"""
SELECT l_orderkey AS message_id, l_returnflag AS emoji, l_linenumber AS type, unnest([l_suppkey, l_partkey]) AS user_id,
  {ms_of('l_shipdate')} * 2 AS "start", CAST(NULL AS BIGINT) AS "end" FROM lineitem""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("message_id"), F.col("l_returnflag").alias("emoji"), F.col("l_linenumber").alias("type"),
        F.array("l_suppkey", "l_partkey").alias("users"), P.ntz_millis("l_shipdate").alias("received_ms"),
    )
    return R.initial_reactions(rows)


@query("R2_place_reaction", f"""WITH {HALF_SQL},
adds AS (SELECT *, row_number() OVER (PARTITION BY message_id, emoji, type, user_id,
    (message_id <> 3 AND (event_type = 'click' OR user_id <> 2)) ORDER BY ts, seq) AS nth FROM later
  WHERE event_type IN ('click', 'view'))
SELECT a.seq, CASE WHEN a.message_id = 3 THEN 'missing message'
  WHEN event_type = 'view' AND a.user_id = 2 THEN 'missing user'
  WHEN nth > 1 OR EXISTS (SELECT 1 FROM intervals i WHERE i."end" IS NULL AND i.message_id = a.message_id
    AND i.emoji = a.emoji AND i.type = a.type AND i.user_id = a.user_id) THEN 'exists' ELSE 'added' END AS result
FROM adds a""")
def _(t):
    clicked = t.events.select(F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("has_user"))
    events = later(t, "add").drop("action").join(clicked, "seq")
    messages = t.events.select((F.col("user_id") % 10).alias("id")).distinct().where("id <> 3")
    users = t.events.select((F.col("user_id") % 7).alias("id")).distinct().where("id <> 2")
    return R.place_reaction(first_half(t), events, messages, users).select("seq", "result")


@query("R3_remove_reaction", f"""WITH {HALF_SQL}
SELECT message_id, emoji, type, user_id, "start", coalesce("end", (SELECT min(l.ts) FROM later l
  WHERE l.event_type = 'error' AND l.message_id = i.message_id AND l.emoji = i.emoji AND l.type = i.type
    AND l.user_id = i.user_id)) AS "end" FROM intervals i""")
def _(t):
    return R.remove_reaction(first_half(t), later(t, "remove"))


@query("R4_clear_reactions", f"""WITH {HALF_SQL}
SELECT message_id, emoji, type, user_id, "start", coalesce("end", (SELECT min(l.ts) FROM later l
  WHERE l.event_type = 'purchase' AND l.message_id = i.message_id AND (l.emoji IS NULL OR l.emoji = i.emoji))) AS "end"
FROM intervals i""")
def _(t):
    return R.clear_reactions(first_half(t), later(t, "clear"))


@query("R5_fold_reaction_log", f'WITH {INTERVALS_SQL} SELECT message_id, emoji, type, user_id, "start", "end" FROM intervals')
def _(t):
    return R.fold_reaction_log(reaction_log(t))


@query("R6_reaction_history", """
SELECT l_orderkey AS message_id, l_linenumber AS line, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS emoji_name,
  p_partkey AS emoji_id, p_size > 25 AS emoji_animated, s_name AS user_name
FROM lineitem LEFT JOIN part ON l_returnflag = 'A' AND p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def _(t):
    intervals = t.lineitem.select(
        F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "A", "custom").otherwise("unicode").alias("emoji_kind"),
        F.col("l_partkey").cast("string").alias("emoji_key"), F.col("l_suppkey").alias("user_id"),
    )
    emojis = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("animated")
    )
    users = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))
    full = R.reaction_history(intervals, emojis, users)
    return full.select("message_id", "line", "emoji_name", "emoji_id", "emoji_animated", "user_name")


AT = 883_612_800_000


@query("R7_reactions_at", f"""WITH {ROWS_SQL}
SELECT message_id, emoji, type, count(*) AS n FROM reaction_rows
WHERE "start" <= {AT * 2 + 1} AND ("end" IS NULL OR "end" > {AT * 2 + 1}) GROUP BY 1, 2, 3""")
def _(t):
    return R.reactions_at(reaction_rows(t), AT)
