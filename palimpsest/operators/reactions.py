"""Reactions as intervals (message, emoji, type, user, start, end); an open one has no end.

A log is a table (message_id, emoji, type, user_id, action, ts, seq) with the actions ``add``,
``remove`` and ``clear``; a clear has no type and no user, and no emoji when it clears all.
Clears are never paired with the keys of their message: each row looks up the nearest clear of
its message and of its emoji with one ordered pass, so the work is linear in the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import encode_timing, time_bound
from palimpsest.plans.ordered import Pass, carry, carry_passes, join_known

MESSAGE = ("message_id",)
EMOJI = ("message_id", "emoji")
KEY = ("message_id", "emoji", "type", "user_id")
ORDER = ("ts", "seq")


def initial_reactions(rows: DataFrame, users: str = "users", received: str = "received_ms") -> DataFrame:
    """One open interval per listed user, from the time of receipt; no check for duplicates."""
    return rows.select(
        "message_id", "emoji", "type", F.explode(users).alias("user_id"),
        encode_timing(received, F.lit(False)).alias("start"), F.lit(None).cast("long").alias("end"),
    )


def _is(action: str) -> Column:
    return F.col("action") == action


def _nearest(log: DataFrame, *sides: bool) -> DataFrame:
    """Add for each row the nearest own event and the nearest clears, before or (True) after it.

    Values are (ts, seq, action), so that they compare by place in the log. Keys of clears differ
    from those of adds, so every pass sees the whole log.
    """
    place = F.struct("ts", "seq", "action")
    clears_all = F.when(_is("clear") & F.col("emoji").isNull(), place)
    clears_emoji = F.when(_is("clear") & F.col("emoji").isNotNull(), place)
    passes = []
    for backward in sides:
        side = "_next" if backward else "_last"
        own = F.when(_is("remove") if backward else _is("add") | _is("remove"), place)
        passes += [
            Pass(MESSAGE, ORDER, {f"{side}_all": clears_all}, backward),
            Pass(EMOJI, ORDER, {f"{side}_emoji": clears_emoji}, backward),
            Pass(KEY, ORDER, {f"{side}_own": own}, backward),
        ]
    return carry_passes(log, passes)


def _is_opening() -> Column:
    """An add opens an interval unless the key's last event is an add that nothing closed since."""
    last_clear = F.greatest("_last_all", "_last_emoji")
    open_ = (F.col("_last_own.action") == "add") & (
        last_clear.isNull() | (last_clear < F.col("_last_own"))
    )
    return _is("add") & ~F.coalesce(open_, F.lit(False))


def _end() -> Column:
    return F.least("_next_own", "_next_all", "_next_emoji")["ts"]


def fold_reaction_log(log: DataFrame) -> DataFrame:
    """Intervals of a whole log: repeated adds are dropped, removes and clears close."""
    closed = _nearest(log, False, True)
    return closed.where(_is_opening()).select(*KEY, F.col("ts").alias("start"), _end().alias("end"))


def fold_carried(log: DataFrame, opened: DataFrame) -> DataFrame:
    """Intervals of one part of a log after ``opened`` (KEY, start, opened_seq), what earlier parts left open.

    These were there before the part came, whatever its times. ``carried`` marks them, closed or not.
    """
    begin = F.lit(-1).cast("long")
    stored = opened.select(
        *KEY, F.lit("add").alias("action"), begin.alias("ts"), begin.alias("seq"), "start", "opened_seq", F.lit(True).alias("carried"))
    fresh = log.select(
        *KEY, "action", "ts", "seq", F.col("ts").alias("start"), F.col("seq").alias("opened_seq"), F.lit(False).alias("carried"))
    closed = _nearest(stored.unionByName(fresh), False, True)
    return closed.where(_is_opening()).select(*KEY, "start", "opened_seq", _end().alias("end"), "carried")


def _open_as_log(intervals: DataFrame) -> DataFrame:
    """Open intervals as adds that come before everything else."""
    return intervals.where(F.col("end").isNull()).select(
        *KEY, F.lit("add").alias("action"), F.col("start").alias("ts"), F.lit(-1).cast("long").alias("seq")
    )


def place_reaction(
    intervals: DataFrame, events: DataFrame, messages: DataFrame, users: DataFrame
) -> DataFrame:
    """Add events with ``result``: missing message, missing user, exists or added.

    The user is only looked for when the event brought no user object (``has_user``).
    """
    known_messages = messages.select(F.col("id").alias("message_id"), F.lit(True).alias("_message"))
    known_users = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user"))
    checked = events.join(known_messages, "message_id", "left").join(known_users, "user_id", "left")
    problem = F.when(F.col("_message").isNull(), "missing message").when(
        ~F.col("has_user") & F.col("_user").isNull(), "missing user"
    )
    checked = checked.withColumn("_problem", problem).drop("_message", "_user")
    log = checked.select(*events.columns, "_problem").withColumn(
        "action", F.when(F.col("_problem").isNull(), F.lit("add")).otherwise(F.lit("none"))
    )
    # What is stored was there before the events arrived, whatever their time.
    stored = _open_as_log(intervals).withColumn("ts", F.lit(-1).cast("long"))
    both = log.withColumn("_event", F.lit(True)).unionByName(stored, allowMissingColumns=True)
    marked = carry(both, KEY, ORDER, {"_open": F.when(_is("add"), F.lit(True))})
    result = F.coalesce("_problem", F.when(F.col("_open"), "exists").otherwise("added"))
    return marked.where(F.col("_event")).withColumn("result", result).select(*events.columns, "result")


def remove_reaction(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Close the open interval of each key at the first remove at or after its start."""
    return _close(intervals, events.withColumn("action", F.lit("remove")))


def clear_reactions(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Close the open intervals of a message, or of one emoji of it (NULL emoji: all)."""
    log = events.withColumns({
        "action": F.lit("clear"),
        "type": F.lit(None).cast(intervals.schema["type"].dataType),
        "user_id": F.lit(None).cast(intervals.schema["user_id"].dataType),
    })
    return _close(intervals, log)


def _close(intervals: DataFrame, events: DataFrame) -> DataFrame:
    shut = intervals.where(F.col("end").isNotNull())
    opened = _open_as_log(intervals)
    log = opened.unionByName(events.select(*opened.columns))
    closed = _nearest(log, True).where(_is("add")).select(
        *KEY, F.col("ts").alias("start"), _end().alias("end")
    )
    return shut.select(*closed.columns).unionByName(closed)


def removal_results(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """The removes with ``removed``: was the key open when the event came?"""
    stored = _open_as_log(intervals).withColumns({"ts": F.lit(-1).cast("long"), "_event": F.lit(False)})
    log = stored.unionByName(
        events.withColumns({"action": F.lit("remove"), "_event": F.lit(True)}), allowMissingColumns=True
    )
    marked = carry(log, KEY, ORDER, {"_last": F.col("action")})
    return marked.where("_event").withColumn(
        "removed", F.coalesce(F.col("_last") == "add", F.lit(False))
    ).select(*events.columns, "removed")


def clear_counts(intervals: DataFrame, closed: DataFrame) -> DataFrame:
    """(message_id, n): how many intervals of each message a clear closed."""
    def open_per_message(rows: DataFrame) -> DataFrame:
        return rows.groupBy("message_id").agg(F.count_if(F.col("end").isNull()).alias("n"))

    before = open_per_message(intervals).withColumnRenamed("n", "before")
    after = open_per_message(closed).withColumnRenamed("n", "after")
    counts = before.join(after, "message_id").withColumn("n", F.col("before") - F.col("after"))
    return counts.where("n > 0").select("message_id", "n")


def reaction_history(
    intervals: DataFrame,
    emojis: DataFrame,
    users: DataFrame,
    messages: Sequence[int] | None = None,
    name: str = "username",
) -> DataFrame:
    """Intervals with emoji name, id and animation and the user's current name.

    ``intervals`` has emoji_kind and emoji_key; ``emojis`` (id, name, animated) only serves the
    custom ones, the others show their key.
    """
    rows = intervals if messages is None else intervals.where(F.col("message_id").isin(*messages))
    custom = F.when(F.col("emoji_kind") == "custom", F.col("emoji_key").try_cast("long"))
    known = emojis.select(
        F.col("id").alias("_custom"), F.col("id").alias("emoji_id"), F.col("name").alias("_emoji_name"),
        F.col("animated").alias("emoji_animated"),
    )
    people = users.select(F.col("id").alias("user_id"), F.col(name).alias("user_name"))
    met = join_known(rows.withColumn("_custom", custom), known, "_custom")
    return (
        met.withColumn("emoji_name", F.coalesce("_emoji_name", "emoji_key"))
        .drop("_custom", "_emoji_name")
        .join(people, "user_id", "left")
    )


def reactions_at(intervals: DataFrame, t: int, key: Sequence[str] = ("message_id", "emoji", "type")) -> DataFrame:
    """Open reactions per (message, emoji, type) at t."""
    bound = time_bound(t)
    open_then = (F.col("start") <= bound) & (F.col("end").isNull() | (F.col("end") > bound))
    return intervals.where(open_then).groupBy(*key).agg(F.count("*").alias("n"))
