"""Incremental sync: marks, slices, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page size of the remote service.
PAGE = 100


def high_water_mark(ids: DataFrame, known: DataFrame, marks: DataFrame) -> DataFrame:
    """(channel_id, mark): 0 for a known channel without a mark, NULL for an unknown one."""
    there = known.select("channel_id", F.lit(True).alias("_known"))
    return (
        ids.select("channel_id")
        .join(there, "channel_id", "left")
        .join(marks.select("channel_id", F.col("last_synced_id").alias("_mark")), "channel_id", "left")
        .select("channel_id", F.when(F.col("_known"), F.coalesce("_mark", F.lit(0).cast("long"))).alias("mark"))
    )


def sync_needed(marks: DataFrame, newest: DataFrame) -> DataFrame:
    """Channels whose mark is below the newest known id, or whose newest id is unknown."""
    met = newest.select("channel_id", "newest_id").join(
        marks.select("channel_id", F.col("last_synced_id")), "channel_id", "left"
    ).withColumn("last_synced_id", F.coalesce("last_synced_id", F.lit(0).cast("long")))
    return met.where(F.col("newest_id").isNull() | (F.col("last_synced_id") < F.col("newest_id")))


# A channel's rows are dealt to so many tasks before they are cut.
SALTS = 32


def first_of_each(
    rows: DataFrame, marks: DataFrame, key: str, above: Column, order: Sequence[Column], n: int, id_: str = "id",
) -> DataFrame:
    """The first n rows of each key for which ``above`` holds, with their ``position``; ``marks`` has one row a key.

    Rows and marks meet on the key and a salt of the row's id, and each salt is cut to n rows at once, so a hot key
    brings at most SALTS * n rows to one task.
    """
    salt = F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    met = rows.withColumn("_salt", salt).join(marks.withColumn("_salt", salts), [key, "_salt"], "left").where(above)
    place = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    cut = met.withColumn("position", place).where(F.col("position") <= n).select(*rows.columns)
    return cut.withColumn(
        "position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("position") <= n)


def incremental_slice(rows: DataFrame, marks: DataFrame, n: int = PAGE, id_: str = "id") -> DataFrame:
    """Per channel the first n rows above the mark, oldest first, with their ``position``."""
    return first_of_each(
        rows, marks.select("channel_id", F.col("last_synced_id").alias("_mark")), "channel_id",
        F.col(id_) > F.coalesce("_mark", F.lit(0)), [F.col(id_).asc()], n, id_,
    )


def advance_mark(
    marks: DataFrame, slice_: DataFrame, newest: DataFrame, n: int = PAGE, id_: str = "id"
) -> DataFrame:
    """(channel_id, last_synced_id) after a slice is stored.

    A full page ends at its last id. A short page is the end of the channel, so the mark also
    covers the newest known id, which may belong to a deleted message.
    """
    page = slice_.groupBy("channel_id").agg(F.count("*").alias("_n"), F.max(id_).alias("_last"))
    met = (
        marks.select("channel_id", F.col("last_synced_id").alias("_mark"))
        .join(page, "channel_id", "full_outer")
        .join(newest.select("channel_id", "newest_id"), "channel_id", "left")
    )
    stored = F.coalesce("_last", "_mark", F.lit(0).cast("long"))
    full = F.coalesce("_n", F.lit(0)) >= n
    return met.select(
        "channel_id", F.when(full, stored).otherwise(F.greatest(stored, "newest_id")).alias("last_synced_id")
    )


def raise_live_marks(marks: DataFrame, created: DataFrame, in_sync: Column) -> DataFrame:
    """Live messages raise the mark of channels in sync; an id below the mark does nothing.

    ``in_sync`` is a condition on ``marks``.
    """
    last = created.groupBy("channel_id").agg(F.max("id").alias("_last"))
    return (
        marks.join(last, "channel_id", "left")
        .withColumn("last_synced_id", F.when(in_sync, F.greatest("last_synced_id", "_last")).otherwise(F.col("last_synced_id")))
        .drop("_last")
    )


def estimate_progress(stats: DataFrame) -> DataFrame:
    """Expected total and fraction done per channel.

    ``stats``: channel_id, seen, first_id, last_seen_id, mark, newest_id. Both are NULL while the
    newest id is unknown; the fraction is 0 while nothing is marked.
    """
    span = (F.col("newest_id") - F.col("first_id")).cast("double")
    total = F.try_divide(F.col("seen").cast("double"), (F.col("last_seen_id") - F.col("first_id")).cast("double")) * span
    fraction = F.try_divide((F.col("mark") - F.col("first_id")).cast("double"), span)
    return stats.withColumns({
        "total": total,
        "progress": F.when(F.col("newest_id").isNull(), F.lit(None))
        .when(F.col("mark") == 0, F.lit(0.0)).otherwise(fraction),
    })


def slowest_channels(progress: DataFrame, n: int = 10) -> DataFrame:
    """The n channels with least progress, unknown last, and how many more there are."""
    top = progress.orderBy(F.col("progress").asc_nulls_last(), "channel_id").limit(n)
    total = progress.agg(F.count("*").alias("_all"))
    # One row joins n rows; the scalar subquery keeps it out of any join strategy.
    return top.withColumn("others", F.greatest(total.scalar() - F.lit(n), F.lit(0)).cast("long"))


def assemble_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete requests, member ids of the complete requests).

    ``chunks``: guild_id, request, chunk_index, chunk_count, user_id, one row per member. Ids stay
    rows, so a large server is no large group.
    """
    requests = chunks.groupBy("guild_id", "request").agg(
        F.max("chunk_index").alias("_last"), F.max("chunk_count").alias("_count")
    )
    complete = requests.where(F.col("_last") == F.col("_count") - 1).select("guild_id", "request")
    members = chunks.join(complete, ["guild_id", "request"], "left_semi").select(
        "guild_id", "request", "user_id"
    ).distinct()
    return complete, members


def archived_threads_slice(
    threads: DataFrame, before: DataFrame | None = None, n: int = PAGE, closed: str = "archived_at"
) -> DataFrame:
    """Per channel the n closed threads with the newest closing time before its cursor."""
    rows = threads.where(F.col(closed).isNotNull())
    if before is None:
        before = rows.select("parent_id", F.lit(None).cast(rows.schema[closed].dataType).alias("before")).limit(0)
    return first_of_each(
        rows, before.select("parent_id", F.col("before").alias("_before")), "parent_id",
        F.col("_before").isNull() | (F.col(closed) < F.col("_before")), [F.col(closed).desc(), F.col("id").desc()], n,
    )


def run_stats(results: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind and result of a run."""
    return results.groupBy(kind, "result").agg(F.count("*").alias("n"))
