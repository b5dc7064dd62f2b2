"""Keyed streams: each micro-batch goes through the batch operators.

What is known of the keys is a ``state.BatchState``. A micro-batch reads the rows of its own keys, passes its observations and these rows to the
operator and writes results and new state under its number. A repeated micro-batch replaces its own folders and doesn't see
them, so a restart changes nothing. Hot keys are cut into slices as in any batch, and no row goes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.capture import KEPT, MEMBER_KEY, ORDER, classify_snapshots, members_results, state_of
from palimpsest.operators.reactions import KEY, fold_carried
from palimpsest.plans.ordered import join_by_key, newest
from palimpsest.plans.staging import staged
from palimpsest.streaming.state import BatchState


def types_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _start(
    rows: DataFrame, path: str, checkpoint: str, state: BatchState, empty: DataFrame,
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], by: Sequence[str],
) -> StreamingQuery:
    """Run ``step(micro-batch, known rows) -> (results, new state)`` on what has landed by now; results go to ``path``/rows."""
    # An empty folder gives readers the columns before anything has come.
    empty.write.mode("ignore").parquet(f"{path}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        state.prepare(number)
        landed = staged(batch, "micro-batch")
        known = staged(state.known(landed.select(*by), number), "known")
        results, changed = step(landed, known)
        results.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        state.put(changed, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str) -> DataFrame:
    """The results of a keyed stream."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


snapshots = written


def split_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history rows, quarantine) of rows with ``result``."""
    kept = F.col("result").isin(*KEPT)
    return rows.where(kept), rows.where(~kept)


def start_snapshots(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str],
    mutable: Sequence[str],
    *,
    extra: str | None = None,
    state: Column | None = None,
    archive: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> StreamingQuery:
    """History and rejected rows of a stream of observations, up to what has landed by now.

    ``rows``: key, order columns, ``mutable`` and what else is to be kept. They land in ``path``/rows with ``result``: first,
    another or rejected; ``snapshots`` reads them. States are compared as in ``compact_snapshots``, or by ``state``, as
    that of ``compact_messages``. ``archive`` has one row per key (key, time, mutable, extra) that was stored before the stream began.
    """
    spark, ts = rows.sparkSession, order[0]
    held = [*key, ts, *mutable, *([extra] if extra else [])]
    compared = state_of(mutable, extra) if state is None else state
    known = BatchState(spark, f"{path}/state", types_of(rows, held), key)
    if archive is not None:
        known.start(archive)

    def step(landed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        results = staged(classify_snapshots(landed, key, compared, order=order, latest=stored), "classified")
        heads = newest(results.where(F.col("result").isin(*KEPT)).select(*held), key, [ts])
        return results.where("result <> 'same'"), heads

    empty = spark.createDataFrame([], rows.schema).withColumn("result", F.lit(""))
    return _start(rows, path, checkpoint, known, empty, step, key)


def start_members(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    mutable: Sequence[str],
    *,
    partial: Sequence[str] = ("deaf", "mute"),
    joined: str = "joined_at",
    key: Sequence[str] = MEMBER_KEY,
    archive: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> StreamingQuery:
    """Membership history of joins, updates, leaves and voice states, as ``capture.members_append`` gives it.

    ``rows``: key, order columns, ``joined``, ``mutable`` and ``partial``; without a join time a row is a leave. Known is the last history
    row of a member, which has what partial updates remember. ``archive`` holds such rows from before the stream.
    """
    spark, ts = rows.sparkSession, order[0]
    compared = list(dict.fromkeys([joined, *mutable, *partial]))
    held = [*key, ts, *compared]
    known = BatchState(spark, f"{path}/state", types_of(rows, held), key)
    if archive is not None:
        known.start(archive)

    def step(landed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        gone = F.col(joined).isNull()
        results = staged(members_results(
            stored, landed.where(~gone), landed.where(gone), compared, partial=partial, joined=joined, key=key, order=order), "members")
        heads = newest(results.where(F.col("result").isin(*KEPT)).select(*held), key, [ts])
        return results.where("result <> 'same'"), heads

    empty = spark.createDataFrame([], rows.schema).withColumn("result", F.lit(""))
    return _start(rows, path, checkpoint, known, empty, step, key)


OPEN_COLUMNS = ["start", "opened_seq"]


def start_reactions(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Intervals of a stream of add, remove and clear events: a row when one opens, a row when it closes.

    Known are the open intervals of each message; a micro-batch folds its log after them, and what stays open goes back.
    ``intervals_from_log`` joins the two rows of an interval.
    """
    spark = log.sparkSession
    columns = f"{types_of(log, KEY)}, start long, opened_seq long, open boolean"
    known = BatchState(spark, f"{path}/state", columns, KEY, by=["message_id"], alive=F.col("open"))

    def step(landed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        folded = staged(fold_carried(landed.select(*KEY, "action", "ts", "seq"), stored.where("open")), "folded")
        news = folded.where(~F.col("carried") | F.col("end").isNotNull())
        still = F.when(F.col("end").isNull(), F.struct(*OPEN_COLUMNS))
        changed = news.groupBy(*KEY).agg(F.max(still).alias("last")).select(
            *KEY, "last.start", "last.opened_seq", F.col("last").isNotNull().alias("open"))
        return news.select(*KEY, *OPEN_COLUMNS, "end"), changed

    empty = spark.createDataFrame([], f"{types_of(log, KEY)}, start long, opened_seq long, end long")
    return _start(log, path, checkpoint, known, empty, step, ["message_id"])


def intervals_from_log(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY, *OPEN_COLUMNS).agg(F.max("end").alias("end")).drop("opened_seq")


def start_lists(lists: DataFrame, path: str, checkpoint: str, parent: str = "guild_id") -> StreamingQuery:
    """Changes that complete lists bring: ``change`` is first, another, rejected or deleted.

    ``lists``: parent, ts, seq, items (array of JSON documents with an id). The lists of a parent are numbered; an item is deleted at the first
    list after it was known that lacks it, that is at the end of its first run of numbers. What was deleted stays so
    (``capture.sync_deletions``). Listed items are compared with their last state.
    """
    spark, key = lists.sparkSession, [parent, "id"]
    kinds = types_of(lists, [parent])
    known = BatchState(spark, f"{path}/state", f"{kinds}, id long, ts long, payload string, deleted boolean", key, by=[parent])

    def step(landed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
        numbered = staged(landed.select(parent, "ts", "seq").withColumn(
            "number", F.row_number().over(Window.partitionBy(parent).orderBy("seq"))), "lists")
        item = F.explode("items")
        items = staged(landed.select(parent, "ts", "seq", item.alias("item")).select(
            parent, F.get_json_object("item", "$.id").cast("long").alias("id"), "ts", "seq",
            F.coalesce(F.to_json(F.try_parse_json("item")), "item").alias("payload")), "items")
        results = staged(classify_snapshots(items, key, F.struct("payload"), latest=stored), "classified")

        # Numbers of the lists that have an item, 0 for what was known; a run is where numbers and their places grow alike.
        listed = join_by_key(items.select(*key, "seq"), numbered.select(parent, "seq", "number"), [parent, "seq"], "inner")
        before = stored.select(*key, F.lit(0).alias("number"))
        places = listed.select(*key, "number").distinct().unionByName(before)
        in_order = Window.partitionBy(*key).orderBy("number")
        first_run = places.withColumns({
            "place": F.row_number().over(in_order), "first": F.min("number").over(in_order)}
        ).where(F.col("number") - F.col("place") == F.col("first") - 1)
        ends = first_run.groupBy(*key).agg((F.max("number") + 1).alias("number"))
        live = join_by_key(ends, stored.where("deleted"), key, "left_anti")
        gone = staged(join_by_key(live, numbered, [parent, "number"], "inner").select(*key, "ts", "seq"), "gone")

        change = results.where("result <> 'same'").select(*key, "ts", "seq", "payload", F.col("result").alias("change"))
        deleted = gone.select(*key, "ts", "seq", F.lit(None).cast("string").alias("payload"), F.lit("deleted").alias("change"))
        heads = newest(results.where(F.col("result").isin(*KEPT)).select(*key, "ts", "payload"), key, ["ts"])
        either = join_by_key(
            stored.withColumn("_stored", F.lit(True)),
            heads.select(*key, F.col("ts").alias("_ts"), F.col("payload").alias("_payload")), key, "full_outer")
        marked = join_by_key(either, gone.select(*key, F.lit(True).alias("_gone")), key)
        after = marked.where("_ts IS NOT NULL OR _gone").select(
            *key, F.coalesce("_ts", "ts").alias("ts"), F.coalesce("_payload", "payload").alias("payload"),
            F.coalesce(F.col("_gone") | F.coalesce("deleted", F.lit(False)), "deleted", F.lit(False)).alias("deleted"))
        return change.unionByName(deleted), after

    empty = spark.createDataFrame([], f"{kinds}, id long, ts long, seq long, payload string, change string")
    return _start(lists, path, checkpoint, known, empty, step, [parent])
