"""Routing of change events, and the parts of the stream that need no keyed state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.scalars import PRIVATE_THREAD, encode_timing
from palimpsest.plans.ordered import HotKeys, carry

# Which table an event feeds. Fixed values of the archived service.
EVENT_TABLES = {
    "GUILD_CREATE": "guild_documents",
    "GUILD_UPDATE": "guild",
    "GUILD_ROLE_CREATE": "role",
    "GUILD_ROLE_UPDATE": "role",
    "GUILD_ROLE_DELETE": "deletion",
    "GUILD_EMOJIS_UPDATE": "emoji_list",
    "GUILD_MEMBERS_CHUNK": "member_chunk",
    "GUILD_MEMBER_ADD": "member",
    "GUILD_MEMBER_UPDATE": "member",
    "GUILD_MEMBER_REMOVE": "member",
    "VOICE_STATE_UPDATE": "member",
    "CHANNEL_CREATE": "channel",
    "CHANNEL_UPDATE": "channel",
    "CHANNEL_DELETE": "deletion",
    "THREAD_CREATE": "thread",
    "THREAD_UPDATE": "thread",
    "THREAD_DELETE": "deletion",
    "THREAD_LIST_SYNC": "thread_list",
    "MESSAGE_CREATE": "message",
    "MESSAGE_UPDATE": "message",
    "MESSAGE_DELETE": "deletion",
    "MESSAGE_REACTION_ADD": "reaction",
    "MESSAGE_REACTION_REMOVE": "reaction",
    "MESSAGE_REACTION_REMOVE_EMOJI": "reaction",
    "MESSAGE_REACTION_REMOVE_ALL": "reaction",
}
# Objects that these events describe are as created: their packed time is 0.
CREATION_EVENTS = ("MESSAGE_CREATE", "CHANNEL_CREATE")
DELETION_TYPES = {
    "GUILD_ROLE_DELETE": ("role", "$.role_id"),
    "CHANNEL_DELETE": ("channel", "$.id"),
    "THREAD_DELETE": ("thread", "$.id"),
    "MESSAGE_DELETE": ("message", "$.id"),
}


def route_dispatches(
    events: DataFrame,
    tables: Mapping[str, str] = EVENT_TABLES,
    parents: DataFrame | None = None,
    parent: str = "parent_id",
) -> tuple[DataFrame, DataFrame]:
    """(events with their ``table``, events dropped because their parent is unknown).

    Names without a table are ignored. A literal map keeps this in the projection: no join.
    """
    pairs = [F.lit(x) for pair in tables.items() for x in pair]
    routed = events.withColumn("table", F.create_map(*pairs)[F.col("t")]).where(F.col("table").isNotNull())
    if parents is None:
        return routed, routed.limit(0)
    known = parents.select(F.col("id").alias(parent))
    return routed.join(known, parent, "left_semi"), routed.join(known, parent, "left_anti")


def start_routing(
    stream: DataFrame, path: str, checkpoint: str, tables: Mapping[str, str] = EVENT_TABLES,
    parents: DataFrame | None = None, parent: str = "parent_id",
) -> StreamingQuery:
    """Write each micro-batch once, split by table on the way out.

    With ``parents`` events of unknown parents go to ``path``/unknown and the others to ``path``/known, else all are
    known. A repeated batch replaces its own folder, so a restart adds nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        for name, rows in zip(("known", "unknown"), route_dispatches(batch, tables, parents, parent)):
            if name == "known" or parents is not None:
                rows.write.partitionBy("table").mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def packed_time(events: DataFrame, creation: Sequence[str] = CREATION_EVENTS) -> DataFrame:
    """Add ``ts``: 0 for creation events, else the packed time of arrival.

    A thread is as created only when its event says it is new.
    """
    created = F.col("t").isin(*creation) | (
        (F.col("t") == "THREAD_CREATE") & (F.get_json_object("d", "$.newly_created") == "true")
    )
    return events.withColumn(
        "ts", F.when(F.coalesce(created, F.lit(False)), F.lit(0).cast("long"))
        .otherwise(encode_timing("received_at", "realtime"))
    )


def stream_deletions(events: DataFrame) -> DataFrame:
    """(type, id, _deleted, seq) of delete events; batch or stream, without state.

    Marks are appended as they come; ``capture.mark_deleted`` lets the last one win on read.
    """
    kind = F.create_map(*[F.lit(x) for e, (k, _) in DELETION_TYPES.items() for x in (e, k)])[F.col("t")]
    id_ = F.coalesce(*[
        F.when(F.col("t") == event, F.get_json_object("d", path)) for event, (_, path) in DELETION_TYPES.items()
    ])
    return events.where(F.col("t").isin(*DELETION_TYPES)).select(
        kind.alias("type"), id_.cast("long").alias("id"),
        encode_timing("received_at", "realtime").alias("_deleted"), "seq",
    )


def explode_thread_list(events: DataFrame) -> DataFrame:
    """Thread observations (id, ts, seq, payload) of thread lists; missing threads stay as they are."""
    threads = F.from_json(F.get_json_object("d", "$.threads"), "array<string>")
    return (
        events.where(F.col("t") == "THREAD_LIST_SYNC")
        .select(encode_timing("received_at", "realtime").alias("ts"), "seq", F.explode(threads).alias("payload"))
        .select(F.get_json_object("payload", "$.id").cast("long").alias("id"), "ts", "seq", "payload")
        .where(F.coalesce(F.get_json_object("payload", "$.type").cast("int") != PRIVATE_THREAD, F.lit(True)))
    )


def replay_flag(
    events: DataFrame,
    connection: Sequence[str] = ("connection",),
    *,
    seq: str = "seq",
    resumed: str = "resumed",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``realtime``: on a resumed connection it is false up to and with the RESUMED event."""
    marked = carry(
        events, connection, [seq], {"_live": F.when(F.col("t") == "RESUMED", F.lit(True))}, hot=hot
    )
    live = ~F.col(resumed) | F.coalesce("_live", F.lit(False))
    return marked.withColumn("realtime", live).drop("_live")


def resync_plan(
    servers: DataFrame, channels: DataFrame, marks: DataFrame, lost: DataFrame
) -> DataFrame:
    """(kind, id) of the syncs to run again after sessions were lost.

    ``lost`` has the ids of the servers whose session is gone: what is newest in their channels is
    no longer known, so all of those need a message sync and the servers a member sync. Other
    channels need one when their mark is behind.
    """
    gone = lost.select(F.col("id").alias("guild_id"), F.lit(True).alias("_lost")).distinct()
    states = (
        channels.select("channel_id", "guild_id", "newest_id")
        .join(gone, "guild_id", "left")
        .join(marks.select("channel_id", "last_synced_id"), "channel_id", "left")
    )
    behind = (
        F.col("_lost") | F.col("newest_id").isNull()
        | (F.coalesce("last_synced_id", F.lit(0).cast("long")) < F.col("newest_id"))
    )
    messages = states.where(behind).select(F.lit("messages").alias("kind"), F.col("channel_id").alias("id"))
    members = servers.join(lost.select("id").distinct(), "id", "left_semi").select(
        F.lit("members").alias("kind"), F.col("id")
    )
    return messages.unionByName(members)
