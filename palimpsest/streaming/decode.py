"""Change events to typed rows, for batches and streams: one parse finds out what an event is about, a second one reads a member.

Events that lack what their row is keyed by (server and member, or message) describe nothing that the archive keeps; they are set apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.documents import flat_columns, flatten_object
from palimpsest.functions.scalars import emoji_key
from palimpsest.spec import MEMBER
from palimpsest.streaming.dispatch import packed_time

# Where an event has its member document (NULL: the event is the document) and whether it ends the membership.
# Fixed values of the archived service.
MEMBER_EVENTS = {
    "GUILD_MEMBER_ADD": (None, False),
    "GUILD_MEMBER_UPDATE": (None, False),
    "GUILD_MEMBER_REMOVE": (None, True),
    "VOICE_STATE_UPDATE": ("member", False),
}
REACTION_EVENTS = {
    "MESSAGE_REACTION_ADD": "add",
    "MESSAGE_REACTION_REMOVE": "remove",
    "MESSAGE_REACTION_REMOVE_EMOJI": "clear",
    "MESSAGE_REACTION_REMOVE_ALL": "clear",
}
NORMAL, BURST = 0, 1

_PERSON = "user struct<id:string>"


def _timed(events: DataFrame) -> DataFrame:
    return events if "ts" in events.columns else packed_time(events)


def decode_members(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(guild_id, user_id, ts, seq and the member columns; events set apart). A leave has no member columns."""
    own = _timed(events.where(F.col("t").isin(*MEMBER_EVENTS)))
    parsed = own.withColumn("_e", F.from_json("d", f"guild_id string, {_PERSON}, member string"))
    nested = F.col("t").isin(*[t for t, (place, _) in MEMBER_EVENTS.items() if place])
    leaves = F.col("t").isin(*[t for t, (_, gone) in MEMBER_EVENTS.items() if gone])
    placed = parsed.withColumns({
        "_guild": F.col("_e.guild_id").try_cast("long"),
        "_document": F.when(nested, F.col("_e.member")).when(~leaves, F.col("d")),
        "_user": F.when(nested, F.from_json("_e.member", _PERSON)["user"]["id"]).otherwise(F.col("_e.user.id")).try_cast("long"),
    })
    whole = F.col("_guild").isNotNull() & F.col("_user").isNotNull()
    kept = placed.where(whole).select(
        F.col("_guild").alias("guild_id"), F.col("_user").alias("user_id"), "ts", "seq", F.col("_document").alias("payload"))
    rows = flatten_object(kept, "payload", MEMBER.fields, ["guild_id", "user_id", "ts", "seq"])
    return rows, placed.where(~whole).select(*events.columns)


def member_columns(joined: str = "joined_at", partial: tuple[str, ...] = ("deaf", "mute")) -> list[str]:
    """The compared columns of ``decode_members`` besides join time and partial ones."""
    return [c for c in flat_columns(MEMBER.fields) if c not in (joined, *partial)]


def decode_reactions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message_id, emoji, type, user_id, action, ts, seq; events set apart).

    ``emoji`` is its kind and key; a clear has neither type nor user, and no emoji when it is of all.
    """
    own = _timed(events.where(F.col("t").isin(*REACTION_EVENTS)))
    parsed = own.withColumn("_e", F.from_json(
        "d", "message_id string, user_id string, burst boolean, emoji struct<id:string,name:string>"))
    action = F.create_map(*[F.lit(x) for pair in REACTION_EVENTS.items() for x in pair])[F.col("t")]
    key = emoji_key("_e.emoji.id", "_e.emoji.name")
    clear = action == "clear"
    read = parsed.withColumns({
        "_message": F.col("_e.message_id").try_cast("long"),
        "_emoji": F.when(key["key"].isNotNull() & (F.col("t") != "MESSAGE_REACTION_REMOVE_ALL"), F.concat_ws(":", key["kind"], key["key"])),
        "_person": F.col("_e.user_id").try_cast("long"), "_action": action,
    })
    whole = F.col("_message").isNotNull() & ((F.col("t") == "MESSAGE_REACTION_REMOVE_ALL") | F.col("_emoji").isNotNull())
    whole = whole & (clear | F.col("_person").isNotNull())
    type_ = F.when(F.coalesce(F.col("_e.burst"), F.lit(False)), BURST).otherwise(NORMAL)
    rows = read.where(whole).select(
        F.col("_message").alias("message_id"), F.col("_emoji").alias("emoji"), F.when(~clear, type_).alias("type"),
        F.when(~clear, F.col("_person")).alias("user_id"), F.col("_action").alias("action"), "ts", "seq")
    return rows, read.where(~whole).select(*events.columns)
