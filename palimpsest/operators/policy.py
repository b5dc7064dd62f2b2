"""Who may see what, and what is to be archived."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.files import DOWNLOAD_OPTIONS
from palimpsest.plans.ordered import oldest

# Permission bits. Fixed values of the archived service.
ADMINISTRATOR = 1 << 3
VIEW_CHANNEL = 1 << 10
READ_MESSAGE_HISTORY = 1 << 16
CONNECT = 1 << 20
MANAGE_GUILD_EXPRESSIONS = 1 << 30
MANAGE_THREADS = 1 << 34
CREATE_GUILD_EXPRESSIONS = 1 << 43
ALL = -1
VOICE_TYPES = (2, 13)


def _has(permissions: str | Column, bits: int) -> Column:
    column = F.col(permissions) if isinstance(permissions, str) else permissions
    return column.bitwiseAND(F.lit(bits).cast("long")) != 0


def server_permissions(accounts: DataFrame, roles: DataFrame, guilds: DataFrame) -> DataFrame:
    """accounts (guild_id, user_id, roles) with ``permissions``.

    The role with the server's id is everyone's. Role bits are OR-ed map-side, one row per
    account leaves each task.
    """
    held = accounts.select(
        "guild_id", "user_id",
        F.explode(F.array_append(F.coalesce("roles", F.array().cast("array<bigint>")), F.col("guild_id"))).alias("role_id"),
    )
    bits = (
        held.join(roles.select(F.col("id").alias("role_id"), F.col("permissions").alias("_bits")), "role_id")
        .groupBy("guild_id", "user_id")
        .agg(F.bit_or("_bits").alias("_bits"))
    )
    owners = guilds.select(F.col("id").alias("guild_id"), "owner_id")
    met = accounts.join(bits, ["guild_id", "user_id"], "left").join(owners, "guild_id", "left")
    return met.withColumn(
        "permissions",
        F.when(F.col("owner_id") == F.col("user_id"), ALL)
        .when(_has("_bits", ADMINISTRATOR), ALL)
        .otherwise(F.col("_bits")),
    ).drop("_bits", "owner_id")


def overwrites_from_json(channels: DataFrame, overwrites: str = "permission_overwrites") -> DataFrame:
    """(channel_id, target_id, allow, deny) from the JSON text of a channel."""
    parsed = F.from_json(overwrites, "array<struct<id:string,type:int,allow:string,deny:string>>")
    return channels.select(F.col("id").alias("channel_id"), F.explode(parsed).alias("o")).select(
        "channel_id", F.col("o.id").cast("long").alias("target_id"), F.col("o.type").alias("target_type"),
        F.col("o.allow").cast("long").alias("allow"), F.col("o.deny").cast("long").alias("deny"),
    )


def channel_permissions(server: DataFrame, channels: DataFrame, overwrites: DataFrame) -> DataFrame:
    """(guild_id, user_id, channel_id, type, permissions) of each account in each channel it could see.

    ``server`` is the result of ``server_permissions`` for the archiving accounts, of which a
    server has a handful, so the result grows with the channels. Overwrites meet an account only
    where the target is the server, one of its roles or itself.
    """
    none = F.array().cast("array<bigint>")

    def targets(ids: Column, kind: str) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("target_id")))

    aimed = server.where(~_has("permissions", ADMINISTRATOR)).select(
        "guild_id", "user_id",
        F.explode(F.concat(
            targets(F.array("guild_id"), "everyone"),
            targets(F.coalesce("roles", none), "role"),
            targets(F.array("user_id"), "member"),
        )).alias("t"),
    ).select("guild_id", "user_id", "t.*")
    homes = channels.select(F.col("id").alias("channel_id"), "guild_id")
    placed = overwrites.join(homes, "channel_id")
    met = placed.join(aimed, ["guild_id", "target_id"])
    masks = []
    for kind in ("everyone", "role", "member"):
        for what in ("deny", "allow"):
            bits = F.bit_or(F.when(F.col("kind") == kind, F.col(what)))
            masks.append(F.coalesce(bits, F.lit(0).cast("long")).alias(f"_{kind}_{what}"))
    ruled = met.groupBy("guild_id", "user_id", "channel_id").agg(*masks)

    seen = server.select("guild_id", "user_id", "permissions").join(
        channels.select(F.col("id").alias("channel_id"), "guild_id", "type"), "guild_id"
    )
    joined = seen.join(ruled, ["guild_id", "user_id", "channel_id"], "left")
    permissions = F.col("permissions")
    for kind in ("everyone", "role", "member"):
        for_all = F.coalesce(F.col(f"_{kind}_deny"), F.lit(0).cast("long"))
        permissions = permissions.bitwiseAND(F.bitwise_not(for_all)).bitwiseOR(
            F.coalesce(F.col(f"_{kind}_allow"), F.lit(0).cast("long"))
        )
    return joined.select(
        "guild_id", "user_id", "channel_id", "type",
        F.when(_has("permissions", ADMINISTRATOR), ALL).otherwise(permissions).alias("permissions"),
    )


def access_matrix(channel: DataFrame) -> DataFrame:
    """Channel permissions with ``can_read`` and ``can_manage_threads``."""
    voice = F.col("type").isin(*VOICE_TYPES)
    entered = _has("permissions", VIEW_CHANNEL) & (~voice | _has("permissions", CONNECT))
    return channel.withColumns({
        "can_read": entered & _has("permissions", READ_MESSAGE_HISTORY),
        "can_manage_threads": entered & _has("permissions", MANAGE_THREADS),
    })


def expression_permission(server: DataFrame, bot: str = "bot") -> DataFrame:
    """Accounts that may see emoji uploaders."""
    manage = _has("permissions", MANAGE_GUILD_EXPRESSIONS)
    return server.where(manage | (~F.col(bot) & _has("permissions", CREATE_GUILD_EXPRESSIONS)))


def overwrites_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Channels whose set of (target, allow, deny) differs."""
    columns = ["channel_id", "target_id", "allow", "deny"]
    both = old.select(*columns, F.lit(1).alias("_side")).unionByName(
        new.select(*columns, F.lit(2).alias("_side"))
    )
    sides = both.groupBy(*columns).agg(F.bit_or("_side").alias("_sides"))
    return sides.where(F.col("_sides") != 3).select("channel_id").distinct()


# Options and their defaults. Fixed values of the archived service.
DEFAULT_OPTIONS = {
    "archive": True,
    "archiveMessages": True,
    "storeMessageEdits": True,
    "downloadAuthorAvatars": False,
    "downloadAttachments": False,
    "downloadEmbeddedImages": False,
    "downloadEmbeddedVideos": False,
    "downloadEmojisInMessages": False,
    "downloadEmojisInReactions": False,
    "reactionArchivalMode": "none",
    "storeReactionEvents": True,
    "archiveChannels": True,
    "archiveThreads": True,
    "storeChannelEdits": True,
    "requestPastMessages": True,
    "storeNewMessages": True,
    "requestArchivedThreads": True,
    "archiveServers": True,
    "storeServerEdits": True,
    "storeNewChannels": True,
    "requestAllMembers": True,
    "storeMemberEvents": True,
    "downloadAllMemberAvatars": False,
    "downloadServerAssets": False,
    "downloadExpressions": False,
    "requestExpressionUploaders": True,
}
ARCHIVE_KEYS = {"server": "archiveServers", "channel": "archiveChannels", "thread": "archiveThreads"}


def _off(name: str, default: bool | str) -> Column:
    return F.lit("none") if isinstance(default, str) else F.lit(False)


def resolve_options(
    servers: DataFrame,
    channels: DataFrame,
    threads: DataFrame,
    overrides: DataFrame,
    options: Mapping[str, bool | str] | None = None,
    defaults: Mapping[str, bool | str] = DEFAULT_OPTIONS,
) -> DataFrame:
    """(type, id, one column per option) for every server, channel and thread.

    ``overrides``: seq, type, id and a nullable column per option it may change; only the first
    of a type and id counts. Channels without a server inherit the global options. The override
    table comes from a configuration and joins by size: Spark broadcasts it while it is small.
    """
    base = {**defaults, **(options or {})}
    names = list(base)
    changed = [n for n in names if n in overrides.columns]
    first = oldest(overrides, ["type", "id"], ["seq"])

    def level(objects: DataFrame, kind: str) -> DataFrame:
        """objects: id and the parent's options as ``_p_*``."""
        own = first.where(F.col("type") == kind).select(
            "id", *[F.col(n).alias(f"_o_{n}") for n in changed]
        )
        met = objects.join(own, "id", "left")
        value = {
            n: F.coalesce(F.col(f"_o_{n}"), F.col(f"_p_{n}")) if n in changed else F.col(f"_p_{n}")
            for n in names
        }
        on = value["archive"] & value[ARCHIVE_KEYS[kind]]
        return met.select(
            F.lit(kind).alias("type"), "id",
            *[F.when(on, value[n]).otherwise(_off(n, base[n])).alias(n) for n in names],
        )

    def below(objects: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
        above = parents.select(F.col("id").alias(parent), *[F.col(n).alias(f"_p_{n}") for n in names])
        met = objects.select("id", parent).join(above, parent, "left")
        return met.withColumns({
            f"_p_{n}": F.when(F.col(parent).isNull(), F.lit(base[n])).otherwise(F.col(f"_p_{n}"))
            for n in names
        })

    top = servers.select("id", *[F.lit(base[n]).alias(f"_p_{n}") for n in names])
    server_rows = level(top, "server")
    channel_rows = level(below(channels, server_rows, "guild_id"), "channel")
    thread_rows = level(below(threads, channel_rows, "parent_id"), "thread")
    return server_rows.unionByName(channel_rows).unionByName(thread_rows)


def needs_files(rows: DataFrame, download: Sequence[str] = DOWNLOAD_OPTIONS) -> DataFrame:
    """One row: does any of the option rows (global or override) turn on a download?"""
    wanted = F.lit(False)
    for name in download:
        if name in rows.columns:
            wanted = wanted | F.coalesce(F.col(name), F.lit(False))
    return rows.agg(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("needs_files"))
