"""Reads of the archive as it was: state at a time, validity, differences, hydrated messages.

A time ``t`` in ms sees every row with a packed time up to ``t << 1 | 1``; creation rows (time 0)
are visible at every t. ``history`` holds all versions of an object; ``current`` has one row per
object with the immutable columns and the deletion mark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import decode_timing, snowflake_millis, time_bound
from palimpsest.operators.capture import compact_snapshots
from palimpsest.plans.ordered import HotKeys, carry, find_hot_keys, join_known, newest
from palimpsest.spec import REFERENCING_TYPES


def latest(history: DataFrame, key: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Current row per object."""
    return newest(history, key, [ts])


def as_of(
    history: DataFrame,
    t: int | Column | None,
    key: Sequence[str] = ("id",),
    *,
    ts: str = "ts",
    current: DataFrame | None = None,
    immutable: Sequence[str] = (),
) -> DataFrame:
    """State of each object at t; objects first seen later are not there.

    The bound is a filter on the scan and the choice an aggregate that combines before the
    shuffle. With ``current`` the immutable columns are joined.
    """
    rows = history if t is None else history.where(F.col(ts) <= time_bound(t))
    state = newest(rows, key, [ts])
    if current is not None:
        state = state.join(current.select(*key, *immutable), list(key))
    return state


def as_of_children(
    history: DataFrame,
    current: DataFrame,
    t: int | None,
    parents: Sequence[int] | None = None,
    *,
    parent: str = "parent_id",
    key: Sequence[str] = ("id",),
    ts: str = "ts",
    deleted: str = "_deleted",
    immutable: Sequence[str] = (),
) -> DataFrame:
    """State at t of the children of some or all parents, with their deletion mark.

    A child deleted before or after t is still returned. A NULL in ``parents`` matches the
    children without a parent.
    """
    owners = current.select(*key, parent, deleted, *immutable)
    if parents is not None:
        wanted = F.col(parent).isin(*[p for p in parents if p is not None])
        if None in parents:
            wanted = wanted | F.col(parent).isNull()
        owners = owners.where(F.coalesce(wanted, F.lit(False)))
        history = history.join(owners.select(*key), list(key), "left_semi")
    return as_of(history, t, key, ts=ts).join(owners, list(key))


def as_of_join(
    facts: DataFrame,
    history: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    *,
    fact_ms: str = "ms",
    ts: str = "ts",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Each fact with the columns of the history row that was valid at the fact's own time.

    Facts and history share one ordered pass per key, so no pair is formed that the result does
    not have, and a hot key is cut into slices.
    """
    wide = {f"_f_{c}": F.col(c) for c in facts.columns}
    left = facts.select(
        *key, time_bound(fact_ms).alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*[c.alias(n[3:]) for n, c in wide.items()]).alias("_fact"),
        F.lit(None).cast(history.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_row"),
    )
    right = history.select(
        *key, F.col(ts).alias("_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"),
        F.struct(*columns).alias("_row"),
    )
    met = carry(left.unionByName(right), key, ["_at", "_kind"], {"_valid": F.col("_row")}, hot=hot)
    return met.where(F.col("_kind") == 1).select(
        "_fact.*", *[F.col(f"_valid.{c}").alias(c) for c in columns]
    )


def history_intervals(
    history: DataFrame, key: Sequence[str] = ("id",), ts: str = "ts", hot: HotKeys | None = None
) -> DataFrame:
    """The change log with valid_from and valid_to (exclusive; NULL while current)."""
    return carry(
        history.withColumn("valid_from", F.col(ts)), key, [ts], {"valid_to": F.col(ts)},
        backward=True, hot=hot,
    )


def version_diff(
    history: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = ("id",),
    ts: str = "ts",
    hot: HotKeys | None = None,
) -> DataFrame:
    """One row per changed column between neighbouring versions, with old and new value as text."""
    marked = carry(history, key, [ts], {"_before": F.struct(*columns)}, hot=hot)
    changes = F.filter(
        F.array(*[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_before.{c}").cast("string").alias("old_value"),
                F.col(c).cast("string").alias("new_value"),
                (~F.col(f"_before.{c}").eqNullSafe(F.col(c))).alias("changed"),
            )
            for c in columns
        ]),
        lambda change: change["changed"],
    )
    return (
        marked.where(F.col("_before").isNotNull())
        .select(*key, ts, F.explode(changes).alias("change"))
        .select(*key, ts, "change.column", "change.old_value", "change.new_value")
    )


def observed_intervals(
    obs: DataFrame, key: Sequence[str], mutable: Sequence[str], *, columns: Sequence[str] = (), **how
) -> DataFrame:
    """``history_intervals`` of what is kept of the observations; ``columns`` go along."""
    history, hot = _kept_of(obs, key, mutable, columns, **how)
    return history_intervals(history, key, hot=hot)


def observed_diff(obs: DataFrame, key: Sequence[str], mutable: Sequence[str], **how) -> DataFrame:
    """``version_diff`` of what is kept of the observations."""
    history, hot = _kept_of(obs, key, mutable, (), **how)
    return version_diff(history, mutable, key, hot=hot)


def _kept_of(obs, key, mutable, columns, **how) -> tuple[DataFrame, HotKeys]:
    """The history and the hot keys of the observations, whose keys are counted once, on the scan of these columns.

    A key has no more rows in the history than before, so the hot keys of the history are among them. With the keys of
    the compaction known, the pass after it stands on the same partitioning and its rows are not computed again.
    """
    (hot,) = find_hot_keys(obs, key)
    kept = compact_snapshots(obs, key, mutable, hot=hot, **how)
    return kept.select(*key, "ts", *mutable, *columns), hot


def members_as_of(
    history: DataFrame,
    t: int | None,
    *,
    guild: int | None = None,
    key: Sequence[str] = ("guild_id", "user_id"),
    ts: str = "ts",
    joined: str = "joined_at",
) -> DataFrame:
    """Members at t; those gone give only the user and ``left_at``, the time they left."""
    rows = history if guild is None else history.where(F.col(key[0]) == guild)
    return as_of(rows, t, key, ts=ts).withColumn(
        "left_at", F.when(F.col(joined).isNull(), F.col(ts))
    )


def hydrate_messages(
    messages: DataFrame,
    users: DataFrame,
    attachments: DataFrame,
    webhooks: DataFrame,
    t: int | None,
    *,
    user_name: str = "username",
    attachment_name: str = "filename",
) -> DataFrame:
    """Messages with author, mentions and attachments as they were at t, and the time that the id carries.

    ``messages``: rows at t with id, author_id, author_kind, mention_ids, attachment_ids;
    ``users``: user history; ``webhooks``: (internal_id, username, ...). Adds created_ms, the names (author_name, mentions,
    attachments) and the whole objects: author_user and author_webhook (structs), mention_users and attachment_files (arrays
    in the order of the ids, NULL where an object is unknown).

    All that a message refers to is looked up in one join of references and comes back in one
    group per message, which is never larger than the arrays of that row; the wide rows meet it
    once. A user that wrote a third of all messages is a skewed join key, which Spark splits.
    """
    def refs(role: str, kind: Column, ids: Column) -> Column:
        return F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda i, pos: F.struct(
            F.lit(role).alias("role"), pos.alias("pos"), kind.alias("kind"), i.cast("long").alias("ref")
        ))

    placed = messages.select("id", F.explode(F.concat(
        refs("author", F.col("author_kind"), F.array("author_id")),
        refs("mention", F.lit("user"), F.col("mention_ids")),
        refs("attachment", F.lit("file"), F.col("attachment_ids")),
    )).alias("r")).select("id", "r.*")

    sources = {
        "user": (as_of(users, t), "id", user_name),
        "webhook": (webhooks, "internal_id", "username"),
        "file": (attachments, "id", attachment_name),
    }
    kinds = {kind: rows.select(F.struct(*rows.columns).alias("o")).schema["o"].dataType for kind, (rows, _, _) in sources.items()}

    def known(kind: str, rows: DataFrame, id_: str, name: str) -> DataFrame:
        objects = [
            (F.struct(*rows.columns) if k == kind else F.lit(None).cast(type_)).alias(f"_{k}") for k, type_ in kinds.items()
        ]
        return rows.select(F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("ref"), F.col(name).alias("name"), *objects)

    objects = reduce(DataFrame.unionByName, [known(kind, *source) for kind, source in sources.items()])
    found = placed.join(objects, ["kind", "ref"], "left")

    def listed(role: str, object_: str) -> Column:
        return F.sort_array(F.collect_list(F.when(
            F.col("role") == role, F.struct("pos", "name", F.col(object_).alias("object")))))

    def author(column: str) -> Column:
        return F.any_value(F.when(F.col("role") == "author", F.col(column)), True)

    grouped = found.groupBy("id").agg(
        author("name").alias("author_name"), author("_user").alias("author_user"), author("_webhook").alias("author_webhook"),
        listed("mention", "_user").alias("_mentions"), listed("attachment", "_file").alias("_files"),
    )
    return messages.join(grouped, "id", "left").withColumns({
        "created_ms": snowflake_millis("id"),
        "mentions": F.transform("_mentions", lambda e: e["name"]), "mention_users": F.transform("_mentions", lambda e: e["object"]),
        "attachments": F.transform("_files", lambda e: e["name"]), "attachment_files": F.transform("_files", lambda e: e["object"]),
    }).drop("_mentions", "_files")


SAME_CHANNEL, PARENT_CHANNEL, SAME_GUILD = 0, 1, 0


def _places(channels: DataFrame, threads: DataFrame) -> DataFrame:
    """(channel_id, parent, guild) of every channel and thread; guild comes from the parent."""
    own = channels.select(
        F.col("id").alias("channel_id"), F.lit(None).cast("long").alias("_parent"),
        F.col("guild_id").alias("_guild"),
    )
    below = threads.select(F.col("id").alias("channel_id"), F.col("parent_id").alias("_parent")).join(
        channels.select(F.col("id").alias("_parent"), F.col("guild_id").alias("_guild")), "_parent", "left"
    )
    return own.unionByName(below)


def resolve_reference(messages: DataFrame, channels: DataFrame, threads: DataFrame) -> DataFrame:
    """Codes in ref_channel_id and ref_guild_id to real ids; NULL stays NULL."""
    met = messages.join(_places(channels, threads), "channel_id", "left")
    code = F.col("ref_channel_id")
    return met.withColumns({
        "ref_channel_id": F.when(code == SAME_CHANNEL, F.col("channel_id"))
        .when(code == PARENT_CHANNEL, F.col("_parent")).otherwise(code),
        "ref_guild_id": F.when(F.col("ref_guild_id") == SAME_GUILD, F.col("_guild"))
        .otherwise(F.col("ref_guild_id")),
    }).drop("_parent", "_guild").select(*messages.columns)


def encode_reference(messages: DataFrame, channels: DataFrame, threads: DataFrame) -> DataFrame:
    """The reverse of ``resolve_reference``."""
    met = messages.join(_places(channels, threads), "channel_id", "left")
    ref = F.col("ref_channel_id")
    return met.withColumns({
        "ref_channel_id": F.when(ref == F.col("channel_id"), SAME_CHANNEL)
        .when(ref == F.col("_parent"), PARENT_CHANNEL).otherwise(ref).cast("long"),
        "ref_guild_id": F.when(F.col("ref_guild_id") == F.col("_guild"), SAME_GUILD)
        .otherwise(F.col("ref_guild_id")).cast("long"),
    }).drop("_parent", "_guild").select(*messages.columns)


def join_referenced(
    messages: DataFrame,
    stored: DataFrame,
    columns: Sequence[str],
    *,
    types: Sequence[int] = REFERENCING_TYPES,
    ref: str = "ref_message_id",
    ref_channel: str | None = "ref_channel_id",
) -> DataFrame:
    """Messages with ``referenced``, the replied-to message; NULL when not stored or of other types.

    ``stored`` is the message state at the same t. Messages of other types skip the join.
    """
    # The reference embeds nothing unless both the message and its channel are named.
    wanted = F.col("type").isin(*types) & F.col(ref).isNotNull()
    if ref_channel is not None:
        wanted = wanted & F.col(ref_channel).isNotNull()
    target = stored.select(F.col("id").alias(ref), F.struct(*columns).alias("referenced"))
    looking = messages.where(wanted).join(target, ref, "left")
    others = messages.where(~F.coalesce(wanted, F.lit(False)))
    return looking.unionByName(others, allowMissingColumns=True)


def hydrate_interaction(
    messages: DataFrame,
    users: DataFrame,
    t: int | None,
    *,
    user: str = "interaction_user_id",
    target: str = "interaction_target_id",
    name: str = "username",
    targets: DataFrame | None = None,
) -> DataFrame:
    """Names of the interaction's user and target as of t; ``targets`` if they are stored apart.

    Most messages are no interaction and lack both ids.
    """
    people = as_of(users, t)
    aimed = people if targets is None else as_of(targets, t)
    named = join_known(messages, people.select(F.col("id").alias(user), F.col(name).alias("interaction_user")), user)
    return join_known(named, aimed.select(F.col("id").alias(target), F.col(name).alias("interaction_target")), target)


def emojis_as_of(
    history: DataFrame,
    current: DataFrame,
    users: DataFrame,
    t: int | None,
    *,
    parent: str = "_guild_id",
    uploader: str = "user__id",
    name: str = "username",
) -> DataFrame:
    """Emojis at t with the uploader's name at t where the uploader is known."""
    rows = as_of_children(history, current, t, parent=parent, immutable=[uploader])
    people = as_of(users, t).select(F.col("id").alias(uploader), F.col(name).alias("uploader_name"))
    return join_known(rows, people, uploader)


def tags_as_of(history: DataFrame, current: DataFrame, t: int | None, channels: Sequence[int] | None = None) -> DataFrame:
    """Forum tags of channels at t."""
    return as_of_children(history, current, t, channels, parent="channel_id")


def deleted_objects(current: DataFrame, deleted: str = "_deleted") -> DataFrame:
    """Objects marked deleted with ``deleted_ms`` and ``seen_live`` (else found out later)."""
    when = decode_timing(deleted)
    return current.where(F.col(deleted).isNotNull()).withColumns(
        {"deleted_ms": when["timestamp_ms"], "seen_live": when["realtime"]}
    )


def server_at(
    parts: Mapping[str, tuple[DataFrame, DataFrame]],
    t: int | None,
    *,
    parent: str = "guild_id",
    servers: Sequence[int] | None = None,
    name: str = "name",
    members: DataFrame | None = None,
    member_name: str = "nick",
) -> DataFrame:
    """(type, guild_id, id, ts, name, deleted) of everything that was in the servers at t.

    ``parts`` maps a type to its (history, current); each current table has the server id in
    ``parent``. ``members`` is the member history: who was in a server at t comes as type ``member`` under the
    id of the user.
    """
    report = None
    if members is not None:
        there = members_as_of(members, t).where(F.col("left_at").isNull())
        if servers is not None:
            there = there.where(F.col("guild_id").isin(*servers))
        report = there.select(
            F.lit("member").alias("type"), "guild_id", F.col("user_id").alias("id"), "ts",
            F.col(member_name).alias("name"), F.lit(None).cast("long").alias("_deleted"),
        )
    for kind, (history, current) in parts.items():
        rows = as_of_children(history, current, t, servers, parent=parent).select(
            F.lit(kind).alias("type"), F.col(parent).alias("guild_id"), "id", "ts",
            F.col(name).alias("name"), F.col("_deleted"),
        )
        report = rows if report is None else report.unionByName(rows)
    return report
