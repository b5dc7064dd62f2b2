"""Checks that split a batch: each returns the rows that fail, or marks the reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.documents import Spec, group_paths, known_paths
from palimpsest.functions.scalars import PRIVATE_THREAD, col, snowflake_millis
from palimpsest.plans.ordered import HotKeys, carry, join_known


def check_derived_timestamp(messages: DataFrame, id_: str = "id", ms: str = "timestamp_ms") -> DataFrame:
    """Messages whose time is not the one their id carries."""
    return messages.where(~snowflake_millis(id_).eqNullSafe(F.col(ms)))


def check_parent_exists(
    messages: DataFrame, channels: DataFrame, threads: DataFrame, parent: str = "channel_id"
) -> DataFrame:
    """Messages of a channel that is neither a known channel nor a known thread."""
    known = channels.select(F.col("id").alias(parent)).unionByName(
        threads.select(F.col("id").alias(parent))
    )
    return messages.join(known, parent, "left_anti")


def check_required(df: DataFrame, required: Mapping[str, str | None], reason: str = "reason") -> DataFrame:
    """Rows with a missing or wrongly typed required column; ``reason`` names the columns.

    ``required`` maps a column to the type its text must have, or None for any.
    """
    problems = []
    for name, type_ in required.items():
        value = F.col(name) if type_ is None else F.col(name).try_cast(type_)
        problems.append(F.when(value.isNull(), F.lit(name)))
    return df.withColumn(reason, F.concat_ws(",", *problems)).where(F.col(reason) != "")


def _against_latest(batch: DataFrame, latest: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    stored = latest.select(*key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    return batch.join(stored, list(key))


def check_immutable(
    batch: DataFrame, latest: DataFrame, columns: Sequence[str], key: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows that change an immutable column, with the column names in ``reason``."""
    met = _against_latest(batch, latest, key, columns)
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in columns]
    return (
        met.withColumn("reason", F.concat_ws(",", *changed))
        .where(F.col("reason") != "")
        .drop(*[f"_old_{c}" for c in columns])
    )


def check_fill_once(
    batch: DataFrame, latest: DataFrame, column: str, key: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows that change a value which may only go from NULL to set."""
    met = _against_latest(batch, latest, key, [column])
    return met.where(F.col(column) != F.col(f"_old_{column}")).withColumnRenamed(
        f"_old_{column}", f"stored_{column}"
    )


def check_order(
    batch: DataFrame, latest: DataFrame, state: Sequence[str], key: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """Batch rows with ``result``: first, same, another or rejected, against the latest row."""
    stored = latest.select(
        *key, F.col(ts).alias("_old_ts"), F.struct(*state).alias("_old_state")
    )
    same = F.struct(*state).eqNullSafe(F.col("_old_state"))
    return (
        batch.join(stored, list(key), "left")
        .withColumn(
            "result",
            F.when(F.col("_old_ts").isNull(), "first")
            .when(same, "same")
            .when(F.col(ts) <= F.col("_old_ts"), "rejected")
            .otherwise("another"),
        )
        .drop("_old_ts", "_old_state")
    )


def _unknown_keys(payload: str, spec: Spec) -> Column:
    """(path, key) of the keys of a document that the spec doesn't name, at every level."""
    def level(path: str) -> Column:
        sub = F.col(payload) if not path else F.get_json_object(payload, f"$.{path}")
        known = [key for where, key in known_paths(spec) if where == path]
        keys = F.coalesce(F.json_object_keys(sub), F.array().cast("array<string>"))
        unknown = F.array_except(keys, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
        return F.transform(unknown, lambda k: F.struct(F.lit(path).alias("path"), k.alias("key")))

    return F.concat(*[level(path) for path in group_paths(spec)])


def unknown_keys_report(
    payloads: DataFrame, spec: Spec, payload: str = "payload", type_: str = "type"
) -> DataFrame:
    """(type, path, key, n) for every key without a column, at every level of the spec; the payloads are read once."""
    found = payloads.select(F.col(type_).alias("type"), F.explode(_unknown_keys(payload, spec)).alias("k"))
    return found.groupBy("type", "k.path", "k.key").agg(F.count("*").alias("n"))


def unknown_keys_of_types(
    payloads: DataFrame, specs: Mapping[str, Spec], payload: str = "payload", type_: str = "type"
) -> DataFrame:
    """``unknown_keys_report`` of documents of several types, each by its own spec, in one scan; other types are left out."""
    unknown = F.coalesce(*[F.when(F.col(type_) == name, _unknown_keys(payload, spec)) for name, spec in specs.items()])
    found = payloads.select(F.col(type_).alias("type"), F.explode(unknown).alias("k"))
    return found.groupBy("type", "k.path", "k.key").agg(F.count("*").alias("n"))


def flags_mismatch(users: DataFrame, flags: str = "flags", public: str = "public_flags") -> DataFrame:
    """Users whose flags are set and differ from the public ones."""
    return users.where(F.col(flags).isNotNull() & ~F.col(flags).eqNullSafe(F.col(public)))


def reaction_count_mismatch(
    declared: DataFrame, listed: DataFrame, key: Sequence[str], count: str = "count"
) -> DataFrame:
    """Keys whose declared count differs from the number of listed rows."""
    seen = listed.groupBy(*key).agg(F.count("*").alias("listed"))
    said = declared.select(*key, F.col(count).cast("long").alias("declared"))
    both = said.join(seen, list(key), "full_outer").select(
        *key,
        F.coalesce("declared", F.lit(0)).alias("declared"),
        F.coalesce("listed", F.lit(0)).alias("listed"),
    )
    return both.where(F.col("declared") != F.col("listed"))


def page_order_check(
    pages: DataFrame, page: Sequence[str], position: str, id_: str = "id", hot: HotKeys | None = None
) -> DataFrame:
    """Rows whose id does not strictly decrease within their page."""
    marked = carry(pages, page, [position], {"previous_id": F.col(id_)}, hot=hot)
    return marked.where(F.col("previous_id") <= F.col(id_))


def missing_uploaders(
    emojis: DataFrame, parent: str = "_guild_id", uploader: str = "user__id", deleted: str = "_deleted"
) -> DataFrame:
    """Per server: does a live emoji without a known uploader exist?"""
    missing = F.col(deleted).isNull() & F.col(uploader).isNull()
    return emojis.groupBy(parent).agg(F.max(missing).alias("missing"))


def uploader_exists(updates: DataFrame, users: DataFrame, uploader: str = "user__id") -> DataFrame:
    """Updates that name an uploader who is not a stored user."""
    return updates.join(users.select(F.col("id").alias(uploader)), uploader, "left_anti")


# Which option an event needs; the option that rules reactions has two parts.
# Fixed values of the archived service.
EVENT_OPTIONS = {
    "MESSAGE_CREATE": "storeNewMessages",
    "MESSAGE_UPDATE": "storeMessageEdits",
    "MESSAGE_DELETE": "storeMessageEdits",
    "GUILD_UPDATE": "storeServerEdits",
    "GUILD_ROLE_CREATE": "storeServerEdits",
    "GUILD_ROLE_UPDATE": "storeServerEdits",
    "GUILD_ROLE_DELETE": "storeServerEdits",
    "GUILD_EMOJIS_UPDATE": "storeServerEdits",
    "GUILD_MEMBERS_CHUNK": "storeMemberEvents",
    "GUILD_MEMBER_ADD": "storeMemberEvents",
    "GUILD_MEMBER_UPDATE": "storeMemberEvents",
    "GUILD_MEMBER_REMOVE": "storeMemberEvents",
    "VOICE_STATE_UPDATE": "storeMemberEvents",
    "CHANNEL_CREATE": "storeNewChannels",
    "CHANNEL_UPDATE": "storeChannelEdits",
    "CHANNEL_DELETE": "storeChannelEdits",
    "THREAD_CREATE": "storeChannelEdits",
    "THREAD_UPDATE": "storeChannelEdits",
    "THREAD_DELETE": "storeChannelEdits",
    "THREAD_LIST_SYNC": "archiveThreads",
    "MESSAGE_REACTION_ADD": "storeReactionEvents",
    "MESSAGE_REACTION_REMOVE": "storeReactionEvents",
    "MESSAGE_REACTION_REMOVE_EMOJI": "storeReactionEvents",
    "MESSAGE_REACTION_REMOVE_ALL": "storeReactionEvents",
}


def archive_gate(
    events: DataFrame,
    options: DataFrame,
    object_id: str = "object_id",
    event: str = "t",
    needs: Mapping[str, str] = EVENT_OPTIONS,
    parent_id: str = "parent_id",
) -> DataFrame:
    """Events that the resolved options of their object let through.

    ``options`` has ``id`` and one boolean column per option name. An object without a row, as one that is just being
    created, goes by the row of its parent (column ``parent_id`` of the events, if there is one). Events not
    in ``needs`` pass when their object or its parent has a row, as nothing rules them.
    """
    used = sorted(set(needs.values()))
    extra = ["reactionArchivalMode"] if "reactionArchivalMode" in options.columns else []
    names = [*used, *extra]

    def rules(key: str, mark: str) -> DataFrame:
        return options.select(F.col("id").alias(key), *[F.col(n).alias(f"{mark}{n}") for n in names], F.lit(True).alias(f"{mark}known"))

    met = events.join(rules(object_id, "_own_"), object_id, "left")
    if parent_id in events.columns:
        met = join_known(met, rules(parent_id, "_parent_"), parent_id)
    rule_of = {
        n: F.when(F.col("_own_known"), F.col(f"_own_{n}")).otherwise(
            F.col(f"_parent_{n}") if parent_id in events.columns else F.lit(None))
        for n in (*names, "known")
    }
    allowed = rule_of["known"]
    for name in reversed(used):
        events_of = [e for e, n in needs.items() if n == name]
        rule = rule_of[name]
        if name == "storeReactionEvents" and extra:
            rule = rule & (rule_of["reactionArchivalMode"] == "users")
        allowed = F.when(F.col(event).isin(*events_of), rule).otherwise(allowed)
    return met.where(allowed).select(*events.columns)


def private_thread_filter(df: DataFrame, type_: str | Column = "type") -> DataFrame:
    return df.where(col(type_) != PRIVATE_THREAD)
