"""From observations to history: which observation is a change, and what a batch does to the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.documents import canonical_json
from palimpsest.functions.scalars import (
    SIGNED_URL_PREFIXES, author_kind, encode_timing, normalize_media_url,
)
from palimpsest.plans.ordered import HotKeys, carry, find_hot_keys, join_by_key, newest, oldest
from palimpsest.plans.staging import staged

ORDER = ("ts", "seq")
KEPT = ("first", "another")


def state_of(columns: Sequence[str], extra: str | None = "_extra") -> Column:
    """What two observations of an object are compared by."""
    parts = [F.col(c) for c in columns]
    if extra is not None:
        parts.append(canonical_json(extra).alias(extra))
    return F.struct(*parts)


def classify_snapshots(
    batch: DataFrame,
    key: Sequence[str],
    state: Column,
    *,
    order: Sequence[str] = ORDER,
    latest: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``result`` to each observation: first, another, same or rejected.

    An observation equal to the last kept one is the same; a different one is kept if it is newer,
    else rejected. ``latest`` holds one stored row per key to start from.

    Rows of one time form a group. A group ends with its first state, or, if that is what was
    stored before, with its second distinct one (which then is newer than the stored row). So the
    only thing that depends on the past is one bit per group, ``takes second``: constant for most
    groups, and where two groups with several states follow each other it copies or flips the bit
    before. The bit is the last constant and the parity of the flips since, so running values do
    it without going through a key row by row.
    """
    ts, arrival = order[0], list(order[1:])
    if hot is None:
        (hot,) = find_hot_keys(batch, key)
    rows = batch.withColumn("_state", state)
    if latest is None:
        stored_type = rows.schema["_state"].dataType
        rows = rows.withColumns({"_stored_ts": F.lit(None).cast("long"), "_stored": F.lit(None).cast(stored_type)})
    else:
        stored = latest.select(*key, F.col(ts).alias("_stored_ts"), state.alias("_stored"))
        rows = join_by_key(rows, stored, key)
    # Without hot keys one partitioning serves the groups and the keys. A hot key is dealt anew by its times: the
    # exchange lets Spark split the key in the join before it, and the groups don't meet in one task.
    rows = rows.repartition(*key, *([ts] if hot else []))
    rows = rows.withColumn("_late", F.coalesce(F.col(ts) <= F.col("_stored_ts"), F.lit(False)))

    in_group = Window.partitionBy(*key, ts).orderBy(*arrival)
    whole = in_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_one": F.first("_state").over(whole),
        "_head": F.row_number().over(in_group) == 1,
    })
    other = ~F.col("_state").eqNullSafe(F.col("_one"))
    rows = rows.withColumn("_two", F.first(
        F.when(other, F.struct(F.col("_state").alias("state"), F.struct(*arrival).alias("place"))), ignorenulls=True
    ).over(whole))

    several_anywhere = True
    if hot:
        # Slices read the rows again, so they are written; then it costs little to see whether any
        # group has several states. If none has, the bit is 0 everywhere.
        rows = staged(rows, "observations")
        several_anywhere = not rows.where(F.col("_two").isNotNull()).isEmpty()

    giving = F.col("_head") & ~F.col("_late")
    group = F.struct(F.col("_one").alias("one"), F.col("_two.state").alias("two"), F.col("_two").isNotNull().alias("several"))
    rows = carry(rows, key, order, {"_past": F.when(giving, group)}, strict=True, hot=hot, stored=True)
    start = F.when(F.col("_stored_ts").isNotNull(), F.struct(
        F.col("_stored").alias("one"), F.col("_stored").alias("two"), F.lit(False).alias("several")
    ))
    rows = rows.withColumn("_past", F.coalesce("_past", start))

    several = F.col("_two").isNotNull() & F.col("_past").isNotNull()
    if_first = several & F.col("_past.one").eqNullSafe(F.col("_one"))
    if_second = F.when(F.col("_past.several"), several & F.col("_past.two").eqNullSafe(F.col("_one"))).otherwise(if_first)
    rows = rows.withColumns({"_if_first": F.coalesce(if_first, F.lit(False)), "_if_second": F.coalesce(if_second, F.lit(False))})
    constant = F.col("_if_first") == F.col("_if_second")
    flips = F.col("_if_first") & ~F.col("_if_second")
    fixed = F.struct(F.col("_if_first").alias("bit"), F.col("_flips").alias("at"))
    if several_anywhere:
        rows = carry(rows, key, order, {}, strict=True, hot=hot, sums={"_flips": (giving & flips).cast("long")})
        rows = carry(rows, key, order, {"_fixed": F.when(giving & constant, fixed)}, strict=True, hot=hot)
    else:
        rows = rows.withColumn("_flips", F.lit(0).cast("long")).withColumn("_fixed", F.when(F.lit(False), fixed))

    odd = (F.col("_flips") - F.coalesce("_fixed.at", F.lit(0))) % 2 == 1
    past_second = F.coalesce("_fixed.bit", F.lit(False)) != odd
    second = F.when(past_second, F.col("_if_second")).otherwise(F.col("_if_first"))
    base = F.when(past_second & F.col("_past.several"), F.col("_past.two")).otherwise(F.col("_past.one"))
    place = F.struct(*arrival)
    after_first = F.when(F.col("_state").eqNullSafe(F.col("_one")), "same").otherwise("rejected")
    result = (
        F.when(F.col("_late"), F.when(F.col("_state").eqNullSafe(F.col("_stored")), "same").otherwise("rejected"))
        .when(F.col("_past").isNull(), F.when(F.col("_head"), "first").otherwise(after_first))
        .when(second, F.when(place < F.col("_two.place"), "same")
              .when(place == F.col("_two.place"), "another")
              .when(F.col("_state").eqNullSafe(F.col("_two.state")), "same").otherwise("rejected"))
        .when(F.col("_one").eqNullSafe(base), "same")
        .when(F.col("_head"), "another")
        .otherwise(after_first)
    )
    return rows.withColumn("result", result).select(*batch.columns, "result")


def compact_snapshots(
    obs: DataFrame,
    key: Sequence[str],
    mutable: Sequence[str],
    *,
    extra: str | None = "_extra",
    order: Sequence[str] = ORDER,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Keep the first row of each object and each row that differs from the one before."""
    marked = classify_snapshots(obs, key, state_of(mutable, extra), order=order, hot=hot)
    return marked.where(F.col("result").isin(*KEPT))


def comparable_embeds(embeds: str | Column, prefixes: Sequence[str] = SIGNED_URL_PREFIXES) -> Column:
    """Embeds with the signatures cut from image, thumbnail and video URLs."""
    column = F.col(embeds) if isinstance(embeds, str) else embeds

    def unsigned(embed: Column) -> Column:
        for part in ("image", "thumbnail", "video"):
            media = embed[part]
            embed = embed.withField(part, F.when(
                media.isNotNull(),
                media.withField("url", normalize_media_url(media["url"], prefixes))
                .withField("proxy_url", normalize_media_url(media["proxy_url"], prefixes)),
            ))
        return embed

    # No embeds and an empty list are the same.
    return F.when(F.size(column) > 0, F.transform(column, unsigned))


def compact_messages(
    obs: DataFrame,
    key: Sequence[str] = ("id",),
    mutable: Sequence[str] = ("content", "edited_timestamp", "flags"),
    *,
    embeds: str = "embeds",
    extra: str | None = "_extra",
    prefixes: Sequence[str] = SIGNED_URL_PREFIXES,
    order: Sequence[str] = ORDER,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``compact_snapshots`` where a fresh signature is no edit; stored URLs stay as they came."""
    state = F.struct(state_of(mutable, extra).alias("columns"), comparable_embeds(embeds, prefixes).alias(embeds))
    marked = classify_snapshots(obs, key, state, order=order, hot=hot)
    return marked.where(F.col("result").isin(*KEPT))


def apply_batch(
    current: DataFrame,
    previous: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    mutable: Sequence[str],
    *,
    immutable: Sequence[str] = (),
    extra: str | None = "_extra",
    order: Sequence[str] = ORDER,
    deleted: str = "_deleted",
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge a batch; gives the new current table, the new previous table and the results.

    Immutable columns and the deletion mark of a stored object stay. The classified batch is
    written once, as three outputs read it; it is as large as the batch, not as the archive.
    """
    ts = order[0]
    versioned = [ts, *mutable, *([extra] if extra else [])]
    results = staged(
        classify_snapshots(batch, key, state_of(mutable, extra), order=order, latest=current, hot=hot),
        "batch-results",
    )
    current_after, added = merge_kept(
        current, results.where(F.col("result").isin(*KEPT)), key, versioned, immutable=immutable, deleted=deleted)
    return current_after, previous.select(*key, *versioned).unionByName(added), results


def merge_kept(
    current: DataFrame, kept: DataFrame, key: Sequence[str], versioned: Sequence[str], *,
    immutable: Sequence[str] = (), deleted: str = "_deleted",
) -> tuple[DataFrame, DataFrame]:
    """The current rows after the ``kept`` rows of a batch, and what goes to the older rows; ``versioned`` begins with the time."""
    ts = versioned[0]
    head = newest(kept.select(*key, *immutable, *versioned), key, [ts])
    renamed = head.select(
        *key, F.lit(True).alias("_new"),
        *[F.col(c).alias(f"_new_{c}") for c in (*immutable, *versioned)],
    )
    met = join_by_key(current.withColumn("_old", F.lit(True)), renamed, key, "full_outer")
    current_after = met.select(
        *key,
        *[F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in immutable],
        *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in versioned],
        F.col(deleted),
    )
    heads = head.select(*key, F.col(ts).alias("_head_ts"))
    replaced = join_by_key(current, heads, key, "left_semi").select(*key, *versioned)
    passed = join_by_key(kept, heads, key, "inner").where(F.col(ts) < F.col("_head_ts")).select(*key, *versioned)
    return current_after, replaced.unionByName(passed)


def fill_partial(
    obs: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    is_leave: Column,
    *,
    order: Sequence[str] = ORDER,
    latest: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Missing values of a partial update come from the last row that had them; a leave forgets.

    ``latest`` (one stored row per key, with the same columns) is what a batch starts from.
    """
    remembered = {
        f"_fill_{c}": F.when(is_leave, F.struct(F.lit(None).cast(obs.schema[c].dataType).alias("x")))
        .when(F.col(c).isNotNull(), F.struct(F.col(c).alias("x")))
        for c in columns
    }
    if hot is None:
        (hot,) = find_hot_keys(obs, key)
    rows = carry(obs, key, order, remembered, hot=hot)
    if latest is not None:
        stored = latest.select(*key, *[F.col(c).alias(f"_stored_{c}") for c in columns])
        rows = join_by_key(rows, stored, key)
        if hot:
            rows = rows.repartition(*key, order[0])
    filled = {}
    for c in columns:
        memory = F.col(f"_fill_{c}")
        past = memory["x"] if latest is None else F.when(memory.isNotNull(), memory["x"]).otherwise(F.col(f"_stored_{c}"))
        filled[c] = F.when(is_leave, F.lit(None)).otherwise(F.coalesce(F.col(c), past))
    unwanted = [f"_fill_{c}" for c in columns] + [f"_stored_{c}" for c in columns]
    return rows.withColumns(filled).drop(*unwanted)


MEMBER_KEY = ("guild_id", "user_id")


def members_append(
    history: DataFrame | None,
    joins: DataFrame,
    leaves: DataFrame,
    mutable: Sequence[str],
    *,
    partial: Sequence[str] = ("deaf", "mute"),
    joined: str = "joined_at",
    key: Sequence[str] = MEMBER_KEY,
    extra: str | None = None,
    order: Sequence[str] = ORDER,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Rows to append to the membership history; a leave is a row without a join time.

    A second leave is no change; the leave of a member never seen is kept.
    """
    latest = None if history is None else newest(history, key, [order[0]])
    marked = members_results(
        latest, joins, leaves, mutable, partial=partial, joined=joined, key=key, extra=extra, order=order, hot=hot)
    return marked.where(F.col("result").isin(*KEPT))


def members_results(
    latest: DataFrame | None,
    joins: DataFrame,
    leaves: DataFrame,
    mutable: Sequence[str],
    *,
    partial: Sequence[str] = ("deaf", "mute"),
    joined: str = "joined_at",
    key: Sequence[str] = MEMBER_KEY,
    extra: str | None = None,
    order: Sequence[str] = ORDER,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All member rows with ``result``; ``latest`` holds the last history row of each member."""
    gone = leaves.select(*key, *order)
    # ``key`` and ``order`` survive in a leave row, all else is blank.
    obs = joins.unionByName(gone, allowMissingColumns=True)
    if hot is None:
        (hot,) = find_hot_keys(obs, key)
    filled = fill_partial(
        obs, key, partial, F.col(joined).isNull(), order=order, latest=latest, hot=hot
    )
    return classify_snapshots(
        filled, key, state_of(mutable, extra), order=order, latest=latest, hot=hot
    )


def mark_deleted(
    current: DataFrame,
    deletions: DataFrame,
    key: Sequence[str] = ("id",),
    *,
    deleted: str = "_deleted",
    order: str = "seq",
) -> DataFrame:
    """Set the deletion time; the last mark wins over earlier ones, unknown ids do nothing."""
    marks = deletions.groupBy(*key).agg(F.max_by(deleted, order).alias("_mark"))
    return (
        current.join(marks, list(key), "left")
        .withColumn(deleted, F.coalesce("_mark", deleted))
        .drop("_mark")
    )


def deletion_results(current: DataFrame, deletions: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """The deletions with ``matched``: was there a row to mark?"""
    known = current.select(*key, F.lit(True).alias("_known"))
    return (
        deletions.join(known, list(key), "left")
        .withColumn("matched", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def sync_deletions(
    current: DataFrame,
    listing: DataFrame,
    parents: DataFrame,
    *,
    parent: str = "parent_id",
    id_: str = "id",
    deleted: str = "_deleted",
    at: str = "at",
) -> DataFrame:
    """Mark live children that a complete list of their parent does not have.

    ``listing`` has (parent, id); ``parents`` has each parent that was listed, even if the list
    was empty, with the packed time ``at``. Children of other parents stay untouched.
    """
    listed = listing.select(parent, id_).distinct().withColumn("_listed", F.lit(True))
    met = current.join(parents.select(parent, at), parent, "left").join(listed, [parent, id_], "left")
    missing = F.col(deleted).isNull() & F.col(at).isNotNull() & F.col("_listed").isNull()
    return (
        met.withColumn(deleted, F.when(missing, F.col(at)).otherwise(F.col(deleted)))
        .drop(at, "_listed")
        .select(*current.columns)
    )


def sync_members(
    history: DataFrame,
    live: DataFrame,
    parents: DataFrame,
    *,
    key: Sequence[str] = MEMBER_KEY,
    ts: str = "ts",
    joined: str = "joined_at",
    at: str = "at",
) -> DataFrame:
    """Leave rows for stored members that a complete member list does not have.

    Members already gone give nothing, so running it twice changes nothing.
    """
    guild = key[0]
    present = newest(history, key, [ts]).where(F.col(joined).isNotNull())
    missing = present.join(parents.select(guild, at), guild).join(
        live.select(*key), list(key), "left_anti"
    )
    blank = [c for c in history.columns if c not in (*key, ts)]
    return missing.select(
        *key, F.col(at).alias(ts),
        *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in blank],
    ).select(*history.columns)


def set_uploader(
    emojis: DataFrame, updates: DataFrame, *, id_: str = "id", uploader: str = "user__id", order: str = "seq"
) -> DataFrame:
    """Set the uploader on current rows; no history row comes of it."""
    last = updates.groupBy(id_).agg(F.max_by(uploader, order).alias("_uploader"))
    return (
        emojis.join(last, id_, "left")
        .withColumn(uploader, F.coalesce("_uploader", uploader))
        .drop("_uploader")
    )


PERSONA = ("webhook_id", "username", "avatar")
# Three hex digits: 4096 groups that number their rows independently.
GROUP_DIGITS = 3


def number_rows(df: DataFrame, natural: Sequence[str], key: str, start: int | Column = 0) -> DataFrame:
    """Consecutive keys in the order of the hash of the natural key, without one global sort.

    Rows are numbered within 4096 hash groups; the group offsets come from 4096 counts.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in natural])
    hashed = df.withColumn("_digest", F.md5(text)).withColumn(
        "_group", F.substring("_digest", 1, GROUP_DIGITS)
    )
    counts = hashed.groupBy("_group").agg(F.count("*").alias("_n"))
    # 4096 rows at most.
    offsets = counts.select(
        "_group",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_digest", *natural))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        hashed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_group")
        .withColumn(key, (F.col("_offset") + F.col("_place") + first).cast("long"))
        .drop("_digest", "_group", "_place", "_offset")
    )


def webhook_dimension(
    dimension: DataFrame, messages: DataFrame, natural: Sequence[str] = PERSONA, key: str = "internal_id"
) -> tuple[DataFrame, DataFrame]:
    """Intern the personas of webhook messages; gives the dimension and the messages with key.

    NULL avatars are equal; personas already stored keep their key.
    """
    def matches(left: DataFrame, right: DataFrame) -> Column:
        condition = F.lit(True)
        for c in natural:
            condition = condition & left[c].eqNullSafe(right[c])
        return condition

    personas = messages.where(F.col(natural[0]).isNotNull()).select(*natural).distinct()
    # Few rows that the messages are read for; numbering and lookup read them again.
    fresh = staged(personas.join(dimension, matches(personas, dimension), "left_anti"), "personas")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
    added = number_rows(fresh, natural, key, int(top))
    after = dimension.select(key, *natural).unionByName(added.select(key, *natural))
    lookup = after.select(F.col(key), *[F.col(c).alias(f"_d_{c}") for c in natural])
    condition = F.lit(True)
    for c in natural:
        condition = condition & messages[c].eqNullSafe(lookup[f"_d_{c}"])
    keyed = messages.join(lookup, condition, "left").drop(*[f"_d_{c}" for c in natural])
    return after, keyed


def insert_if_absent(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Rows to add: the first per key, where the table has none."""
    return oldest(rows, key, order).join(table.select(*key), list(key), "left_anti")


def explode_message_users(messages: DataFrame, received: str = "received_ms") -> DataFrame:
    """One observation per user seen in a message, at the time of receipt and not live.

    ``messages``: id, ``author``, ``webhook_id``, ``application_id``, ``mentions`` (array),
    ``interaction_user``, ``interaction_target`` and ``referenced`` with the same four, where
    users are structs of one type.
    """
    def addressed(prefix: str = "") -> Column:
        return F.concat(
            F.coalesce(F.col(prefix + "mentions"), F.array()),
            F.array(F.col(prefix + "interaction_user"), F.col(prefix + "interaction_target")),
        )

    def writer(prefix: str = "") -> Column:
        kind = author_kind(prefix + "webhook_id", prefix + "application_id")
        return F.array(F.when(kind == "user", F.col(prefix + "author")))

    # In the order in which the archive takes them: the embedded message before the author.
    embedded = F.array()
    if "referenced" in messages.columns:
        embedded = F.when(
            F.col("referenced").isNotNull(), F.concat(addressed("referenced."), writer("referenced."))
        ).otherwise(F.array())
    people = F.concat(addressed(), embedded, writer())
    seen = messages.select(
        F.col("id").alias("message_id"),
        encode_timing(received, F.lit(False)).alias("ts"),
        F.posexplode(F.filter(people, lambda u: u.isNotNull())).alias("seq", "user"),
    )
    return seen.select("message_id", "ts", "seq", "user.*")


def explode_referenced_messages(
    messages: DataFrame, columns: Sequence[str], referenced: str = "referenced"
) -> DataFrame:
    """The messages and the messages embedded in them; the embedded one comes first (``seq`` 0)."""
    own = messages.select(*columns, F.lit(1).alias("seq"))
    embedded = messages.where(F.col(referenced).isNotNull()).select(
        *[F.col(f"{referenced}.{c}").alias(c) for c in columns], F.lit(0).alias("seq")
    )
    return embedded.unionByName(own)


def explode_forum_tags(channels: DataFrame, tags: str = "available_tags") -> DataFrame:
    """Tag observations (channel_id, position, tag fields) of forum channels.

    (channel_id, id) of the result is the complete list that ``sync_deletions`` takes.
    """
    return channels.select(
        F.col("id").alias("channel_id"), "ts", F.posexplode(tags).alias("position", "tag")
    ).select("channel_id", "ts", "position", "tag.*")


GUILD_PARTS = {"role": "roles", "emoji": "emojis", "channel": "channels", "thread": "threads"}
# Threads and members are not listed completely, so their absence proves nothing.
LISTED_PARTS = ("role", "emoji", "channel")


def guild_parts(docs: DataFrame, payload: str = "payload", ts: str = "ts") -> DataFrame:
    """(part, guild_id, ts, id, payload) of the server documents and all their parts, parsed once."""
    schema = "id string, " + ", ".join(f"{c} array<string>" for c in GUILD_PARTS.values())
    parsed = docs.select(F.col(payload), F.col(ts).alias("ts"), F.from_json(payload, schema).alias("doc"))

    def rows(name: str, documents: Column) -> Column:
        return F.transform(
            F.coalesce(documents, F.array().cast("array<string>")), lambda d: F.struct(F.lit(name).alias("part"), d.alias("doc")))

    every = F.concat(
        rows("guild", F.array(payload)), *[rows(name, F.col(f"doc.{column}")) for name, column in GUILD_PARTS.items()])
    return parsed.select(F.col("doc.id").cast("long").alias("guild_id"), "ts", F.explode(every).alias("p")).select(
        F.col("p.part").alias("part"), "guild_id", "ts",
        F.get_json_object("p.doc", "$.id").cast("long").alias("id"), F.col("p.doc").alias(payload),
    )


def explode_guild(docs: DataFrame, payload: str = "payload", ts: str = "ts") -> dict[str, DataFrame]:
    """``guild_parts`` by part: guild, role, emoji, channel, thread (guild_id, ts, id, payload).

    ``listed`` gives (type, guild_id, id) for ``sync_deletions``, which is to run first. The parts are written once, so that
    what reads several of them doesn't parse the documents again.
    """
    parts = staged(guild_parts(docs, payload, ts), "guild-parts")
    found = {name: parts.where(F.col("part") == name).drop("part") for name in ("guild", *GUILD_PARTS)}
    found["listed"] = parts.where(F.col("part").isin(*LISTED_PARTS)).select(F.col("part").alias("type"), "guild_id", "id")
    return found


def member_user_observation(members: DataFrame, user: str = "user", ts: str = "ts") -> DataFrame:
    """The user inside each member row, seen at the same time but not live."""
    not_live = F.shiftleft(F.shiftright(F.col(ts), 1), 1)
    return members.select(F.col(f"{user}.*"), not_live.alias("ts"))
