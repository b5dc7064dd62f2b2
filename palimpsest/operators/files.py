"""Which files an archive needs, has, misses and holds twice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalars import (
    ANIMATED_IMAGE, ASSET_HOST, SIGNED_URL_PREFIXES, STILL_IMAGE, digest_key, emoji_asset_url,
    extract_custom_emojis, hash_asset_url, link_name, normalize_media_url,
)
from palimpsest.plans.ordered import oldest
from palimpsest.plans.spread import spread
from palimpsest.plans.staging import folder_names, staged

# Options that ask for a download. Fixed values of the archived service.
DOWNLOAD_OPTIONS = (
    "downloadAuthorAvatars", "downloadAttachments", "downloadEmbeddedImages",
    "downloadEmbeddedVideos", "downloadEmojisInMessages", "downloadEmojisInReactions",
    "downloadAllMemberAvatars", "downloadServerAssets", "downloadExpressions",
)
IMAGE_PARTS = (("footer", "icon_url", "proxy_icon_url"), ("image", "url", "proxy_url"),
               ("thumbnail", "url", "proxy_url"), ("author", "icon_url", "proxy_icon_url"))
VIDEO_PARTS = (("video", "url", "proxy_url"),)


def _file(url: Column, download: Column) -> Column:
    return F.struct(url.alias("url"), download.alias("download_url"))


def _asset(url: Column) -> Column:
    return _file(url, url)


def _option(options: Mapping[str, bool | str | Column], name: str) -> Column:
    value = options.get(name, False)
    if isinstance(value, str):
        value = F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def _message_files(
    message: Column, options: Mapping, prefixes: tuple[str, ...], host: str, media: Mapping
) -> Column:
    """Array of files of one message struct (content, attachments, embeds, author)."""
    def gated(name: str, files: Column) -> Column:
        return F.when(_option(options, name), files)

    def parts_of(embed: Column, parts) -> Column:
        return F.array(*[
            F.when(
                embed[part][url].isNotNull() & embed[part][proxy].isNotNull(),
                _file(normalize_media_url(embed[part][url], prefixes), embed[part][proxy]),
            )
            for part, url, proxy in parts
        ])

    emojis = F.transform(
        extract_custom_emojis(message["content"]),
        lambda e: _asset(emoji_asset_url(
            e["id"], e["animated"], media.get("usedEmoji", STILL_IMAGE),
            media.get("animatedUsedEmoji", ANIMATED_IMAGE), host,
        )),
    )
    attachments = F.transform(
        message["attachments"], lambda a: _file(normalize_media_url(a["url"], prefixes), a["url"])
    )
    images = F.flatten(F.transform(message["embeds"], lambda e: parts_of(e, IMAGE_PARTS)))
    videos = F.flatten(F.transform(message["embeds"], lambda e: parts_of(e, VIDEO_PARTS)))
    author = message["author"]
    avatar = hash_asset_url(
        F.concat(F.lit("/avatars/"), author["id"].cast("string")), author["avatar"],
        media.get("avatar", STILL_IMAGE), media.get("animatedAvatar", ANIMATED_IMAGE), host,
    )
    avatars = F.array(F.when(avatar.isNotNull(), _asset(avatar)))
    sources = [
        gated("downloadEmojisInMessages", emojis),
        gated("downloadAttachments", attachments),
        gated("downloadEmbeddedImages", images),
        gated("downloadEmbeddedVideos", videos),
        gated("downloadAuthorAvatars", avatars),
    ]
    none = F.array().cast("array<struct<url:string,download_url:string>>")
    return F.concat(*[F.coalesce(s, none) for s in sources])


def message_file_manifest(
    messages: DataFrame,
    options: Mapping[str, bool | str | Column],
    *,
    prefixes: tuple[str, ...] = SIGNED_URL_PREFIXES,
    host: str = ASSET_HOST,
    media: Mapping[str, tuple[str, str]] | None = None,
    forwarded: str = "message_snapshots",
) -> DataFrame:
    """(id, url, download_url) of every file of a message, also inside forwarded copies.

    Options are constants or boolean columns (joined from ``policy.resolve_options``). One narrow
    pass: no shuffle.
    """
    media = media or {}
    own = F.struct("content", "attachments", "embeds", "author")
    files = _message_files(own, options, prefixes, host, media)
    if forwarded in messages.columns:
        inner = F.flatten(F.transform(
            F.col(forwarded), lambda m: _message_files(m, options, prefixes, host, media)
        ))
        files = F.concat(files, F.coalesce(inner, F.array().cast("array<struct<url:string,download_url:string>>")))
    return (
        spread(messages).select("id", F.explode(files).alias("file"))
        .where(F.col("file").isNotNull())
        .select("id", "file.url", "file.download_url")
    )


def _explode_assets(df: DataFrame, key: list[str], urls: list[Column]) -> DataFrame:
    return df.select(*key, F.explode(F.array_compact(F.array(*urls))).alias("url")).withColumn(
        "download_url", F.col("url")
    )


def member_file_manifest(
    members: DataFrame, host: str = ASSET_HOST, media: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Avatar, server avatar and server banner of each member row.

    ``members``: guild_id, user_id, user_avatar, avatar, banner. Banners use the still options.
    """
    media = media or {}
    still = media.get("avatar", STILL_IMAGE)
    moving = media.get("animatedAvatar", ANIMATED_IMAGE)
    banner = media.get("userBanner", STILL_IMAGE)
    user = F.col("user_id").cast("string")
    base = F.concat(F.lit("/guilds/"), F.col("guild_id").cast("string"), F.lit("/users/"), user)
    return _explode_assets(members, ["guild_id", "user_id"], [
        hash_asset_url(F.concat(F.lit("/avatars/"), user), "user_avatar", still, moving, host),
        hash_asset_url(F.concat(base, F.lit("/avatars")), "avatar", still, moving, host),
        hash_asset_url(F.concat(base, F.lit("/banners")), "banner", banner, banner, host),
    ])


def server_file_manifest(
    guilds: DataFrame,
    emojis: DataFrame,
    host: str = ASSET_HOST,
    media: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Icon, splash, discovery splash, banner of each server, and its emoji images."""
    media = media or {}

    def url(folder: str, column: str, still: str, moving: str | None = None) -> Column:
        prefix = F.concat(F.lit(f"/{folder}/"), F.col("id").cast("string"))
        animated = None if moving is None else media.get(moving, ANIMATED_IMAGE)
        return hash_asset_url(prefix, column, media.get(still, STILL_IMAGE), animated, host)

    assets = _explode_assets(guilds, ["id"], [
        url("icons", "icon", "serverIcon", "animatedServerIcon"),
        url("splashes", "splash", "serverSplash"),
        url("discovery-splashes", "discovery_splash", "serverDiscoverySplash"),
        url("banners", "banner", "serverBanner", "animatedServerBanner"),
    ]).withColumnRenamed("id", "guild_id")
    images = emojis.select("guild_id", emoji_asset_url(
        "id", "animated", media.get("serverEmoji", STILL_IMAGE),
        media.get("animatedServerEmoji", ANIMATED_IMAGE), host,
    ).alias("url")).withColumn("download_url", F.col("url"))
    return assets.unionByName(images)


def reaction_emoji_manifest(
    reactions: DataFrame, host: str = ASSET_HOST, media: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Images of the custom emojis used in reactions."""
    media = media or {}
    custom = reactions.where(F.col("emoji_id").isNotNull()).select("emoji_id", "animated").distinct()
    return custom.select(emoji_asset_url(
        "emoji_id", "animated", media.get("usedEmoji", STILL_IMAGE),
        media.get("animatedUsedEmoji", ANIMATED_IMAGE), host,
    ).alias("url")).withColumn("download_url", F.col("url"))


def pending_files(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per wanted URL that has no result yet; a stored error is a result.

    Any of the download URLs of one URL would do; the smallest makes the choice repeatable.
    """
    wanted = manifest.groupBy("url").agg(F.min("download_url").alias("download_url"))
    return wanted.join(registry.select("url"), "url", "left_anti")


def dedupe_content(files: DataFrame, content: str = "content", url: str = "url") -> DataFrame:
    """(hash, n, first_url, bytes_saved): the first URL keeps the bytes, the others repeat them."""
    # Only digest and length are shuffled, never the content.
    digests = files.select(
        F.sha2(F.col(content), 256).alias("hash"), F.octet_length(content).cast("long").alias("size"),
        F.col(url).alias("url"),
    )
    return digests.groupBy("hash").agg(
        F.count("*").alias("n"),
        F.min("url").alias("first_url"),
        (F.sum("size") - F.max("size")).alias("bytes_saved"),
    )


def register_files(registry: DataFrame, results: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows to add, rejected rows): the first result of a URL wins, hash or error but not both."""
    valid = F.col("hash").isNull() != F.col("error_code").isNull()
    good = results.where(valid)
    added = oldest(good, ["url"], [order]).join(registry.select("url"), "url", "left_anti")
    return added.select("url", "hash", "error_code"), results.where(~valid)


def store_consistency(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """(hash, problem): registered but not stored, or stored but not registered."""
    known = registry.where(F.col("hash").isNotNull()).select("hash").distinct()
    stored = listing.select("hash").distinct()
    return (
        known.withColumn("_known", F.lit(True))
        .join(stored.withColumn("_stored", F.lit(True)), "hash", "full_outer")
        .where(F.col("_known").isNull() | F.col("_stored").isNull())
        .select("hash", F.when(F.col("_stored").isNull(), "missing").otherwise("extra").alias("problem"))
    )


# Rows of a listing that go to Spark at once.
LISTED_ROWS = 100_000
# Files of a store lie in folders named by so many first digits of their hash.
STORE_DIGITS = 2


def store_files(files: DataFrame, path: str, hash_: str = "hash", content: str = "content", digits: int = STORE_DIGITS) -> DataFrame:
    """Write each content under its hash into a store; gives (hash, size) of what was written.

    A file gets its name once it is whole, and equal contents have equal names, so lost and repeated tasks do no harm. Rows
    without hash or content are no files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                folder, part = f"{root}/{name.as_py()[:digits]}", f"{root}/pending/{uuid.uuid4().hex}"
                for needed in (folder, f"{root}/pending"):
                    place.create_dir(needed)
                with place.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                place.move(part, f"{folder}/{name.as_py()}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(batch.column(1)), pa.int64())], ["hash", "size"])

    rows = files.select(F.col(hash_).alias("hash"), F.col(content).cast("binary").alias("content")).dropna()
    return staged(rows.mapInArrow(write, "hash string, size long"), "stored-files")


def store_listing(spark: SparkSession, path: str, digits: int = STORE_DIGITS) -> DataFrame:
    """(hash, size) of the files of a store by their names; the content is not read.

    The driver sees the names of the folders; a task lists one of them. What is not where its name belongs, unfinished
    files too, is named by its place in the store.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pyarrow.fs.FileSystem.from_uri(path)
        for folder in (f.as_py() for batch in batches for f in batch.column(0)):
            found = place.get_file_info(f"{root}/{folder}")
            inside = [found] if found.is_file else [
                f for f in place.get_file_info(pyarrow.fs.FileSelector(found.path, recursive=True)) if f.is_file]
            for at in range(0, len(inside), LISTED_ROWS):
                part = inside[at : at + LISTED_ROWS]
                names = [f.base_name if f.path.endswith(f"/{f.base_name[:digits]}/{f.base_name}") else f"{folder}/{f.base_name}"
                         for f in part]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f.size for f in part], pa.int64())],
                                                 ["hash", "size"])

    # Sums that the file system keeps beside its files are hidden.
    folders = [n for n in folder_names(spark, path) if not n.startswith(".")]
    if not folders:
        return spark.createDataFrame([], "hash string, size long")
    dealt = spark.createDataFrame([(n,) for n in folders], "folder string").repartition(len(folders), "folder")
    return dealt.mapInArrow(listed, "hash string, size long")


def classify_pending(pending: DataFrame, registry: DataFrame) -> DataFrame:
    """Pending files with ``keep``: does the registry use their hash?"""
    used = registry.where(F.col("hash").isNotNull()).select("hash", F.lit(True).alias("keep")).distinct()
    return pending.join(used, "hash", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def file_links(registry: DataFrame, hex_hash: str = "hash") -> DataFrame:
    """(name, url, key) of every stored file; names of different contents differ.

    The name holds four characters of the key. Of several contents with one name that of the first URL keeps it; the others
    take their whole key into the name. The first one is combined before the shuffle, so a name that many files have costs
    one row of each task, and Spark splits it in the join.
    """
    named = registry.where(F.col("error_code").isNull()).select(
        "url", digest_key(hex_hash).alias("key")
    ).withColumn("_short", link_name("url", "key"))
    winners = named.groupBy("_short").agg(F.min(F.struct("url", "key")).alias("_winner")).select(
        "_short", F.col("_winner.key").alias("_first"))
    keeps = F.col("key") == F.col("_first")
    return named.join(winners, "_short").select(
        F.when(keeps, F.col("_short")).otherwise(link_name("url", "key", None)).alias("name"), "url", "key"
    )


def file_stats(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: files and bytes, and how many of them are unique or repeat others."""
    by_hash = files.select(
        F.sha2(F.col(content), 256).alias("hash"), F.octet_length(content).cast("long").alias("size")
    ).groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return by_hash.agg(
        F.sum("n").alias("files"),
        F.sum(F.col("n") * F.col("size")).alias("bytes"),
        F.count("*").alias("unique_files"),
        F.sum("size").alias("unique_bytes"),
        F.sum(F.col("n") - 1).alias("duplicate_files"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("duplicate_bytes"),
    )
