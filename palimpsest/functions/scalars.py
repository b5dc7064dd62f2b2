"""Column expressions on ids, times, names, URLs, flags and emojis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archived service.
ID_EPOCH_MS = 1420070400000
ASSET_HOST = "https://cdn.discordapp.com"
SIGNED_URL_PREFIXES = (
    "https://cdn.discordapp.com/attachments/",
    "https://media.discordapp.net/attachments/",
)
STILL_IMAGE = ("webp", "size=4096")
ANIMATED_IMAGE = ("webp", "size=4096&animated=true")
EMOJI_PATTERN = r"<a?:[^:]*:\d+>"
DIRECT_TYPES = (1, 3)
GUILD_TYPES = (0, 2, 4, 5, 13, 15, 16)
THREAD_TYPES = (10, 11, 12)
TEXT_LIKE_TYPES = (0, 2, 5, 13, 15, 16)
THREADED_TYPES = (0, 5, 15, 16)
PRIVATE_THREAD = 12
FORWARD_BIT = 14
WEBHOOK_ID_BOUND = 1 << 32

ColumnOrName = Column | str
MS_PER_DAY = 86_400_000


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def snowflake_millis(id_: ColumnOrName) -> Column:
    return F.shiftright(col(id_), 22) + F.lit(ID_EPOCH_MS)


def snowflake_timestamp(id_: ColumnOrName) -> Column:
    """Creation time that a 64-bit id carries."""
    return F.timestamp_millis(snowflake_millis(id_))


def snowflake_from_millis(ms: ColumnOrName) -> Column:
    """Lowest id created at a time."""
    return F.shiftleft(col(ms) - F.lit(ID_EPOCH_MS), 22)


def ntz_millis(ts: ColumnOrName) -> Column:
    """Epoch ms of a zone-less timestamp, whatever the session time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts))


def encode_timing(ms: ColumnOrName, realtime: ColumnOrName) -> Column:
    """``ms << 1 | realtime``; 0 for an object as created (no time)."""
    packed = F.shiftleft(col(ms).cast("long"), 1).bitwiseOR(col(realtime).cast("long"))
    return F.coalesce(packed, F.lit(0).cast("long"))


def decode_timing(packed: ColumnOrName) -> Column:
    c = col(packed)
    return F.when(
        c != 0,
        F.struct(
            F.shiftright(c, 1).alias("timestamp_ms"),
            (c.bitwiseAND(F.lit(1).cast("long")) == 1).alias("realtime"),
        ),
    )


def time_bound(ms: int | ColumnOrName) -> Column:
    """Greatest packed time that still counts as "at ms"."""
    value = F.lit(ms) if isinstance(ms, int) else col(ms)
    return F.shiftleft(value.cast("long"), 1).bitwiseOR(F.lit(1).cast("long"))


def user_tag(name: ColumnOrName, discriminator: ColumnOrName) -> Column:
    d = col(discriminator)
    tag = F.concat(F.lit("@"), col(name))
    return F.when(d.isNull() | (d == "0"), tag).otherwise(F.concat(tag, F.lit("#"), d))


def normalize_discriminator(discriminator: ColumnOrName) -> Column:
    return F.nullif(col(discriminator), F.lit("0"))


def restore_discriminator(discriminator: ColumnOrName) -> Column:
    return F.coalesce(col(discriminator), F.lit("0"))


def normalize_media_url(url: ColumnOrName, prefixes: Sequence[str] = SIGNED_URL_PREFIXES) -> Column:
    """Drop the query of signed URLs, so that a fresh signature compares equal."""
    u = col(url)
    signed = F.lit(False)
    for prefix in prefixes:
        signed = signed | u.startswith(prefix)
    return F.when(signed, F.substring_index(u, "?", 1)).otherwise(u)


def extract_custom_emojis(text: ColumnOrName) -> Column:
    """Custom emoji marks of a text in order, as (animated, name, id)."""
    marks = F.regexp_extract_all(col(text), F.lit(EMOJI_PATTERN), 0)

    def parts(mark: Column) -> Column:
        fields = F.split(mark, ":")
        return F.struct(
            mark.startswith("<a:").alias("animated"),
            fields[1].alias("name"),
            F.rtrim(fields[2], F.lit(">")).alias("id"),
        )

    return F.transform(marks, parts)


def _with_options(path: Column, animated: Column, still: tuple[str, str], moving: tuple[str, str]) -> Column:
    def suffix(options: tuple[str, str]) -> Column:
        return F.lit(f".{options[0]}?{options[1]}")

    return F.concat(path, F.when(animated, suffix(moving)).otherwise(suffix(still)))


def hash_asset_url(
    prefix: ColumnOrName,
    hash_: ColumnOrName,
    still: tuple[str, str] = STILL_IMAGE,
    animated: tuple[str, str] | None = None,
    host: str = ASSET_HOST,
) -> Column:
    """URL of an image by its hash; a hash that begins with ``a_`` is animated."""
    path = F.concat(F.lit(host), col(prefix), F.lit("/"), col(hash_))
    return _with_options(path, col(hash_).startswith("a_"), still, animated or still)


def emoji_asset_url(
    id_: ColumnOrName,
    animated: ColumnOrName,
    still: tuple[str, str] = STILL_IMAGE,
    moving: tuple[str, str] = ANIMATED_IMAGE,
    host: str = ASSET_HOST,
) -> Column:
    path = F.concat(F.lit(f"{host}/emojis/"), col(id_).cast("string"))
    return _with_options(path, F.coalesce(col(animated), F.lit(False)), still, moving)


def parse_iso_millis(text: ColumnOrName) -> Column:
    """Epoch ms of an ISO 8601 text with zone; microseconds are cut."""
    return F.unix_millis(col(text).cast("timestamp"))


def format_iso_millis(ms: ColumnOrName) -> Column:
    """``2024-01-15T10:00:00.000Z``, by arithmetic so that no session time zone matters."""
    m = col(ms)
    day = F.floor(m / MS_PER_DAY).cast("int")
    rest = F.pmod(m, F.lit(MS_PER_DAY))
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"),
        F.format_string(
            "T%02d:%02d:%02d.%03dZ",
            F.floor(rest / 3_600_000),
            F.floor(rest / 60_000) % 60,
            F.floor(rest / 1000) % 60,
            rest % 1000,
        ),
    )


def strict_boolean(value: ColumnOrName) -> Column:
    return F.coalesce(col(value), F.lit(False))


def emoji_key(id_: ColumnOrName, name: ColumnOrName) -> Column:
    """One key for custom and Unicode emojis; the custom id wins."""
    custom = col(id_).isNotNull()
    return F.struct(
        F.when(custom, F.lit("custom")).otherwise(F.lit("unicode")).alias("kind"),
        F.when(custom, col(id_).cast("string")).otherwise(col(name)).alias("key"),
    )


def collapse_empty_struct(value: ColumnOrName, fields: Sequence[str], other_keys: ColumnOrName | None = None) -> Column:
    """NULL for a struct whose fields are all null or false and that has no other key."""
    c = col(value)
    empty = F.lit(True)
    for field in fields:
        empty = empty & F.coalesce(c[field].cast("string"), F.lit("false")).eqNullSafe("false")
    if other_keys is not None:
        empty = empty & (F.coalesce(F.size(col(other_keys)), F.lit(0)) <= 0)
    return F.when(c.isNotNull() & ~empty, c)


def author_kind(webhook_id: ColumnOrName, application_id: ColumnOrName) -> Column:
    own = col(webhook_id).eqNullSafe(col(application_id))
    return F.when(col(webhook_id).isNull() | own, "user").otherwise("webhook")


def stored_author_kind(author_id: ColumnOrName, bound: int = WEBHOOK_ID_BOUND) -> Column:
    """The same from a stored author id: ids below the bound are persona keys."""
    return F.when(col(author_id) < bound, "webhook").otherwise("user")


def channel_class(type_: ColumnOrName) -> Column:
    t = col(type_)
    return F.struct(
        F.when(t.isin(*DIRECT_TYPES), "direct")
        .when(t.isin(*GUILD_TYPES), "guild")
        .when(t.isin(*THREAD_TYPES), "thread")
        .otherwise("other")
        .alias("kind"),
        t.isin(*TEXT_LIKE_TYPES).alias("text_like"),
        t.isin(*THREADED_TYPES).alias("has_threads"),
    )


def flag_test(flags: ColumnOrName, bit: int) -> Column:
    return F.coalesce(col(flags).cast("long"), F.lit(0)).bitwiseAND(F.lit(1 << bit)) != 0


def reference_kind(flags: ColumnOrName) -> Column:
    return F.when(flag_test(flags, FORWARD_BIT), "forward").otherwise("default")


def content_key(content: ColumnOrName) -> Column:
    """Unpadded base64url of the SHA-256 digest."""
    return digest_key(F.sha2(col(content), 256))


def digest_key(hex_digest: ColumnOrName) -> Column:
    text = F.base64(F.unhex(col(hex_digest)))
    return F.rtrim(F.translate(text, "+/", "-_"), F.lit("="))


def url_path(url: ColumnOrName) -> Column:
    """Path of a URL without query and fragment."""
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base_name(path: ColumnOrName) -> Column:
    return F.substring_index(F.rtrim(col(path), F.lit("/")), "/", -1)


def link_name(url: ColumnOrName, key: ColumnOrName, letters: int | None = 4) -> Column:
    """Base name of the URL path, four characters of the content key (all with None), last extension."""
    name = base_name(url_path(url))
    mark = F.concat(F.lit("-"), col(key) if letters is None else F.substring(col(key), 1, letters))
    return F.when(
        F.locate(".", name) > 0,
        F.concat(
            F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), mark, F.lit("."),
            F.substring_index(name, ".", -1),
        ),
    ).otherwise(F.concat(name, mark))


def attachment_extension(filename: ColumnOrName) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.lower(F.regexp_extract(col(filename), r"\.([^.]*)$", 1))


def search_hit_line(
    *,
    user_id: ColumnOrName,
    username: ColumnOrName,
    discriminator: ColumnOrName,
    is_webhook: ColumnOrName,
    guild_id: ColumnOrName,
    guild_name: ColumnOrName,
    channel_id: ColumnOrName,
    channel_name: ColumnOrName,
    parent_name: ColumnOrName,
    message_id: ColumnOrName,
    timing: ColumnOrName,
    deleted: ColumnOrName,
    content: ColumnOrName,
) -> Column:
    """One text line for a search hit; a creation row shows the time its id carries."""
    def fallback(name: ColumnOrName, word: str, id_: ColumnOrName) -> Column:
        return F.coalesce(col(name), F.concat(F.lit(word + " "), col(id_).cast("string")))

    who = F.when(col(username).isNull(), F.concat(F.lit("user "), col(user_id).cast("string"))).otherwise(
        user_tag(username, discriminator)
    )
    channel = F.concat(F.lit("#"), fallback(channel_name, "channel", channel_id))
    where = F.when(col(parent_name).isNull(), channel).otherwise(
        F.concat(F.lit("thread "), fallback(channel_name, "channel", channel_id), F.lit(" of #"), col(parent_name))
    )
    at = F.when(col(timing) == 0, snowflake_millis(message_id)).otherwise(F.shiftright(col(timing), 1))
    gone = F.when(col(deleted).isNull(), F.lit("")).otherwise(
        F.concat(F.lit(" (deleted at "), format_iso_millis(F.shiftright(col(deleted), 1)), F.lit(")"))
    )
    return F.concat(
        who,
        F.when(col(is_webhook), F.lit(" (webhook)")).otherwise(F.lit("")),
        F.lit(" on "), fallback(guild_name, "guild", guild_id),
        F.lit(" in "), where,
        F.lit(" at "), format_iso_millis(at),
        gone,
        F.lit(": "), F.coalesce(col(content), F.lit("")),
    )
