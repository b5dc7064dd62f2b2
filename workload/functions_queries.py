"""P: scalar functions, and S: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import documents as D
from palimpsest.functions import scalars as P
from palimpsest.operators.capture import compact_snapshots
from palimpsest.plans.ordered import newest
from palimpsest.plans.spread import spread
from palimpsest.plans.staging import staged, work_dir
from palimpsest.sources import archive, landing
from palimpsest.streaming.append import start_append
from workload.registry import query
from workload.stand_ins import KEPT_SQL, iso_of, ms_of, obs


@query("S1_read_payloads", """
SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS label, o_orderkey + 7 AS received_at FROM orders
UNION ALL
SELECT 'turn', conv_id * 1000 + turn, role, conv_id FROM conversations""")
def _(t):
    orders = t.orders.select(
        (F.col("o_orderkey") + 7).alias("received_at"), F.lit("order").alias("kind"),
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))).alias("payload"),
    )
    turns = t.conversations.select(
        F.col("conv_id").alias("received_at"), F.lit("turn").alias("kind"),
        F.to_json(F.array(F.struct(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label"), "text",
        ))).alias("payload"),
    )
    path = work_dir(t.spark, "landing")
    landing.write_payloads(orders.unionByName(turns), path)
    back = landing.read_payloads(t.spark, path)
    return back.select(
        "kind", F.get_json_object("payload", "$.id").cast("long").alias("id"),
        F.get_json_object("payload", "$.label").alias("label"), "received_at",
    )


@query("S2_read_dispatches", f"""
SELECT upper(event_type) AS t, event_id AS seq, {ms_of('ts')} AS received_at,
       event_type IN ('view', 'click') AS realtime, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""")
def _(t):
    path = work_dir(t.spark, "dispatches")
    events = t.events.select(
        F.upper("event_type").alias("t"),
        F.to_json(F.struct("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("d"),
        F.col("event_id").alias("seq"), P.ntz_millis("ts").alias("received_at"),
        F.col("event_type").isin("view", "click").alias("realtime"),
    )
    landing.write_dispatches(events, f"{path}/in")
    stream = landing.read_dispatches(t.spark, f"{path}/in")
    start_append(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    back = t.spark.read.parquet(f"{path}/out")
    return back.select(
        "t", "seq", "received_at", "realtime",
        F.get_json_object("d", "$.user_id").cast("long").alias("user_id"),
        F.get_json_object("d", "$.k").cast("long").alias("k"),
    )


@query("S3_write_archive", f"""WITH {KEPT_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS back FROM kept)
SELECT CASE WHEN back = 1 THEN 'current' ELSE 'previous' END AS part, id, ts, kind, lvl FROM ranked""")
def _(t):
    kept = staged(compact_snapshots(obs(t), ["id"], ["kind", "lvl"]).select("id", "ts", "kind", "lvl"), "history")
    current = newest(kept, ["id"], ["ts"])
    heads = current.select("id", F.col("ts").alias("head"))
    previous = kept.join(heads, "id").where("ts < head").drop("head")
    path = work_dir(t.spark, "archive")
    archive.write_archive({"current": (current, "id", ["id"]), "previous": (previous, "id", ["id", "ts"])}, path, buckets=8)
    parts = [
        archive.read_latest(t.spark, path, name).select(F.lit(name).alias("part"), "id", "ts", "kind", "lvl")
        for name in ("current", "previous")
    ]
    return parts[0].unionByName(parts[1])


@query("S4_read_latest", "SELECT page_id, url, length(html) AS size FROM pages")
def _(t):
    path = work_dir(t.spark, "archive")
    pages = t.pages.withColumn("size", F.length("html").cast("long"))
    archive.write_archive({"files": (pages, "page_id", ["page_id"])}, path, buckets=8)
    return archive.read_latest(t.spark, path, "files", ["page_id", "url", "size"])


@query("S5_read_children", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def _(t):
    path = work_dir(t.spark, "archive")
    members = t.customer.select("c_custkey", "c_name", "c_nationkey")
    archive.write_archive({"members": (members, "c_nationkey", ["c_custkey"])}, path, buckets=8)
    return archive.read_children(t.spark, path, "members", 7).select("c_custkey", "c_name", "c_nationkey")


EXPORT_SPEC = (
    D.Leaf("id", "id"), D.Leaf("kind", "string"), D.Leaf("note", "string", D.ABSENT),
    D.Leaf("nick", "string", D.NULL), D.Leaf("roles", "ids", D.EMPTY_ARRAY),
    D.Leaf("seen", "timestamp"),
    D.Group("metrics", (D.Leaf("lvl", "integer"), D.Leaf("odd", "boolean", D.NULL)), D.ABSENT),
)


@query("S6_export_documents", f"""
SELECT event_id AS id,
  '{{"id":"' || event_id || '","k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '",'
  || CASE WHEN event_type = 'error' THEN '' ELSE
       '"metrics":{{"lvl":' || user_id || ',"odd":' ||
       CASE WHEN event_type = 'view' THEN 'null' WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || '}},' END
  || '"nick":' || CASE WHEN event_type = 'click' THEN 'null' ELSE '"u' || user_id || '"' END || ','
  || CASE WHEN event_type = 'signup' THEN '"note":"new",' ELSE '' END
  || '"roles":' || CASE WHEN event_type = 'purchase' THEN '[]' ELSE '["' || user_id || '"]' END || ','
  || '"seen":"' || {iso_of(ms_of('ts'))} || '"}}' AS json
FROM events""")
def _(t):
    kind = F.col("event_type")
    flat = t.events.select(
        F.col("event_id").alias("id"), kind.alias("kind"),
        F.when(kind == "signup", "new").alias("note"),
        F.when(kind != "click", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("nick"),
        F.when(kind != "purchase", F.array("user_id")).alias("roles"),
        P.ntz_millis("ts").alias("seen"),
        F.when(kind != "error", F.col("user_id")).alias("metrics__lvl"),
        F.when(~kind.isin("error", "view"), F.col("event_id") % 2 == 1).alias("metrics__odd"),
        F.col("props").alias("_extra"),
    )
    return D.export_documents(flat, EXPORT_SPEC)


@query("P1_snowflake_timestamp", """
SELECT o_orderkey, o_orderkey + 1420070400000 AS created_ms FROM orders""")
def _(t):
    created = P.snowflake_timestamp(F.shiftleft("o_orderkey", 22))
    return t.orders.select("o_orderkey", F.unix_millis(created).alias("created_ms"))


@query("P2_encode_timing", f"""
SELECT event_id, CASE WHEN event_type = 'signup' THEN 0
  ELSE {ms_of('ts')} * 2 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END END AS packed FROM events""")
def _(t):
    ms = F.when(F.col("event_type") != "signup", P.ntz_millis("ts"))
    return t.events.select("event_id", P.encode_timing(ms, F.col("event_type") == "click").alias("packed"))


@query("P3_decode_timing", f"""
SELECT event_id, CASE WHEN event_type <> 'signup' THEN {ms_of('ts')} END AS timestamp_ms,
  CASE WHEN event_type <> 'signup' THEN event_type = 'click' END AS realtime FROM events""")
def _(t):
    ms = F.when(F.col("event_type") != "signup", P.ntz_millis("ts"))
    packed = P.encode_timing(ms, F.col("event_type") == "click")
    return t.events.select("event_id", P.decode_timing(packed).alias("t")).select("event_id", "t.*")


DISCRIMINATOR = """CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_nationkey = 0 THEN '0'
  ELSE lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END"""


def discriminator():
    return F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).when(F.col("c_nationkey") == 0, "0").otherwise(
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0")
    )


@query("P4_user_tag", f"""
SELECT c_custkey, CASE WHEN d IS NULL OR d = '0' THEN '@' || c_name ELSE '@' || c_name || '#' || d END AS tag
FROM (SELECT *, {DISCRIMINATOR} AS d FROM customer)""")
def _(t):
    return t.customer.select("c_custkey", P.user_tag("c_name", discriminator()).alias("tag"))


@query("P5_normalize_discriminator", f"""
SELECT c_custkey, nullif(d, '0') AS stored, coalesce(nullif(d, '0'), '0') AS restored
FROM (SELECT *, {DISCRIMINATOR} AS d FROM customer)""")
def _(t):
    stored = P.normalize_discriminator(discriminator())
    return t.customer.select("c_custkey", stored.alias("stored"), P.restore_discriminator(stored).alias("restored"))


@query("P6_normalize_media_url", """
SELECT page_id, CASE WHEN url LIKE 'https://%' THEN split_part(url, '?', 1) ELSE url END AS url FROM pages""")
def _(t):
    return t.pages.select("page_id", P.normalize_media_url("url", ["https://"]).alias("url"))


EMOJI_TEXT = """(text || CASE WHEN lang = 'en' THEN '<a:x:' || doc_id || '>' ELSE '' END
  || CASE WHEN n_chars > 500 THEN ' <:y_z:' || (doc_id + 5) || '>' ELSE '' END)"""


def emoji_text():
    def mark(kind, id_):
        return F.concat(F.lit(kind), id_.cast("string"), F.lit(">"))

    return F.concat(
        "text",
        F.when(F.col("lang") == "en", mark("<a:x:", F.col("doc_id"))).otherwise(""),
        F.when(F.col("n_chars") > 500, mark(" <:y_z:", F.col("doc_id") + 5)).otherwise(""),
    )


@query("P7_extract_custom_emojis", f"""
SELECT doc_id, array_to_string(regexp_extract_all(c, '<(a?):([^:]*):(\\d+)>', 1), ',') AS animated,
  array_to_string(regexp_extract_all(c, '<(a?):([^:]*):(\\d+)>', 2), ',') AS names,
  array_to_string(regexp_extract_all(c, '<(a?):([^:]*):(\\d+)>', 3), ',') AS ids
FROM (SELECT doc_id, {EMOJI_TEXT} AS c FROM documents)""")
def _(t):
    found = t.documents.select("doc_id", P.extract_custom_emojis(emoji_text()).alias("e"))
    return found.select(
        "doc_id",
        F.array_join(F.transform("e", lambda e: F.when(e["animated"], "a").otherwise("")), ",").alias("animated"),
        F.array_join(F.transform("e", lambda e: e["name"]), ",").alias("names"),
        F.array_join(F.transform("e", lambda e: e["id"]), ",").alias("ids"),
    )


@query("P8_hash_asset_url", """
SELECT page_id, 'https://cdn.discordapp.com/icons/' || page_id || '/' || h || '.webp?size=4096' ||
  CASE WHEN h LIKE 'a\\_%' ESCAPE '\\' THEN '&animated=true' ELSE '' END AS asset
FROM (SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'a_' ELSE '' END || sha256(html) AS h FROM pages)""")
def _(t):
    hash_ = F.concat(F.when(F.col("url").startswith("https://"), "a_").otherwise(""), F.sha2("html", 256))
    prefix = F.concat(F.lit("/icons/"), F.col("page_id").cast("string"))
    return t.pages.select("page_id", P.hash_asset_url(prefix, hash_, P.STILL_IMAGE, P.ANIMATED_IMAGE).alias("asset"))


@query("P9_emoji_asset_url", """
SELECT p_partkey, 'https://cdn.discordapp.com/emojis/' || p_partkey || '.webp?size=4096' ||
  CASE WHEN p_size > 25 THEN '&animated=true' ELSE '' END AS asset FROM part""")
def _(t):
    return t.part.select("p_partkey", P.emoji_asset_url("p_partkey", F.col("p_size") > 25).alias("asset"))


FLATTEN_SPEC = (
    D.Leaf("id", "id"), D.Leaf("status", "string"), D.Leaf("bot", "strict_boolean"),
    D.Leaf("nick", "string", D.NULL), D.Leaf("roles", "ids", D.EMPTY_ARRAY), D.Leaf("created", "timestamp"),
    D.Group("meta", (
        D.Leaf("priority", "string"), D.Leaf("size", "integer"),
        D.Group("inner", (D.Leaf("flag", "strict_boolean"),), D.ABSENT),
    ), D.ABSENT),
    D.Ignored("secret"),
)


def order_documents(t):
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    inner = F.when(status == "F", F.struct(F.when(urgent, True).alias("flag"), F.lit(1).alias("depth")))
    return t.orders.select(
        "o_orderkey", "o_orderstatus",
        F.to_json(F.struct(
            F.col("o_orderkey").cast("string").alias("id"), status.alias("status"),
            F.when(status == "P", True).alias("bot"),
            F.when(urgent, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("nick"),
            F.when(status == "O", F.array()).otherwise(F.array(F.col("o_custkey").cast("string"))).alias("roles"),
            F.concat(P.format_iso_millis(P.ntz_millis("o_orderdate")).substr(1, 23), F.lit("+00:00")).alias("created"),
            F.when(~urgent, F.struct(
                F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("size"),
                inner.alias("inner"), F.col("o_custkey").alias("unknown_below"),
            )).alias("meta"),
            F.lit("x").alias("secret"), F.col("o_custkey").alias("unknown"),
        )).alias("payload"),
    )


@query("P10_flatten_object", f"""
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus = 'P' AS bot,
  CASE WHEN NOT u THEN o_orderpriority END AS nick,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey AS VARCHAR) END AS roles,
  {ms_of('o_orderdate')} AS created,
  CASE WHEN NOT u THEN o_orderpriority END AS meta__priority,
  CASE WHEN NOT u THEN o_custkey END AS meta__size,
  CASE WHEN NOT u AND o_orderstatus = 'F' THEN false END AS meta__inner__flag
FROM (SELECT *, o_orderpriority = '1-URGENT' AS u FROM orders)""")
def _(t):
    flat = D.flatten_object(order_documents(t), "payload", FLATTEN_SPEC)
    return flat.withColumn("roles", F.when(F.col("roles").isNotNull(), F.array_join("roles", ",")))


@query("P11_residual_json", """
SELECT o_orderkey,
  '{' || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE '"meta":{' ||
    CASE WHEN o_orderstatus = 'F' THEN '"inner":{"depth":1},' ELSE '' END ||
    '"unknown_below":' || o_custkey || '},' END || '"unknown":' || o_custkey || '}' AS residual
FROM orders""")
def _(t):
    return spread(order_documents(t)).select("o_orderkey", D.residual_json("payload", FLATTEN_SPEC).alias("residual"))


@query("P12_canonical_json", """
SELECT event_id, true AS same, '{"a":null,"b":{"x":1,"y":[2,1]},"k":' || json_extract_string(props, '$.k') || '}' AS canonical
FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"k": '), k, F.lit(', "b": {"y": [2, 1], "x": 1}, "a": null}'))
    other = F.concat(F.lit('{"a":null,"b":{"x":1,"y":[2,1]},"k":'), k, F.lit("}"))
    return t.events.select(
        "event_id", D.canonical_json(one).eqNullSafe(D.canonical_json(other)).alias("same"),
        D.canonical_json(one).alias("canonical"),
    )


@query("P13_parse_iso_millis", f"""
SELECT event_id, {ms_of('ts')} AS ms, {iso_of(ms_of('ts'))} AS iso FROM events""")
def _(t):
    text = F.concat(F.translate(F.col("ts").cast("string"), " ", "T"), F.lit("+00:00"))
    ms = P.parse_iso_millis(text)
    return t.events.select("event_id", ms.alias("ms"), P.format_iso_millis(ms).alias("iso"))


@query("P14_strict_boolean", """
SELECT d.doc_id, coalesce(l.toxic = 1, false) AS strict, l.toxic = 1 AS plain
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    both = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    toxic = F.col("toxic") == 1
    return both.select("doc_id", P.strict_boolean(toxic).alias("strict"), toxic.alias("plain"))


@query("P15_emoji_key", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'custom' ELSE 'unicode' END AS kind,
  CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS key FROM part""")
def _(t):
    id_ = F.when(F.col("p_size") > 25, F.col("p_partkey"))
    return t.part.select("p_partkey", P.emoji_key(id_, F.col("p_name")).alias("e")).select("p_partkey", "e.*")


@query("P16_collapse_empty_struct", """
SELECT c_custkey, CASE WHEN e THEN NULL ELSE tag END AS tag, e AS collapsed FROM (
  SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS tag,
    c_mktsegment <> 'BUILDING' AND NOT (c_nationkey = 3) AND c_acctbal >= 0 AS e FROM customer)""")
def _(t):
    profile = F.struct(
        F.lit(None).cast("long").alias("identity_guild_id"),
        F.when(F.col("c_nationkey") == 3, True).when(F.col("c_nationkey") > 10, False).alias("identity_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("tag"),
        F.lit(None).cast("string").alias("badge"),
    )
    other = F.when(F.col("c_acctbal") < 0, F.array(F.lit("new_key"))).otherwise(F.array().cast("array<string>"))
    fields = ["identity_guild_id", "identity_enabled", "tag", "badge"]
    kept = t.customer.select("c_custkey", profile.alias("p"), other.alias("other")).select(
        "c_custkey", P.collapse_empty_struct("p", fields, "other").alias("p")
    )
    return kept.select("c_custkey", F.col("p.tag").alias("tag"), F.col("p").isNull().alias("collapsed"))


@query("P17_author_kind", """
SELECT conv_id, turn, CASE WHEN w IS NULL OR w = conv_id THEN 'user' ELSE 'webhook' END AS kind,
  CASE WHEN turn < 4294967296 AND conv_id % 2 = 0 THEN 'webhook' ELSE 'user' END AS stored
FROM (SELECT *, CASE role WHEN 'assistant' THEN conv_id WHEN 'system' THEN turn + 1000000 END AS w FROM conversations)""")
def _(t):
    webhook = F.when(F.col("role") == "assistant", F.col("conv_id")).when(
        F.col("role") == "system", F.col("turn") + 1_000_000
    )
    stored = F.when(F.col("conv_id") % 2 == 0, F.col("turn")).otherwise(F.col("turn") + (1 << 32))
    return t.conversations.select(
        "conv_id", "turn", P.author_kind(webhook, F.col("conv_id")).alias("kind"),
        P.stored_author_kind(stored).alias("stored"),
    )


@query("P18_channel_class", """
SELECT p_partkey, CASE WHEN p_size IN (1, 3) THEN 'direct' WHEN p_size IN (0, 2, 4, 5, 13, 15, 16) THEN 'guild'
  WHEN p_size IN (10, 11, 12) THEN 'thread' ELSE 'other' END AS kind,
  p_size IN (0, 2, 5, 13, 15, 16) AS text_like, p_size IN (0, 5, 15, 16) AS has_threads FROM part""")
def _(t):
    return t.part.select("p_partkey", P.channel_class("p_size").alias("c")).select("p_partkey", "c.*")


@query("P19_flag_test", """
SELECT l_orderkey, l_linenumber, (l_linenumber & 4) <> 0 AS bit_2,
  CASE WHEN l_linestatus = 'F' THEN 'forward' ELSE 'default' END AS reference FROM lineitem""")
def _(t):
    flags = F.col("l_linenumber") + F.when(F.col("l_linestatus") == "F", 1 << 14).otherwise(0)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", P.flag_test("l_linenumber", 2).alias("bit_2"),
        P.reference_kind(flags).alias("reference"),
    )


CONTENT_KEY = "rtrim(translate(to_base64(unhex(sha256(html))), '+/', '-_'), '=')"


@query("P20_content_key", f"SELECT page_id, {CONTENT_KEY} AS key FROM pages")
def _(t):
    return t.pages.select("page_id", P.content_key("html").alias("key"))


NAMED_PAGES = f"""(SELECT page_id, key, regexp_extract(path, '([^/]*)/*$', 1) AS name FROM (
  SELECT page_id, {CONTENT_KEY} AS key,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) ||
      CASE WHEN page_id % 2 = 0 THEN '.tar.gz' ELSE '' END AS path FROM pages))"""


def page_file_url():
    """Page URLs, half of them with a file name that has extensions."""
    path = F.regexp_extract("url", "^[^?#]*", 0)
    rest = F.regexp_extract("url", "^[^?#]*(.*)$", 1)
    return F.concat(path, F.when(F.col("page_id") % 2 == 0, ".tar.gz").otherwise(""), rest)


@query("P21_link_name", f"""
SELECT page_id, CASE WHEN contains(name, '.') THEN
    regexp_extract(name, '^(.*)\\.([^.]*)$', 1) || '-' || substr(key, 1, 4) || '.' || regexp_extract(name, '^(.*)\\.([^.]*)$', 2)
  ELSE name || '-' || substr(key, 1, 4) END AS name FROM {NAMED_PAGES}""")
def _(t):
    return t.pages.select("page_id", P.link_name(page_file_url(), P.content_key("html")).alias("name"))


@query("P22_attachment_extension", f"""
SELECT page_id, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS extension FROM {NAMED_PAGES}""")
def _(t):
    name = P.base_name(P.url_path(page_file_url()))
    return t.pages.select("page_id", P.attachment_extension(name).alias("extension"))


@query("P23_search_hit_line", f"""
SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'user ' || c_custkey ELSE '@' || c_name || '#7' END ||
  CASE WHEN o_orderstatus = 'F' THEN ' (webhook)' ELSE '' END || ' on ' ||
  CASE WHEN n_regionkey = 2 THEN 'guild 2' ELSE r_name END || ' in ' ||
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'thread ' || n_name || ' of #' || c_mktsegment ELSE '#' || n_name END ||
  ' at ' || {iso_of(ms_of('o_orderdate'))} ||
  CASE WHEN o_orderstatus = 'P' THEN ' (deleted at ' || {iso_of(ms_of('o_orderdate') + ' + 1000')} || ')' ELSE '' END
  || ': ' || o_orderpriority AS line
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    rows = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    ms = P.ntz_millis("o_orderdate")
    # Creation rows show the time of the id, edited ones their own.
    created = F.col("o_orderstatus") == "O"
    line = P.search_hit_line(
        user_id="c_custkey",
        username=F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")),
        discriminator=F.lit("7"),
        is_webhook=F.col("o_orderstatus") == "F",
        guild_id="n_regionkey",
        guild_name=F.when(F.col("n_regionkey") != 2, F.col("r_name")),
        channel_id="n_nationkey", channel_name="n_name",
        parent_name=F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment")),
        message_id=P.snowflake_from_millis(ms),
        timing=F.when(created, 0).otherwise(P.encode_timing(ms, F.lit(True))),
        deleted=F.when(F.col("o_orderstatus") == "P", P.encode_timing(ms + 1000, F.lit(False))),
        content="o_orderpriority",
    )
    return rows.select("o_orderkey", line.alias("line"))
