"""M: files."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import files as M
from palimpsest.plans.staging import work_dir
from workload.functions_queries import EMOJI_TEXT, NAMED_PAGES, emoji_text, page_file_url
from workload.registry import query

HOST = "'https://cdn.discordapp.com"
EMOJI_MARK = r"'<a?:[^:]*:(\d+)>'"


@query("M1_message_file_manifest", f"""WITH m AS (
  SELECT page_id AS id, url, {EMOJI_TEXT} AS content, lang, doc_id,
    CASE WHEN url LIKE 'https://%' THEN split_part(url, '?', 1) ELSE url END AS bare, url || '&p=1' AS proxy
  FROM pages JOIN documents ON doc_id = page_id),
e AS (SELECT id, unnest(regexp_extract_all(content, {EMOJI_MARK}, 1)) AS e,
  unnest(regexp_extract_all(content, '<(a?):[^:]*:\\d+>', 1)) AS a FROM m),
emoji AS (SELECT id, {HOST}/emojis/' || e || '.webp?size=4096' || CASE WHEN a = 'a' THEN '&animated=true' ELSE '' END AS u FROM e)
SELECT id, u AS url, u AS download_url FROM emoji
UNION ALL SELECT id, bare, url FROM m
UNION ALL SELECT id, bare, proxy FROM m WHERE lang <> 'de'
UNION ALL SELECT id, bare, proxy FROM m WHERE lang = 'fr'
UNION ALL SELECT id, bare, url FROM m WHERE lang = 'es'
UNION ALL SELECT id, u, u FROM (SELECT id, {HOST}/avatars/' || id || '/a_' || doc_id || '.webp?size=4096&animated=true' AS u FROM m)""")
def _(t):
    pages = t.pages.join(t.documents, F.col("doc_id") == F.col("page_id"))
    media = F.struct("url", F.concat("url", F.lit("&p=1")).alias("proxy_url"))
    half = F.struct("url", F.lit(None).cast("string").alias("proxy_url"))
    icon = F.struct(media["url"].alias("icon_url"), media["proxy_url"].alias("proxy_icon_url"))
    embed = F.struct(
        F.when(F.col("lang") == "none", icon).alias("footer"),
        F.when(F.col("lang") != "de", media).otherwise(half).alias("image"),
        F.when(F.col("lang") == "none", media).alias("thumbnail"),
        F.when(F.col("lang") == "none", media).alias("video"),
        F.when(F.col("lang") == "fr", icon).alias("author"),
    )
    files = F.array(F.struct("url"))
    none = F.lit(None).cast("struct<id:bigint,avatar:string>")
    author = F.struct(F.col("page_id").alias("id"), F.concat(F.lit("a_"), F.col("doc_id").cast("string")).alias("avatar"))
    forwarded = F.struct(
        F.lit(None).cast("string").alias("content"), files.alias("attachments"),
        F.array().cast("array<" + pages.select(embed.alias("e")).schema["e"].dataType.simpleString() + ">").alias("embeds"),
        none.alias("author"),
    )
    messages = pages.select(
        F.col("page_id").alias("id"), emoji_text().alias("content"), files.alias("attachments"),
        F.array(embed).alias("embeds"), author.alias("author"),
        F.when(F.col("lang") == "es", F.array(forwarded)).alias("message_snapshots"),
    )
    options = dict.fromkeys(M.DOWNLOAD_OPTIONS, True)
    return M.message_file_manifest(messages, options, prefixes=("https://",))


@query("M2_member_file_manifest", f"""WITH m AS (SELECT c_nationkey AS guild_id, c_custkey AS user_id, c_mktsegment AS s, c_acctbal AS b FROM customer)
SELECT guild_id, user_id, u AS url, u AS download_url FROM (
  SELECT guild_id, user_id, {HOST}/avatars/' || user_id || '/' || CASE WHEN s = 'BUILDING' THEN 'a_' ELSE '' END || 'h' || user_id
    || '.webp?size=4096' || CASE WHEN s = 'BUILDING' THEN '&animated=true' ELSE '' END AS u FROM m
  UNION ALL SELECT guild_id, user_id, {HOST}/guilds/' || guild_id || '/users/' || user_id || '/avatars/g.webp?size=4096' FROM m WHERE b < 0
  UNION ALL SELECT guild_id, user_id, {HOST}/guilds/' || guild_id || '/users/' || user_id || '/banners/a_b.webp?size=4096' FROM m WHERE s = 'MACHINERY')""")
def _(t):
    segment = F.col("c_mktsegment")
    members = t.customer.select(
        F.col("c_nationkey").alias("guild_id"), F.col("c_custkey").alias("user_id"),
        F.concat(F.when(segment == "BUILDING", "a_").otherwise(""), F.lit("h"), F.col("c_custkey").cast("string")).alias("user_avatar"),
        F.when(F.col("c_acctbal") < 0, "g").alias("avatar"), F.when(segment == "MACHINERY", "a_b").alias("banner"),
    )
    return M.member_file_manifest(members)


@query("M3_server_file_manifest", f"""
SELECT guild_id, u AS url, u AS download_url FROM (
  SELECT c_custkey AS guild_id, {HOST}/icons/' || c_custkey || '/a_i.webp?size=4096&animated=true' AS u FROM customer
  UNION ALL SELECT c_custkey, {HOST}/splashes/' || c_custkey || '/a_s.webp?size=4096' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, {HOST}/discovery-splashes/' || c_custkey || '/d.webp?size=4096' FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, {HOST}/banners/' || c_custkey || '/b.webp?size=4096' FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT p_size, {HOST}/emojis/' || p_partkey || '.webp?size=4096' || CASE WHEN p_type = 'PROMO' THEN '&animated=true' ELSE '' END FROM part)""")
def _(t):
    guilds = t.customer.select(
        F.col("c_custkey").alias("id"), F.lit("a_i").alias("icon"),
        F.when(F.col("c_acctbal") < 0, "a_s").alias("splash"),
        F.when(F.col("c_mktsegment") == "BUILDING", "d").alias("discovery_splash"),
        F.when(F.col("c_nationkey") == 3, "b").alias("banner"),
    )
    emojis = t.part.select(
        F.col("p_size").cast("long").alias("guild_id"), F.col("p_partkey").alias("id"), (F.col("p_type") == "PROMO").alias("animated")
    )
    return M.server_file_manifest(guilds, emojis)


@query("M4_reaction_emoji_manifest", f"""
SELECT DISTINCT {HOST}/emojis/' || l_partkey || '.webp?size=4096' || CASE WHEN l_partkey % 2 = 1 THEN '&animated=true' ELSE '' END AS url,
  {HOST}/emojis/' || l_partkey || '.webp?size=4096' || CASE WHEN l_partkey % 2 = 1 THEN '&animated=true' ELSE '' END AS download_url
FROM lineitem WHERE l_returnflag = 'A'""")
def _(t):
    reactions = t.lineitem.select(
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("emoji_id"), (F.col("l_partkey") % 2 == 1).alias("animated")
    )
    return M.reaction_emoji_manifest(reactions)


def registry(t):
    """Pages as registered files: some failed, some never asked for."""
    failed = F.col("url").contains("/fr/")
    return t.pages.where("url NOT LIKE '%page=%'").select(
        "url", F.when(~failed, F.sha2("html", 256)).alias("hash"), F.when(failed, 404).alias("error_code")
    )


REGISTRY_SQL = """registry AS (SELECT url, CASE WHEN NOT contains(url, '/fr/') THEN sha256(html) END AS hash,
  CASE WHEN contains(url, '/fr/') THEN 404 END AS error_code FROM pages WHERE url NOT LIKE '%page=%')"""


@query("M5_pending_files", f"""WITH {REGISTRY_SQL}
SELECT url, min(d) AS download_url FROM (
  SELECT url, url || '&a=1' AS d FROM pages UNION ALL SELECT url, url || '&a=2' FROM pages)
WHERE url NOT IN (SELECT url FROM registry) GROUP BY url""")
def _(t):
    manifest = t.pages.select("url", F.explode(F.array(F.lit("&a=2"), F.lit("&a=1"))).alias("sig")).select(
        "url", F.concat("url", "sig").alias("download_url")
    )
    return M.pending_files(manifest, registry(t))


@query("M6_dedupe_content", """
SELECT sha256(text) AS hash, count(*) AS n, min(u) AS first_url,
  CAST(sum(octet_length(encode(text))) - max(octet_length(encode(text))) AS BIGINT) AS bytes_saved
FROM (SELECT text, 'doc/' || doc_id AS u FROM documents) GROUP BY 1""")
def _(t):
    files = t.documents.select(
        F.col("text").alias("content"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url")
    )
    return M.dedupe_content(files)


@query("M7_register_files", f"""WITH {REGISTRY_SQL}
SELECT url, hash, error_code FROM (
  SELECT url, CASE WHEN page_id % 3 <> 0 THEN sha256(html) END AS hash, CASE WHEN page_id % 3 = 0 THEN 500 END AS error_code,
    row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages WHERE html NOT LIKE '%lang="de"%')
WHERE rn = 1 AND url NOT IN (SELECT url FROM registry)""")
def _(t):
    both = F.col("html").contains('lang="de"')
    failed = F.col("page_id") % 3 == 0
    results = t.pages.select(
        "url", F.col("page_id").alias("seq"),
        # A result with hash and error is rejected.
        F.when(~failed | both, F.sha2("html", 256)).alias("hash"), F.when(failed | both, 500).alias("error_code"),
    )
    added, _ = M.register_files(registry(t), results)
    return added


STORE_PROBLEMS_SQL = f"""WITH {REGISTRY_SQL},
stored AS (SELECT DISTINCT sha256(html) AS hash FROM pages WHERE url LIKE 'https://%'),
known AS (SELECT DISTINCT hash FROM registry WHERE hash IS NOT NULL)
SELECT hash, 'missing' AS problem FROM known WHERE hash NOT IN (SELECT hash FROM stored)
UNION ALL SELECT hash, 'extra' FROM stored WHERE hash NOT IN (SELECT hash FROM known)"""


@query("M8_store_consistency", STORE_PROBLEMS_SQL)
def _(t):
    listing = t.pages.where("url LIKE 'https://%'").select(F.sha2("html", 256).alias("hash"))
    return M.store_consistency(registry(t), listing)


@query("M8_store_listing", STORE_PROBLEMS_SQL)
def _(t):
    path = work_dir(t.spark, "store")
    pages = t.pages.where("url LIKE 'https://%'").select(F.sha2("html", 256).alias("hash"), F.col("html").alias("content"))
    M.store_files(pages.dropDuplicates(["hash"]), path)
    return M.store_consistency(registry(t), M.store_listing(t.spark, path))


@query("M9_classify_pending", f"""WITH {REGISTRY_SQL}
SELECT page_id, sha256(html) AS hash, sha256(html) IN (SELECT hash FROM registry WHERE hash IS NOT NULL) AS keep FROM pages""")
def _(t):
    pending = t.pages.select("page_id", F.sha2("html", 256).alias("hash"))
    return M.classify_pending(pending, registry(t)).select("page_id", "hash", "keep")


@query("M10_file_links", f"""WITH named AS (
  SELECT url, key, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.([^.]*)$', 1) || '-' ELSE name || '-' END AS head,
    CASE WHEN contains(name, '.') THEN '.' || regexp_extract(name, '^(.*)\\.([^.]*)$', 2) ELSE '' END AS tail
  FROM {NAMED_PAGES} JOIN (SELECT page_id,
    regexp_extract(url, '^[^?#]*') || CASE WHEN page_id % 2 = 0 THEN '.tar.gz' ELSE '' END || regexp_extract(url, '^[^?#]*(.*)$', 1) AS url
    FROM pages WHERE NOT contains(url, '/fr/')) USING (page_id)
), ranked AS (
  SELECT *, first_value(key) OVER (PARTITION BY head || substr(key, 1, 4) || tail ORDER BY url, key) AS winner FROM named
)
SELECT head || CASE WHEN key = winner THEN substr(key, 1, 4) ELSE key END || tail AS name, url, key FROM ranked""")
def _(t):
    files = t.pages.select(
        page_file_url().alias("url"), F.sha2("html", 256).alias("hash"),
        F.when(F.col("url").contains("/fr/"), 404).alias("error_code"),
    )
    return M.file_links(files)


@query("M11_file_stats", """WITH h AS (
  SELECT sha256(text) AS hash, count(*) AS n, max(octet_length(encode(text))) AS size FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(n * size) AS BIGINT) AS bytes, count(*) AS unique_files,
  CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(n - 1) AS BIGINT) AS duplicate_files,
  CAST(sum((n - 1) * size) AS BIGINT) AS duplicate_bytes FROM h""")
def _(t):
    return M.file_stats(t.documents.withColumnRenamed("text", "content"))
