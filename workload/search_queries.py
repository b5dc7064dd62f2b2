"""X: word search."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import search as X
from palimpsest.plans.staging import staged, work_dir
from palimpsest.sources import archive, segments
from workload.registry import query
from workload.stand_ins import SERVER_SQL

# Lower case, one accent off per letter, split on all but letters and digits.
POSTINGS_SQL = """words AS (
  SELECT doc_id AS id, regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}\\p{Co}]+') AS w FROM documents),
parts AS (SELECT id, unnest(w) AS token, unnest(range(len(w))) AS place FROM words),
spots AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS pos FROM parts WHERE token <> ''),
postings AS (SELECT token, id, list(pos ORDER BY pos) AS positions FROM spots GROUP BY token, id)"""


# Folders of written indexes, one for each application and input.
_WRITTEN: dict[tuple[str, str], str] = {}


def postings(t):
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return X.build_index(texts)


def stored(t):
    """The index of all documents; the first query writes it."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _WRITTEN:
        path = work_dir(t.spark, "index")
        segments.write_index(postings(t), path)
        _WRITTEN[key] = path
    return segments.read_index(t.spark, _WRITTEN[key])


@query("X1_build_index", f"""WITH {POSTINGS_SQL}
SELECT token, id, len(positions) AS n, array_to_string(positions, ',') AS positions FROM postings""")
def _(t):
    return postings(t).select(
        "token", "id", F.size("positions").cast("long").alias("n"),
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"),
    )


@query("X2_search_all", f"""WITH {POSTINGS_SQL}
SELECT id FROM postings WHERE token IN ('the', 'erst', 'and') GROUP BY id HAVING count(*) = 3""")
def _(t):
    return X.search_all(stored(t), ["The", "erst", "AND"])


@query("X3_search_any", f"WITH {POSTINGS_SQL} SELECT DISTINCT id FROM postings WHERE token IN ('erst', 'ecole', 'ete')")
def _(t):
    return X.search_any(stored(t), ["erst", "école", "Été"])


@query("X4_search_phrase", f"""WITH {POSTINGS_SQL}
SELECT DISTINCT a.id FROM spots a JOIN spots b ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'""")
def _(t):
    return X.search_phrase(stored(t), "of the")


@query("X5_search_prefix", f"WITH {POSTINGS_SQL} SELECT DISTINCT id FROM postings WHERE token LIKE 'eau%'")
def _(t):
    return X.search_prefix(stored(t), "Éau")


@query("X6_search_not", f"""WITH {POSTINGS_SQL}
SELECT DISTINCT id FROM postings WHERE token = 'the' AND id NOT IN (SELECT id FROM postings WHERE token = 'erst')""")
def _(t):
    index = stored(t)
    return X.search_not(X.search_any(index, ["the"]), X.search_any(index, ["erst"]))


@query("X7_search_near", f"""WITH {POSTINGS_SQL}
SELECT DISTINCT a.id FROM spots a JOIN spots b ON b.id = a.id AND abs(b.pos - a.pos) <= 4 WHERE a.token = 'is' AND b.token = 'the'""")
def _(t):
    return X.search_near(stored(t), "is", "the", 3)


@query("X8_highlight", r"""
SELECT doc_id AS id, regexp_replace(' ' || regexp_replace(text, '([^\p{L}\p{N}\p{Co}]+)', ' \1 ', 'g') || ' ',
  ' ((?i:of) [^\p{L}\p{N}\p{Co}]+ (?i:the)|(?i:erst)) ', ' [\1] ', 'g') AS content FROM documents""")
def _(t):
    spaced = F.concat(
        F.lit(" "), F.regexp_replace("text", r"([^\p{L}\p{N}\p{Co}]+)", " $1 "), F.lit(" ")
    )
    return t.documents.select(
        F.col("doc_id").alias("id"), X.highlight(spaced, ["of the", "erst"], "[", "]").alias("content")
    )


@query("X9_search_results", f"""WITH {SERVER_SQL}
SELECT o_orderkey AS id,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'hook ' || c.c_custkey END ELSE c.c_name END AS username,
  o_orderstatus = 'F' AS is_webhook, p.channel_name,
  CASE WHEN o_custkey % 3 = 1 THEN q.channel_name END AS parent_channel_name,
  CASE WHEN o_custkey % 3 = 1 THEN q.n_name ELSE p.n_name END AS guild_name
FROM orders JOIN customer c ON c.c_custkey = o_custkey
  JOIN places p ON p.channel_id = o_custkey LEFT JOIN places q ON q.channel_id = o_custkey - 1
WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    messages = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel_id"), F.col("o_custkey").alias("author_id"),
        F.when(F.col("o_orderstatus") == "F", "webhook").otherwise("user").alias("author_kind"),
    )
    hits = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    users = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.lit("0").alias("discriminator")
    )
    webhooks = t.customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("internal_id"), F.concat(F.lit("hook "), F.col("c_custkey").cast("string")).alias("username")
    )
    places = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("guild_id")
    )
    thread = F.col("id") % 3 == 1
    threads = places.where(thread).select("id", "name", (F.col("id") - 1).alias("parent_id"))
    guilds = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    found = X.search_results(hits, messages, users, webhooks, places.where(~thread), threads, guilds)
    return found.select("id", "username", "is_webhook", "channel_name", "parent_channel_name", "guild_name")


CHANGED_SQL = POSTINGS_SQL.replace(
    "FROM documents)",
    "FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'changed text ' || doc_id ELSE text END AS text "
    "FROM documents WHERE lang <> 'de'))",
)


def changed_documents(t):
    """French documents get a new text, German ones go, Spanish ones come."""
    return t.documents.where("lang IN ('fr', 'de', 'es')").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("changed text "), F.col("doc_id").cast("string")))
        .when(F.col("lang") == "es", F.col("text")).alias("content"),
    )


def first_index(t):
    path = work_dir(t.spark, "index")
    segments.write_index(X.build_index(t.documents.where("lang <> 'es'"), "doc_id", "text"), path)
    return path


def places(postings):
    return postings.select(
        "token", "id", F.size("positions").cast("long").alias("n"), F.col("positions")[0].cast("long").alias("first"))


CHANGED_POSTINGS_SQL = f"""WITH {CHANGED_SQL}
SELECT token, id, len(positions) AS n, positions[1] AS first FROM postings"""


@query("X10_maintain_index", CHANGED_POSTINGS_SQL)
def _(t):
    path = first_index(t)
    segments.append_changes(t.spark, path, changed_documents(t))
    return places(segments.read_index(t.spark, path))


@query("X10_merge_segments", CHANGED_POSTINGS_SQL)
def _(t):
    # Texts come twice: a first state that a later batch replaces, so merged segments hold replaced postings and marks.
    path = first_index(t)
    changes = staged(changed_documents(t).withColumn("part", F.pmod("id", F.lit(3))), "changes")
    for part in range(3):
        rows = changes.where(F.col("part") == part)
        segments.append_changes(t.spark, path, rows.withColumn("content", F.lit("not yet the text")))
        segments.append_changes(t.spark, path, rows)
    archive.vacuum(t.spark, path)
    return places(segments.read_index(t.spark, path))
