"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    collocations, decontaminate, fingerprints, licenses, line_dedup, lm_score, mixing, ngram_join, pieces, quality, url_filter, vectors,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(table(spark, folder, "documents").select("doc_id", "text"))
    bits = F.col("bits")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hex_digits(bits).alias("fingerprint"),
        fingerprints.hex_digits(F.col("edited_bits")).alias("edited_fingerprint"),
        fingerprints.likeness(bits, F.col("edited_bits")).alias("near_edited"),
        fingerprints.likeness(bits, F.col("next_bits")).alias("near_next"), "n_similar", "similar_id",
    )


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents").select("doc_id", "text"))


def joined_labels(*hits: str):
    """The distinct labels of some hit columns, sorted and comma-joined."""
    labels = F.concat(*[F.transform(h, lambda x: x["label"]) for h in hits])
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op3_licenses")
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    starts = F.transform("_base", lambda x: x["first_word"])
    best = F.array_max(F.transform(F.concat("_base", "_fuzzy"), lambda x: x["likeness"]))
    return licenses.scan_licenses(docs).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined_labels("_base").alias("base_labels"), joined_labels("_base", "_fuzzy").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"), F.size("_fuzzy").cast("long").alias("n_fuzzy"),
    )


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_documents(table(spark, folder, "documents"))


@query("op5_line_dedup", """
WITH lines AS (
  SELECT source AS host, text AS page, trim(unnest(string_split(text, chr(10)))) AS line FROM documents
), totals AS (
  SELECT source AS host, count(DISTINCT text) AS total FROM documents GROUP BY 1
), boilerplate AS (
  SELECT l.host, l.line FROM lines l JOIN totals t ON l.host IS NOT DISTINCT FROM t.host
  WHERE l.line <> '' GROUP BY l.host, l.line, t.total
  HAVING count(DISTINCT l.page) >= 5 AND count(DISTINCT l.page) / t.total > 0.0625
), per_host AS (SELECT host, list(line) AS gone FROM boilerplate GROUP BY 1), cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.gone, []), trim(x))) AS kept
  FROM documents d LEFT JOIN per_host b ON d.source IS NOT DISTINCT FROM b.host
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
""")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op6_pieces")
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECE_MODEL, decoded="_decoded").select(
        "doc_id", F.coalesce(F.size("_pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("_pieces").alias("pieces_hash"), F.sha2("_decoded", 256).alias("decoded_sha256"),
        F.col("_decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op7_vectors")
def op7_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query("op8_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM per_source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (
             ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
             ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight < cap
              THEN max(CASE WHEN level * weight < cap THEN level END) OVER () * weight ELSE cap END AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT s.doc_id, s.size, r.source_size, r.target, (s.size * (floor(r.rate) + (
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '') || ':' || coalesce(s.source, '') || ':' || s.text_md5), 1, 8))::UBIGINT / 4294967296.0
         < r.rate - floor(r.rate))::INT))::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
""")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.with_copies(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
    )


URL_RULES = (
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
)


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


# Grades of the ratings: 0 for low quality, 1 for good but toxic text, 2 for good text.
GOOD_GRADE = 2


def graded(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.classify(docs, graded(table(spark, folder, "labels")), good=GOOD_GRADE).select(
        "doc_id", F.col("_expected_grade").alias("expected_grade"),
        F.col("_tail_probability").alias("tail_probability"), F.col("_kept").alias("kept"),
    )


@query("op11_collocations", r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, k AS words, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), counted AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE words >= 2 AND f >= 10
), cuts AS (
  SELECT lang, words, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS le, array_to_string(list_slice(w, k + 1, words), ' ') AS ri
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.le JOIN counted y ON y.lang = c.lang AND y.phrase = c.ri
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), within AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM candidates WHERE words = 3) GROUP BY ALL
), kept AS (
  SELECT o.* FROM lowest o LEFT JOIN within i ON o.lang = i.lang AND o.phrase = i.sub WHERE i.longer IS NULL OR 100 * i.longer < 50 * o.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


@query("op12_decontaminate", r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT r, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc_words CROSS JOIN (SELECT DISTINCT len(win) AS k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT p.r, p.k, p.i, b.item_id FROM places p JOIN windows b ON p.win = b.win
), covered AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
), spans AS (
  SELECT r, sum(begins)::BIGINT AS n_spans FROM (
    SELECT r, CASE WHEN i <= max(e) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins
    FROM (SELECT r, i, max(i + k) AS e FROM hits GROUP BY r, i)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated, coalesce(s.n_spans, 0)::BIGINT AS n_spans
FROM doc_words d LEFT JOIN covered c USING (r) LEFT JOIN spans s USING (r) LEFT JOIN named n USING (r)
""")
def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, table(spark, folder, "benchmark"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
