"""The corpus pipeline: documents through a chain of operators, each stage written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``docs``, further ones included, whatever their names (the last replaces ``pieces`` and ``n_pieces``). NULL texts are rejected by the classifier; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, mixing, ngram_join, pieces, quality
from palimpsest.llm.queries import GOOD_GRADE, PIECE_MODEL, graded, table
from palimpsest.plans.staging import staged


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_further_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Columns beyond those of documents have other names inside the stage, so that none meets a name in use there."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c: f"further_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(inside), sf_dir)
        outside = {new: old for old, new in inside.items() if old not in out.columns}
        return out.drop(*[new for new in inside.values() if new not in outside]).withColumnsRenamed(outside)

    return run_stage


@keeping_further_columns
def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = quality.classify(docs, graded(table(spark, sf_dir, "labels")), good=GOOD_GRADE)
    return judged.where("_kept").select(*docs.columns)


@keeping_further_columns
def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on its documents go; a document that held nothing else goes as well."""
    cut = line_dedup.drop_boilerplate(docs)
    emptied = F.coalesce((F.col("_n_dropped") > 0) & (F.trim("text") == ""), F.lit(False))
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@keeping_further_columns
def join_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows of one id with different texts are documents of their own: they go by a hash of id and text, and of a group's rows with the smallest
    id the one with the smallest hash stays. Repeated rows are one document; rows without an id all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    again = staged(named.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"), "repeated-ids")
    rows = named.join(again, named.doc_id == again._again, "left").withColumn(
        "_row", F.when(F.col("_again").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")))
    groups = ngram_join.similar_groups(rows.select("_row", "text"), doc_id="_row").select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    first = rows.select("_row", "doc_id").join(groups, "_row").groupBy("_group").agg(F.min(F.struct("doc_id", "_row")).alias("_first"))
    kept = rows.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_semi")
    single = kept.where("_again IS NULL")
    repeated = kept.where("_again IS NOT NULL").dropDuplicates(["_row"])
    return single.unionByName(repeated).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


@keeping_further_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; documents stand as often as the mix takes them."""
    return mixing.mix(docs)


@keeping_further_columns
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece numbers of each text, and the text that they decode to."""
    encoded = pieces.encode(docs, PIECE_MODEL, decoded="_decoded")
    return encoded.select(
        *[c for c in docs.columns if c != "text"], F.col("_decoded").alias("text"),
        F.col("_pieces").alias("pieces"), F.coalesce(F.size("_pieces"), F.lit(0)).cast("long").alias("n_pieces"),
    )


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", clean_lines),
    ("n-gram jaccard join", join_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
# The classifier, the groups and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
