"""Mixing of sources to target weights.

Tokens are added up per source, a repetition rate follows for each source, and each document is taken
floor(rate) times, and once more with probability rate - floor(rate); the coin is a hash of seed, document id,
source and text, so reruns and lost tasks agree. DataFrame functions only.

Defined results: NULL text has size 0; NULL is a source of its own, the last one; repeated rows count and
share a coin only where id, source and text are equal; texts of any length count whole; an empty table gives an empty result; sources without
words have target 0, rate 0 and none of their rows is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(
    sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS,
    source: str = "source", size: str = "size",
) -> DataFrame:
    """(source, source_size, target, rate), one row per source.

    The sources, by code point and NULL last, weigh ``weights`` in turn and share ``share`` times all tokens.
    A target stops at ``most`` times its source; what it leaves goes to the others by weight. With the sources
    in order of (most * size) / weight the stopped ones come first, so running sums give the level that the
    others reach. The windows see one row per source.
    """
    per_source = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    in_order = Window.orderBy(F.col(source).asc_nulls_last())
    turn = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = per_source.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped_before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("_weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_sizes = F.sum("source_size").over(everything)
    levels = weighed.withColumn("_level", (all_sizes * share - stopped_before) / weight_left)
    # The first source that isn't stopped sets the level; for those after it the running sums take off too much.
    open_level = F.max(F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.col("_level"))).over(everything)
    target = F.when(
        F.col("_level") * F.col("_weight") < F.col("_cap"), open_level * F.col("_weight")
    ).otherwise(F.col("_cap"))
    return levels.withColumn("target", target).select(
        source, "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def coin(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the row."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source)]
    seeded = F.concat_ws(":", F.lit(seed), *parts, F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_copies(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how
) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies, how often the mix takes the row.

    The rates are one row per source, so Spark broadcasts them when they are small and splits a hot source
    at run time when they are not. Columns of ``docs`` with these names are replaced.
    """
    # The coin is tossed beside the count of words, so that a text which isn't asked for doesn't travel to the rates.
    sized = docs.withColumns({"_size": word_count(F.col(text)), "_mix_coin": coin(F.col(doc_id), F.col(source), F.col(text), seed)})
    rates = source_rates(
        sized.select(F.col(source).alias("_source"), "_size"), source="_source", size="_size", **how
    ).withColumnsRenamed({"source_size": "_source_size", "target": "_target", "rate": "_rate"})
    met = sized.drop("_source_size", "_target", "_rate", "_copies", "_source").join(
        rates, F.col(source).eqNullSafe(F.col("_source")), "left"
    )
    whole = F.floor("_rate")
    extra = (F.col("_mix_coin") < F.col("_rate") - whole).cast("long")
    return met.withColumn("_copies", whole + extra).drop("_source", "_rate", "_mix_coin")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = with_copies(docs, **how)
    repeated = copies.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)
