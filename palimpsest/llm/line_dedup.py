"""Lines that a site repeats on its pages.

For each host the pages that hold a line are divided by the pages of the host; a line above the ratio is
boilerplate of that host and goes from its pages. Equal pages of a host count as one page, so that copies of a
page don't make its text boilerplate. DataFrame functions only.

Defined results: NULL text stays NULL and has no lines; NULL is a host of its own; lines are compared without
outer spaces, empty ones are never dropped; lines on fewer than ``min_pages`` pages stay, so a host with few pages
loses nothing; a page of boilerplate only becomes the empty text; repeated rows stay; texts of any length
are cut whole, within their row; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.staging import staged

# More than one page in sixteen: what a site puts on every tenth page or so is caught in each of its sources, what pages
# merely share by chance (below one in twenty) isn't. A power of two, so that the division is exact at the border.
RATIO = 0.0625
MIN_PAGES = 5
# A table of line hashes up to this many entries is sent to all executors (16 bytes each).
BROADCAST_LINES = 2_000_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line_key, n_pages, ratio) of the lines that exceed the ratio.

    Pages and lines travel as hashes. The ratios of a host's lines add up to its mean lines a page, so a host has
    at most that number divided by ``ratio`` rows here.
    """
    keyed = pages.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.xxhash64(text, F.reverse(text)).alias("page"),
        F.filter(lines_of(F.col(text)), lambda x: F.trim(x) != "").alias("lines"),
    )
    # Hot hosts and copies: (host, page) and (host, line, page) are combined before each shuffle.
    totals = keyed.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("total"))
    held = keyed.select(
        "host", "page", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line_key")
    ).groupBy("host", "line_key", "page").agg(F.lit(1).alias("one"))
    counted = held.groupBy("host", "line_key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return (
        counted.join(totals.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
        .withColumn("ratio", F.col("n_pages") / F.col("total"))
        .where(F.col("ratio") > ratio).select("host", "line_key", "n_pages", "ratio")
    )


def drop_boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with the cleaned text, _n_lines and _n_dropped; columns with these and the inner names are replaced."""
    found = boilerplate(pages, host=host, text=text, ratio=ratio, min_pages=min_pages)
    per_host = staged(found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line_key").alias("_drop")),
                      "boilerplate")
    lines = per_host.agg(F.sum(F.size("_drop"))).first()[0] or 0
    # The text isn't shuffled while the table is small; beyond that Spark joins by host and splits hot ones.
    side = F.broadcast(per_host) if lines <= BROADCAST_LINES else per_host
    met = pages.drop("_host", "_drop", "_kept_lines", "_n_lines", "_n_dropped").join(
        side, F.col(host).eqNullSafe(F.col("_host")), "left"
    )
    every = lines_of(F.col(text))
    kept = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_drop"), line_key(x)))
    cut = met.withColumn("_kept_lines", F.when(F.col("_drop").isNotNull(), kept))
    n_lines = F.coalesce(F.size(every), F.lit(0))
    return cut.withColumns({
        "_n_lines": F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"),
        "_n_dropped": F.when(F.col("_kept_lines").isNull(), 0).otherwise(F.size(every) - F.size("_kept_lines")).cast("long"),
    }).withColumn(
        text, F.when(F.col("_n_dropped") > 0, F.array_join("_kept_lines", "\n")).otherwise(F.col(text))
    ).drop("_host", "_drop", "_kept_lines")
