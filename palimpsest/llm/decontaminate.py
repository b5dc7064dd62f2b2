"""Benchmark decontamination: words of a text that stand in a passage of a test item. DataFrame functions only.

Test items are cut into windows of ``width`` words; a shorter item is one window of all its words. The distinct windows, keyed by
the hash of their words, are the broadcast hash set. A text is scanned once: its word hashes are joined to hashes of windows by
doubling (1, 2, 4, 8 words and what makes up the width), every window looks up the set inside the task that read the
text, and the words themselves are compared before a window counts. Only hits leave the task, and one mark a text.

The set is broadcast while its measured size is below BROADCAST_BYTES. Beyond that the hashes are shuffled to the windows,
without their texts, and what they meet goes back to its text to be compared: same rows, more shuffle.

Defined results: NULL and empty texts have no words and no hits; an item without words has no window; items of one id are one
item; items without an id hit words, but are in no list and no count; repeated rows are judged each; empty tables give
no hits. A text must fit in memory as an array of its words. Further columns of ``docs`` stay; of equal names the judgement's win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.staging import staged

WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# The same bytes in a text whose letters are still upper or lower case.
BETWEEN_ANY_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
IN_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BROADCAST_BYTES = 64 << 20
# What a broadcast row takes besides its words.
ROW_BYTES = 96
# Key of the mark of a text; a window with this hash has words, the mark has none.
MARK = 0


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"{BETWEEN_WORDS}+"), lambda w: w != "")


def word_hash(word: Column) -> Column:
    return F.xxhash64(word)


def joined_hash(one: Column, other: Column) -> Column:
    return F.xxhash64(one, other)


def window_hashes(tokens: str, sizes: list[int]) -> list[Column]:
    """For each of ``sizes`` the hashes of all windows of so many words, in order.

    ``tokens`` names the column of the words' hashes. Hashes of longer runs come from two runs on end, so a window costs as many
    steps as its size has binary digits, not as it has words.
    """
    def joined(left: Column, n_left: int, right: Column, n_right: int) -> Column:
        n = F.greatest(F.size(tokens) - (n_left + n_right - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, n), F.slice(right, n_left + 1, n), joined_hash)

    powers = {1: F.col(tokens)}
    while 2 * max(powers) <= max(sizes, default=1):
        k = max(powers)
        powers[2 * k] = joined(powers[k], k, powers[k], k)
    found = []
    for size in sizes:
        at, hashes = 0, None
        for k in sorted(powers, reverse=True):
            if (size & k) and k <= size:
                hashes = powers[k] if hashes is None else joined(hashes, at, powers[k], k)
                at += k
        found.append(hashes)
    return found


def benchmark_windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(window_id, size, words, item_id) of every window of every item."""
    split = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))))
    cut = split.where(F.size("w") > 0).select("item_id", "w", at.alias("at")).select(
        "item_id", F.slice("w", F.col("at"), width).alias("words"))
    return cut.distinct().select(
        F.sha2(F.array_join("words", " "), 256).alias("window_id"), F.size("words").alias("size"), "words", "item_id")


def keyed_windows(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, size, words, window_id): one row for each distinct window, with the hash of its words."""
    distinct = windows.dropDuplicates(["window_id"]).withColumn("h", F.transform("words", word_hash))
    hashes = F.coalesce(*[F.when(F.col("size") == k, F.get(h, F.lit(0))) for k, h in zip(sizes, window_hashes("h", sizes))])
    return distinct.select(hashes.alias("key"), "size", "words", "window_id")


def find_hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The written hits and the windows with their items.

    Hits: (doc_id, text_key, n_words, at, size, window_id), a row for each place of a window, and a row of size 0 for each row of ``docs``.
    """
    windows = staged(benchmark_windows(benchmark, item_id=item_id, text=item_text, width=width), "windows")
    # At most ``width`` different sizes.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    split = texts.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    marks = [F.array(F.lit(MARK).cast("long"))]
    places = split.withColumn("h", F.transform("w", word_hash)).select(
        "doc_id", "text_key", "w", "n_words", F.posexplode(F.concat(*window_hashes("h", sizes), *marks)).alias("place", "key"))
    # The lists of all sizes stand one after another: a place less the lists before its own is a word's number.
    lengths = [F.greatest(F.col("n_words") - (k - 1), F.lit(0)) for k in sizes]
    before, starts = F.lit(0), {}
    for k, n in zip(sizes, lengths):
        starts[k], before = before, before + n
    is_mark = (F.col("size") == 0) & (F.col("place") == before)

    def first_word() -> Column:
        at = F.lit(0)
        for k in sizes:
            at = F.when(F.col("size") == k, F.col("place") - starts[k]).otherwise(at)
        return at

    inside = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n_words"))
    same = F.when(inside, F.slice("w", F.col("at") + 1, F.col("size")) == F.col("words")).otherwise(False)
    keyed = keyed_windows(windows, sizes) if sizes else windows.select(
        F.lit(MARK).cast("long").alias("key"), "size", "words", "window_id")
    mark = docs.sparkSession.range(1).select(
        F.lit(MARK).cast("long").alias("key"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("words"),
        F.lit(None).cast("string").alias("window_id"))
    hash_set = staged(keyed.unionByName(mark), "hash-set")
    measured = hash_set.agg(F.sum(F.lit(ROW_BYTES) + F.length(F.array_join("words", " ")) * 4 + F.size("words") * 16).alias("b")).first()["b"]
    columns = ["doc_id", "text_key", "n_words", "at", "size", "window_id"]
    if measured <= broadcast_bytes:
        met = places.join(F.broadcast(hash_set), "key").withColumn("at", first_word())
        return staged(met.where(is_mark | ((F.col("size") > 0) & same)).select(*columns), "hits"), windows
    rows = split.select("doc_id", "text_key", "n_words", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("window_id"))
    met = places.drop("w").join(hash_set.select("key", "size", "window_id").where("size > 0"), "key").withColumn("at", first_word())
    met = staged(met.where(inside).select(*columns), "met")
    named = split.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "w")
    checked = met.distinct().join(
        named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    ).join(hash_set.select("window_id", "words"), "window_id").where(same)
    return staged(checked.select(*columns).unionByName(rows), "hits"), windows


def hit_spans(hits: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, last): the runs of words inside windows, windows that meet or overlap joined."""
    ends = hits.where("size > 0").groupBy("doc_id", "text_key", "at").agg(F.max(F.col("at") + F.col("size")).alias("end"))
    in_order = Window.partitionBy("doc_id", "text_key").orderBy("at")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = ends.withColumn("begins", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_key", "run").agg(F.min("at").alias("first"), (F.max("end") - 1).alias("last")).drop("run")


def judge(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_spans) of every row of ``docs``."""
    hits, windows = find_hits(docs, benchmark, **how)
    spans = hit_spans(hits).groupBy("doc_id", "text_key").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.count("*").alias("n_spans"))
    found = hits.where("size > 0").select("doc_id", "text_key", "window_id").distinct()
    named = windows.where("item_id IS NOT NULL").select("window_id", F.col("item_id").cast("string").alias("item"))
    items = found.join(named, "window_id").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = hits.where("size = 0").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))

    def with_row(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        met = left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        return met.drop("_id", "_key")

    none = F.lit(0).cast("long")
    return with_row(with_row(marks, spans), items).select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_spans", none).alias("n_spans"),
    )


def _with_spans(docs: DataFrame, benchmark: DataFrame, how: dict) -> DataFrame:
    """``docs`` and the spans of each row as _spans, NULL without hits."""
    hits, _ = find_hits(docs, benchmark, **how)
    spans = hit_spans(hits).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("first", "last")).alias("_spans"))
    doc_id, text = F.col(how.get("doc_id", "doc_id")), F.col(how.get("text", "text"))
    keys = doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    return docs.drop("_id", "_key", "_spans").join(spans, keys, "left").drop("_id", "_key")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    return _with_spans(docs, benchmark, how).where("_spans IS NULL").drop("_spans")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with the words inside windows, and what stands before each of them, taken out of the text."""
    name = how.get("text", "text")
    marked = _with_spans(docs, benchmark, how)
    # Every word with what stands before it; then what stands after the last one.
    parts = F.regexp_extract_all(F.col(name), F.lit(f"{BETWEEN_ANY_WORDS}*{IN_ANY_WORD}+"), F.lit(0))
    tail = F.regexp_extract(F.col(name), f"{BETWEEN_ANY_WORDS}*\\z", 0)
    kept = F.filter(parts, lambda _, i: ~F.exists("_spans", lambda s: (i >= s["first"]) & (i <= s["last"])))
    cut = F.concat(F.array_join(kept, ""), tail)
    return marked.withColumn(name, F.when(F.col("_spans").isNull(), F.col(name)).otherwise(cut)).select(*docs.columns)
