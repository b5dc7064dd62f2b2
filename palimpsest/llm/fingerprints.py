"""Document fingerprints: SimHash and permuted block tables. DataFrame functions only.

The terms of a text are its shingles of five lower-case words (all words, if fewer), each occurrence weighted by its
letters. Every term hash votes with its weight on each of 64 signed bits; the fingerprint has the bits with more votes
for than against. Votes for bit j and bit j + 32 are added in one long, so 32 sums do for 64 bits; they are combined
in the task that holds the text, before any shuffle.

Fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` blocks. There is a table for each choice of
so many blocks, keyed by their bits; equal keys are candidates and the bits are then counted. Equal
fingerprints are one row in the tables.

Defined results: NULL text counts as empty; a text without words has fingerprint 0; repeated rows are fingerprinted each;
the last document is followed by the first, a single one by itself; of several rows of one id the smallest head and the
smallest fingerprint stand for it as the next document; a row without id has no next one: the replaced part is empty and its
likeness NULL. A text must fit in memory as an array of its words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.staging import staged

WIDTH = 5
BITS = 64
RADIUS = 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
TWO_BITS = (1 << 32) + 1


def terms(text: Column, width: int = WIDTH) -> Column:
    """Array of (hash, weight) of every shingle of the text."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), SPACES), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).cast("long").alias("n")))

    def shingle(part: Column) -> Column:
        return F.struct(
            F.xxhash64(F.transform(part, lambda x: x["h"])).alias("hash"),
            F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("weight"),
        )

    # The inner lambda keeps the words in one place: they are not split again for each shingle.
    return F.flatten(F.transform(F.array(hashed), lambda all_words: F.when(
        F.size(all_words) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_words) - (width - 1), F.lit(1))),
                    lambda i: shingle(F.slice(all_words, i, width))),
    ).otherwise(F.array().cast("array<struct<hash:bigint,weight:bigint>>"))))


def votes(hash_: Column, weight: Column) -> list[Column]:
    """Sums of the votes for bits j (low half) and j + 32 (high half), and of all weights."""
    return [
        F.sum(F.shiftright(hash_, j).bitwiseAND(F.lit(TWO_BITS)) * weight).alias(f"_v{j}") for j in range(32)
    ] + [F.sum(weight).alias("_all")]


def voted(total: Column) -> Column:
    """The fingerprint from the sums of ``votes``."""
    bits = F.lit(0).cast("long")
    for j in range(32):
        sums = F.col(f"_v{j}")
        low, high = sums.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(sums, 32)
        bits = bits.bitwiseOR(F.when(low * 2 > total, F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        top = F.lit(1 << (j + 32)) if j < 31 else F.lit(-(1 << 63))
        bits = bits.bitwiseOR(F.when(high * 2 > total, top).otherwise(F.lit(0)).cast("long"))
    return bits


def fingerprints(rows: DataFrame, texts: dict[str, Column], keys: list[str]) -> DataFrame:
    """``keys`` and one fingerprint for each of ``texts``, a row for each input row.

    Rows with equal keys must have equal texts; they are counted by a mark without votes, which also keeps rows
    without terms.
    """
    def vote_rows(tag: int, text: Column) -> Column:
        return F.transform(terms(text), lambda x: F.struct(
            F.lit(tag).alias("tag"), x["hash"].alias("hash"), x["weight"].alias("weight"), F.lit(0).alias("mark")))

    tagged = [vote_rows(tag, text) for tag, text in enumerate(texts.values())]
    marks = F.array(*[
        F.struct(F.lit(tag).alias("tag"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("weight"), F.lit(1).alias("mark"))
        for tag in range(len(texts))
    ])
    flat = rows.select(*keys, F.explode(F.concat(marks, *tagged)).alias("_t")).select(*keys, "_t.*")
    summed = flat.groupBy(*keys, "tag").agg(*votes(F.col("hash"), F.col("weight")), F.sum("mark").alias("_rows"))
    each = summed.select(*keys, "tag", "_rows", voted(F.col("_all")).alias("_bits"))
    named = [F.max(F.when(F.col("tag") == tag, F.col("_bits"))).alias(name) for tag, name in enumerate(texts)]
    together = each.groupBy(*keys).agg(*named, F.max("_rows").alias("_rows"))
    return together.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_row", "_rows")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, the last followed by the first.

    Ids are dealt by range and written with the number of their range; neighbours are found within the ranges, and the
    first ids of all ranges, one row a range, close the gaps between them.
    """
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = ids.where("doc_id IS NOT NULL").distinct()
    ranged = staged(distinct.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(
        F.lead("first").over(by_part), F.min("first").over(whole)).alias("after"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("_next", inside).join(F.broadcast(following), "part").select(
        "doc_id", F.coalesce("_next", "after").alias("next_id"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, text, edited): the last quarter of each text replaced by as much of the next one's head."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = plain.where("doc_id IS NOT NULL")
    part = F.floor(F.length("text") / 4).cast("int")
    needed = known.groupBy("doc_id").agg(F.max(part).alias("size")).join(next_ids(plain.select("doc_id")), "doc_id")
    needed = staged(needed, "needed")
    heads = (
        known.join(needed.select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "size"), "doc_id")
        .groupBy(F.col("before").alias("doc_id")).agg(F.min(F.expr("substring(text, 1, size)")).alias("head"))
    )
    met = known.join(heads, "doc_id").join(needed.select("doc_id", "next_id"), "doc_id")
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 4))"),
                      F.expr("substring(head, 1, cast(floor(length(text) / 4) AS int))"))
    lone = plain.where("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast("long").alias("next_id"), "text",
        F.expr("substring(text, 1, length(text) - floor(length(text) / 4))").alias("edited"))
    return met.select("doc_id", "next_id", "text", edited.alias("edited")).unionByName(lone)


def likeness(one: Column, other: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(one.bitwiseXOR(other)) / float(BITS)


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def block_keys(bits: Column, radius: int = RADIUS, block_bits: tuple[int, ...] = BLOCK_BITS) -> Column:
    """For each table its number and the bits of its blocks."""
    begins = [sum(block_bits[:i]) for i in range(len(block_bits))]
    masks = [((1 << size) - 1) << begin for size, begin in zip(block_bits, begins)]
    tables = []
    for number, chosen in enumerate(combinations(range(len(block_bits)), len(block_bits) - radius)):
        mask = sum(masks[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        tables.append(F.struct(F.lit(number).alias("number"), bits.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*tables)


def within_radius(prints: DataFrame, *, bits: str = "bits", doc_id: str = "doc_id", radius: int = RADIUS,
                  block_bits: tuple[int, ...] = BLOCK_BITS) -> DataFrame:
    """(bits, n_similar, similar_id) of every distinct fingerprint.

    n_similar counts the documents whose fingerprint is within the radius, equal ones included and itself too;
    similar_id is the smallest id among them. Pairs stand between distinct fingerprints only.
    """
    distinct = staged(prints.groupBy(F.col(bits).alias("bits")).agg(
        F.count("*").alias("n"), F.min(doc_id).alias("id")), "prints")
    table = distinct.select("bits", "n", "id", F.explode(block_keys(F.col("bits"), radius, block_bits)).alias("t"))
    left = table.select(F.col("t.number").alias("number"), F.col("t.key").alias("key"), "bits")
    right = table.select(F.col("t.number").alias("number"), F.col("t.key").alias("key"),
                         F.col("bits").alias("other"), F.col("n"), F.col("id"))
    near = (F.col("bits") != F.col("other")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= radius)
    pairs = left.join(right, ["number", "key"]).where(near).groupBy("bits", "other").agg(
        F.max("n").alias("n"), F.min("id").alias("id"))
    return pairs.select("bits", "n", "id").unionByName(distinct).groupBy("bits").agg(
        F.sum("n").alias("n_similar"), F.min("id").alias("similar_id"))


def fingerprint_documents(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, bits, edited_bits, next_bits, n_similar, similar_id) of every row."""
    rows = edited_documents(docs).withColumns({
        "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256),
        "_text": F.xxhash64("text", F.reverse("text")),
    })
    prints = staged(fingerprints(
        rows, {"bits": F.col("text"), "edited_bits": F.col("edited")},
        ["doc_id", "next_id", "n_chars", "edited_sha256", "_text"],
    ), "fingerprints")
    following = prints.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(
        F.min("bits").alias("next_bits"))
    similar = within_radius(prints, radius=radius)
    return prints.drop("_text").join(following, "next_id", "left").join(similar, "bits", "left")
