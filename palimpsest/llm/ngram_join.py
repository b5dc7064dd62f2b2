"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups they form.

Documents and shingles form a sparse 0/1 matrix A; A times its transpose holds the overlap of each two documents.
Two sets with Jaccard similarity >= s overlap in at least s / (1 + s) * (|x| + |y|) shingles, so, in any
common order of the columns, they meet in the first |x| - ceil(s * |x|) + 1 columns of each. The product runs over these
columns only, in blocks dealt by column, and its partial overlaps are added up. Pairs whose sizes, or whose
column counts in coarse blocks, bound the overlap below that are discarded; the others are counted exactly.

Frequent columns come last in the order, so a passage in thousands of documents makes no pairs. Equal sets are one
row. A large group of near copies is linked to one of its members for each column first; later only pairs whose components
are not joined yet are looked at, so its pairs are never listed.

Defined results: NULL and empty texts have no shingles and link with nothing; of fewer than ``width`` words the sequence
is one shingle; repeated rows are equal sets; rows of one id count as one document in ``component_id``; a NULL id
is in no component. Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.textops import (
    LOWER, NOT_SPACE, give_back, in_small_batches, shingle_hashes, slices, utf8, word_bounds, word_hashes,
)
from palimpsest.plans.staging import staged

WIDTH = 5
SIMILARITY = Fraction(4, 5)
# A column of more documents than this is frequent; so many frequent columns are put in order, at 12 bytes each. Columns
# beyond that keep their place by hash: the order decides how many pairs are looked at, not which are found.
FREQUENT = 8
ORDERED_COLUMNS = 1_000_000
# Column blocks whose counts bound the overlap of two documents.
BLOCKS = 128
# Ids that are sent to all executors to pick texts (8 bytes each); beyond that texts are joined by id.
BROADCAST_IDS = 2_000_000
COUNTED_BITS = 40
# Shingles (8 bytes each) that a task holds before it counts and sends them.
HELD_SHINGLES = 4_000_000


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text its distinct shingles in ascending order of their hashes."""
    data, offsets = utf8(column)
    low = LOWER[data]
    starts, ends, text = word_bounds(low, offsets, NOT_SPACE)
    hashes, owner = shingle_hashes(word_hashes(low, starts, ends), text, width)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]


def enough(overlap: np.ndarray, one: np.ndarray, other: np.ndarray, s: Fraction = SIMILARITY) -> np.ndarray:
    """Whether overlap / union reaches the similarity, in whole numbers."""
    return s.denominator * overlap >= s.numerator * (one + other - overlap)


def runs(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(ascending):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(ascending[1:] != ascending[:-1]) + 1, [len(ascending)]])


def packed_columns(held: list[np.ndarray], parts: int, step: int) -> tuple[list[bytes], list[bytes]]:
    """For each range of columns the distinct ones among ``held`` and how often each occurs; empties ``held``."""
    pack = zstandard.ZstdCompressor(level=1)
    every = np.concatenate(held)
    held.clear()
    every.sort()
    at = runs(every)
    columns, n = every[at[:-1]], np.minimum(np.diff(at), 65535).astype("<u2")
    del every, at
    cuts = np.searchsorted(columns, np.arange(parts + 1, dtype=np.uint64) * np.uint64(step))
    packed = [
        pack.compress(np.diff(columns[a:b], prepend=np.uint64(p * step)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())
        for p, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]
    return packed, [pack.compress(n[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]


def added_columns(blobs: list[tuple[bytes, bytes]], base: int, more_than: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of one range, ascending, and their counts over all blobs, where they exceed ``more_than``; empties ``blobs``.

    A column and its count are one number, sorted in place.
    """
    unpack = zstandard.ZstdDecompressor()
    every = []
    while blobs:
        packed, n = blobs.pop()
        raw = np.frombuffer(unpack.decompress(packed), np.uint8)
        one = np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8")[:, 0]) << np.uint64(16)
        one |= np.frombuffer(unpack.decompress(n), "<u2")
        every.append(one)
    joined = np.concatenate(every)
    every.clear()
    joined.sort()
    n = (joined & np.uint64(65535)).astype(np.int64)
    joined >>= np.uint64(16)
    at = runs(joined)[:-1]
    total = np.add.reduceat(n, at) if len(at) else n
    keep = total > more_than
    return (joined[at[keep]] + np.uint64(base)).astype(np.int64), total[keep]


def frequent_columns(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(column, n): the first COUNTED_BITS bits of shingles in more than FREQUENT documents.

    Every document counts. A task adds up its own texts and sends sorted, packed columns, cut by range, so a shingle
    costs two to three bytes in the shuffle.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    step = -(-(1 << COUNTED_BITS) // parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            packed, counts = packed_columns(held, parts, step)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(parts, dtype=np.int32)), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())],
                names=["part", "columns", "n"])

        for batch in batches:
            for piece in slices(batch, text):
                for one in shingle_sets(piece.column(0), width):
                    held.append(one >> np.uint64(64 - COUNTED_BITS))
                    size += len(one)
                if size > HELD_SHINGLES:
                    yield sent()
                    size = 0
        if size:
            yield sent()
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, columns, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by_part.setdefault(part, []).append((columns, n))
        for part, blobs in by_part.items():
            columns, total = added_columns(blobs, part * step, FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(total)], names=["column", "n"])
        give_back()

    return (
        docs.select(text).mapInArrow(count, "part int, columns binary, n binary")
        .repartition(parts, "part").mapInArrow(add, "column long, n long")
    )


def column_order(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent columns, ascending, and their counts: at most ORDERED_COLUMNS, the most frequent ones."""
    found = staged(frequent_columns(docs, text, width), "columns")
    if found.count() > ORDERED_COLUMNS:
        found = found.orderBy(F.desc("n"), "column").limit(ORDERED_COLUMNS)
    held = found.toArrow()
    columns, n = held["column"].to_numpy().astype(np.uint64), held["n"].to_numpy()
    order = np.argsort(columns)
    return columns[order], n[order].astype(np.int32)


def document_sets(docs: DataFrame, doc_id: str, text: str, width: int, s: Fraction) -> DataFrame:
    """(doc_id, n, set, blocks, first): size, hash and block counts of the set and its first columns in order."""
    shared = docs.sparkSession.sparkContext.broadcast(column_order(docs, text, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        frequent, counts = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, names, blocks, firsts = [], [], [], []
                for one in shingle_sets(part.column(1), width):
                    sizes.append(len(one))
                    with np.errstate(over="ignore"):
                        names.append(int((np.sum(one * (one >> np.uint64(31) | np.uint64(1))) ^ np.sum(one)).astype(np.int64)))
                    blocks.append(np.minimum(np.bincount((one & np.uint64(BLOCKS - 1)).astype(np.int64), minlength=BLOCKS), 255).astype(np.uint8).tobytes())
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, one >> np.uint64(64 - COUNTED_BITS)), len(frequent) - 1)
                        rank = np.where(frequent[at] == one >> np.uint64(64 - COUNTED_BITS), counts[at], 0)
                        one = one[np.argsort(rank, kind="stable")]
                    need = -(-s.numerator * len(one) // s.denominator)
                    firsts.append(one[: len(one) - need + 1].astype(np.int64) if len(one) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(blocks, pa.binary()),
                     pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "n", "set", "blocks", "first"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, set long, blocks binary, first array<long>")


def bounded(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """(a, b) of the pairs of sets whose block counts leave room for enough overlap; a and b are document ids."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BLOCKS) for i in (2, 3))
            n = [batch.column(i).to_numpy() for i in (4, 5)]
            most = np.minimum(one, other).sum(1, dtype=np.int64)
            # A block that is full bounds nothing.
            full = ((one == 255) & (other == 255)).any(1)
            most = np.where(full, np.minimum(*n), most)
            yield batch.filter(pa.array(enough(most, *n, s))).select(["a", "b"])
        give_back()

    left = sets.select(F.col("set").alias("x"), F.col("doc_id").alias("a"), F.col("blocks").alias("one"), F.col("n").alias("n_one"))
    right = sets.select(F.col("set").alias("y"), F.col("doc_id").alias("b"), F.col("blocks").alias("other"), F.col("n").alias("n_other"))
    met = pairs.join(left, "x").join(right, "y").select("a", "b", "one", "other", "n_one", "n_other")
    return met.mapInArrow(keep, "a long, b long")


@dataclass(frozen=True)
class Verifier:
    """Exact overlaps of pairs of documents."""

    docs: DataFrame
    width: int
    s: Fraction

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(id, text) of the documents in the pairs; where an id has several rows, the text whose set stands for it isn't
        known, so all come along and any of them may carry the link."""
        wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return staged(self.docs.join(wanted, self.docs.doc_id == wanted.id, "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that reach the similarity."""
        width, s = self.width, self.s
        texts = self.texts(pairs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in batches:
                for part in slices(batch, "one"):
                    good = []
                    hubs = {}
                    ids = part.column(1).to_pylist()
                    other = part.column(3)
                    mine = shingle_sets(part.column(2), width)
                    for row, one in enumerate(mine):
                        # Neighbouring rows share their second document.
                        if ids[row] not in hubs:
                            hubs = {ids[row]: {}}
                        text = other[row].as_py()
                        if text not in hubs[ids[row]]:
                            hubs[ids[row]][text] = shingle_sets(pa.array([text]), width)[0]
                        two = hubs[ids[row]][text]
                        overlap = len(np.intersect1d(one, two, assume_unique=True))
                        good.append(bool(len(one)) and bool(enough(overlap, len(one), len(two), s)))
                    yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])
            give_back()

        met = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "one"}), "a").join(
            texts.withColumnsRenamed({"id": "b", "text": "two"}), "b").select("a", "b", "one", "two")
        return met.mapInArrow(count, "a long, b long")


@in_small_batches
def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, representative) of every row.

    component_id is the smallest id reachable by links, itself included; representative is the smallest id with the
    same set. Every link between different sets counts, though not every one is listed.
    """
    s = similarity
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = staged(document_sets(docs, "doc_id", "text", width, s), "sets")
    usable = every.where("n > 0 AND doc_id IS NOT NULL")
    # Copies: one row of each set leaves a task.
    sets = staged(usable.groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.first("first").alias("first"),
    ), "distinct")
    # Columns with one set make no pairs and go here; the rows of a column stay in one place for both steps.
    in_column = Window.partitionBy("column")
    shared = sets.select("set", "n", F.posexplode("first").alias("at", "column")).withColumn(
        "k", F.count("*").over(in_column)).where("k > 1").drop("k")
    cells = staged(shared.withColumn("class", F.floor(F.log(F.col("n")) * 10)), "cells")
    p, q = s.numerator, s.numerator + s.denominator
    fits = f"{s.denominator} * least(n, m) >= {p} * greatest(n, m)"

    # Partial products with one member of each column and size class, the one in most columns, added up over the columns.
    degrees = cells.groupBy("set").agg(F.count("*").alias("degree"))
    central = cells.join(degrees, "set").groupBy("column", "class").agg(
        F.max(F.struct("degree", "set", "n")).alias("hub")).select(
        "column", "class", F.col("hub.set").alias("y"), F.col("hub.n").alias("m"))
    stars = (
        cells.join(central, ["column", "class"]).where("set <> y").where(fits)
        .groupBy(F.col("set").alias("x"), "y").agg(F.count("*").alias("overlap"))
    )
    check = Verifier(docs, width, s)
    links = staged(check.linked(staged(bounded(stars, sets, s), "pairs")), "links")
    joined = components(links)
    labelled = sets.join(joined, sets.doc_id == joined.node, "left").select(
        "set", F.coalesce("component", "doc_id").alias("component"))

    # What is left: columns that hold more than one component.
    open_columns = (
        cells.join(labelled, "set").groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("column")
    )
    left = staged(cells.join(open_columns, "column").join(labelled, "set").select("column", "set", "n", "at", "component"), "open")
    right = left.select("column", F.col("set").alias("y"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("component").alias("other"))
    # In the first column that both have, what is left of the smaller order must suffice for the overlap.
    room = f"{q} * least(n - at, m - place) >= {p} * (n + m)"
    rest = (
        left.join(right, "column").where("component < other").where(fits).where(room)
        .groupBy(F.col("set").alias("x"), "y").agg(F.count("*").alias("overlap"))
    )
    more = staged(check.linked(staged(bounded(rest, sets, s), "pairs")), "links")
    final = components(links.unionByName(more)) if not more.isEmpty() else joined
    groups = sets.join(final, sets.doc_id == final.node, "left").select(
        "set", F.col("doc_id").alias("representative"), F.coalesce("component", "doc_id").alias("component_id"))
    known = every.withColumn("set", F.when(F.col("n") > 0, F.col("set")))
    return known.join(groups, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("representative", "doc_id")).alias("representative"),
    )
