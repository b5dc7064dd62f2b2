"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are packed into chunks: lower case, one space between words, texts of one language side by side. For every n-gram of a chunk prefix
polynomials give a fingerprint (seeded with the language). The occurrences of a fingerprint in a chunk are one entry with their number
and a pointer to the first one; words are numbered exactly, and an occurrence whose words differ from those at the pointer gets an
entry of its own. Sorted entries are cut by ranges of fingerprints, packed and shuffled; a range adds up the counts and returns the
pointers of fingerprints that are frequent. Only these phrases are read from the chunk's text, so the last sum is
by the words themselves: fingerprints that collide across chunks part there, and rare phrases are never written out.

A chunk and a range of fingerprints meet in one row at most, and only where there is something to send, so rows stay below the number of n-grams.

A candidate phrase (2 to ``longest`` words, at least ``least`` times) is cut in two at each place; a cut scores
floor(SCALE * a * a / (l * r)) in whole numbers, and the lowest cut counts (ties: the first). Candidates inside a longer candidate that
has at least ``inside`` of 100 of their occurrences are dropped. The best of a language are picked in two steps.

Defined results: NULL texts are empty; a NULL language is ``und`` and one with it; repeated rows count each; an empty table gives no
rows; ties are ordered by the phrase's bytes, so ranks are unique. A text must fit in a task, at some 40 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.textops import LOWER, SLICE_BYTES, mixed, slices, utf8, word_bounds, word_hashes
from palimpsest.plans.staging import staged

LONGEST = 3
LEAST = 10
INSIDE = 50
BEST = 2000
SCALE = 1_000_000
NO_LANG = "und"
CHUNK_BYTES = 2 << 20
# Text whose polynomials are held at once.
BLOCK_BYTES = 1 << 20
# Ranges of fingerprints for each shuffle partition; one is in memory at a time.
RANGES = 8
# Steps in which the best of a language are picked.
SALTS = 32

_BYTES = np.arange(256)
BETWEEN_PIECES = np.isin(_BYTES, np.frombuffer(b".,;:!?", np.uint8)) | ((_BYTES >= 10) & (_BYTES <= 13))
SPACE = (_BYTES == 32) | (_BYTES == 9)
IN_WORD = ~(BETWEEN_PIECES | SPACE)
NEW_LINE = np.uint8(10)


def normal_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with single spaces, each ended by a line feed, and where each begins and the last ends."""
    data, offsets = utf8(column)
    low = LOWER[data]
    space = SPACE[low]
    low[space] = 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(low)]] = True
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return np.insert(low[keep], ends[1:], NEW_LINE), ends + np.arange(len(ends))


def pack_chunks(docs: DataFrame, text: str, lang: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, langs, ends, n_words, payload): texts by language, where each language ends, and its words."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        held: dict[str, list[np.ndarray]] = {}
        size = number = 0

        def sent() -> pa.RecordBatch:
            nonlocal held, size, number
            langs = sorted(held)
            parts = [np.concatenate(held[x]) for x in langs]
            n_words = [len(word_bounds(p, np.array([0, len(p)]), IN_WORD)[0]) for p in parts]
            chunk = (TaskContext.get().partitionId() << 32) + number
            out = pa.RecordBatch.from_arrays([
                pa.array([chunk]), pa.array([langs], pa.list_(pa.string())), pa.array([np.cumsum([len(p) for p in parts])], pa.list_(pa.int64())),
                pa.array([n_words], pa.list_(pa.int64())), pa.array([squeeze.compress(np.concatenate(parts).tobytes())], pa.binary()),
            ], names=["chunk", "langs", "ends", "n_words", "payload"])
            held, size, number = {}, 0, number + 1
            return out

        for batch in batches:
            for piece in slices(batch, "text", min(chunk_bytes // 4, SLICE_BYTES)):
                data, offsets = normal_bytes(piece.column(0))
                names = piece.column(1).to_pylist()
                cuts = np.flatnonzero(np.array([a != b for a, b in zip(names, names[1:])], bool)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                    held.setdefault(names[a], []).append(data[offsets[a] : offsets[z]])
                size += len(data)
                if size >= chunk_bytes:
                    yield sent()
        if size:
            yield sent()

    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit(NO_LANG)).alias("lang"))
    return rows.mapInArrow(pack, "chunk long, langs array<string>, ends array<long>, n_words array<long>, payload binary")


class Chunk:
    """The words of a chunk: their bytes, exact numbers, and how many words of the same piece follow each."""

    def __init__(self, payload: bytes, langs: list[str], ends: list[int], longest: int, bits: int = 64):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
        self.langs, self.longest, self.unused = langs, longest, np.uint64(64 - bits)
        self.starts, self.ends, _ = word_bounds(self.data, np.array([0, len(self.data)]), IN_WORD)
        self.lang = np.searchsorted(np.array(ends), self.starts, "right")
        if len(self.starts):
            # Words of one piece have nothing but a space between them.
            apart = self.starts[1:] - self.ends[:-1] > 1
            apart |= self.data[self.ends[:-1]] != 32
            pieces = np.concatenate([[0], np.cumsum(apart)])
            last = np.searchsorted(pieces, pieces, "right") - 1
            self.follow = np.minimum(last - np.arange(len(pieces)), longest - 1)
        else:
            self.follow = np.zeros(0, np.int64)

    def word_numbers(self) -> np.ndarray:
        """Equal numbers for equal words only."""
        n = len(self.starts)
        gaps = np.zeros(2 * n + 1, np.int64)
        gaps[: 2 * n : 2], gaps[1 : 2 * n : 2] = self.starts, self.ends
        # Every second value is a word; those between are what stands between words.
        gaps[2 * n] = len(self.data)
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(gaps), pa.py_buffer(self.data)])
        return both.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode().indices.to_numpy()

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all n-grams: fingerprint and first word."""
        at = np.flatnonzero(self.follow >= n - 1)
        found = np.zeros(len(at), np.uint64)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)
        begin = 0
        while begin < len(at):
            low = int(self.starts[at[begin]])
            end = max(begin + 1, int(np.searchsorted(self.starts[at], low + BLOCK_BYTES)))
            words = at[begin:end]
            high = int(self.ends[words[-1] + n - 1])
            found[begin:end] = word_hashes(self.data[low:high], self.starts[words] - low, self.ends[words + n - 1] - low)
            begin = end
        return mixed(found ^ seeds[self.lang[at]]) >> self.unused << self.unused, at

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending fingerprints of all lengths, the number of occurrences, and the pointer: first word times longest, plus length less one."""
        numbers = self.word_numbers()
        prints, counts, pointers = [], [], []
        for n in range(1, self.longest + 1):
            h, at = self.fingerprints(n)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            shown = at[first][group]
            differs = np.zeros(len(at), bool)
            for k in range(n):
                differs |= numbers[at + k] != numbers[shown + k]
            differs |= self.lang[at] != self.lang[shown]
            counts.append(np.bincount(group[~differs], minlength=len(first)))
            prints.append(h[first])
            pointers.append(at[first] * self.longest + n - 1)
            # Other words with the fingerprint of those at the pointer: an entry each.
            prints.append(h[differs])
            counts.append(np.ones(int(differs.sum()), np.int64))
            pointers.append(at[differs] * self.longest + n - 1)
        if not prints:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.concatenate(prints)
        order = np.argsort(h, kind="stable")
        return h[order], np.concatenate(counts)[order], np.concatenate(pointers)[order]

    def phrases(self, pointers: np.ndarray) -> tuple[pa.Array, np.ndarray, list[str]]:
        """The words at the pointers, their number, and their language."""
        at, n = pointers // self.longest, pointers % self.longest + 1
        begins, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], size)
        text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.data[places]))
        return text.cast(pa.string()), n, [self.langs[i] for i in self.lang[at].tolist()]


def packed(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind)[:, 0]


def frequent_pointers(chunks: DataFrame, longest: int, least: int, bits: int = 64) -> DataFrame:
    """(chunk, pointers, counts): packed entries of fingerprints that occur at least ``least`` times in all chunks."""
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = parts * RANGES
    step = -(-(1 << 64) // ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, langs, ends, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "langs", "ends", "payload"))):
                h, counts, pointers = Chunk(payload, langs, ends, longest, bits).entries()
                borders = np.array([min(r * step, (1 << 64) - 1) for r in range(1, ranges)], np.uint64)
                cuts = np.concatenate([[0], np.searchsorted(h, borders), [len(h)]])
                held = []
                for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    z = slice(int(cuts[r]), int(cuts[r + 1]))
                    held.append((r, chunk, packed(np.diff(h[z], prepend=np.uint64(r * step)), "<u8"), packed(counts[z], "<u4"), packed(pointers[z], "<u8")))
                    if len(held) == 64:
                        yield rows(held)
                        held = []
                if held:
                    yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        r, chunk, *blobs = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(chunk, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]],
                                          names=["range", "chunk", "prints", "counts", "pointers"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settled() -> Iterator[pa.RecordBatch]:
            prints = [np.cumsum(unpacked(b[1], "<u8"), dtype=np.uint64) + np.uint64(now * step) for b in held]
            counts = [unpacked(b[2], "<u4") for b in held]
            every = np.concatenate(prints)
            order = np.argsort(every, kind="stable")
            ordered, n = every[order], np.concatenate(counts)[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            frequent = ordered[first][np.add.reduceat(n, first) >= least]
            del every, order, ordered, n
            for (chunk, _, _, pointers), h, c in zip(held, prints, counts):
                place = np.searchsorted(frequent, h)
                chosen = place < len(frequent)
                chosen[chosen] = frequent[place[chosen]] == h[chosen]
                if chosen.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([packed(unpacked(pointers, "<u8")[chosen], "<u8")], pa.binary()),
                         pa.array([packed(c[chosen], "<u4")], pa.binary())], names=["chunk", "pointers", "counts"])

        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now and held:
                    yield from settled()
                    held = []
                now = r
                held.append(row)
        if held:
            yield from settled()

    entries = chunks.select("chunk", "langs", "ends", "payload").mapInArrow(
        send, "range long, chunk long, prints binary, counts binary, pointers binary")
    return entries.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(
        answer, "chunk long, pointers binary, counts binary")


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                     bits: int = 64, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f): every phrase of at most ``longest`` words that occurs at least ``least`` times in its language, and (lang, n).

    Fewer ``bits`` of a fingerprint cost more collisions, never a result.
    """
    chunks = staged(pack_chunks(docs, text, lang, chunk_bytes), "chunks")
    totals = chunks.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(
        F.sum("x.n_words").alias("n"))
    found = staged(frequent_pointers(chunks, longest, least, bits), "pointers").groupBy("chunk")

    def read(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        langs, ends, payload = (left.column(c)[0].as_py() for c in ("langs", "ends", "payload"))
        held = Chunk(payload, langs, ends, longest)
        pointers = np.concatenate([unpacked(b, "<u8") for b in right.column("pointers").to_pylist()]).astype(np.int64)
        counts = np.concatenate([unpacked(b, "<u4") for b in right.column("counts").to_pylist()])
        phrase, n, names = held.phrases(pointers)
        return pa.Table.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.int32)), phrase, pa.array(counts.astype(np.int64))], schema=kinds)

    phrases = chunks.select("chunk", "langs", "ends", "payload").groupBy("chunk").cogroup(found).applyInArrow(
        read, "lang string, words int, phrase string, f long")
    summed = phrases.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return staged(summed, "phrases"), totals


def scored_candidates(phrases: DataFrame, *, inside: int = INSIDE) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the candidates that stay."""
    candidates = phrases.where("words >= 2").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cut = candidates.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "words", "phrase", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    # A part of a frequent phrase is frequent itself, so both are found.
    with_left = cut.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    with_both = with_left.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # Exact: a is at most l and r, so the quotient is at most SCALE; the products need 38 digits.
    score = F.expr(f"CAST(CAST({SCALE} AS decimal(7,0)) * CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)) AS decimal(38,0)) "
                   "div CAST(CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)) AS decimal(38,0))")
    lowest = staged(with_both.withColumn("score", score), "cuts").groupBy("lang", "words", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every run of words of a candidate that is a candidate itself.
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))
    within = candidates.where("words >= 3").select("lang", F.explode(F.array_distinct(runs)).alias("phrase"), F.col("a").alias("longer"))
    most = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    return kept.select("lang", "words", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 inside: int = INSIDE, best: int = BEST, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language."""
    phrases, totals = frequent_phrases(docs, text=text, lang=lang, longest=longest, least=least, **how)
    scored = staged(scored_candidates(phrases, inside=inside), "scored")
    in_order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*in_order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*in_order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
