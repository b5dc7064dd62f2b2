"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

A batch is cut into units that no piece crosses (spaces and the word after them, line ends). The units that are new
are concatenated and indexed by a suffix array, as deep as pieces are long; binary search gives each piece
its range of places, which are the edges of a graph over text positions. Edges are sorted by end and relaxed:
the encoding of a prefix ends in the one piece that stands in the merge order with the last piece of the prefix
before it. That is the encoding of byte-pair models, where the score of a piece is its place in the merge order.
All units of a batch are relaxed side by side.

Defined results: NULL gives NULL, the empty text no pieces; letters without a piece become byte pieces; the meta symbol
U+2581 counts as a space, as in the model; repeated rows are encoded each. Decoding gives the encoded text, control
pieces nothing, bytes that are no UTF-8 the replacement character. A unit costs memory in proportion to
its length; only a text without spaces and line ends is a unit as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.textops import give_back, slices, with_fields

META = "▁"
UNIT = re.compile(rb" +[^ \n]*|\n|[^ \n]+")
DEPTH = 16
# Units remembered by a worker before it starts anew.
REMEMBERED = 250_000
PAIR_BITS = 20
NOTHING = np.int64(1) << np.int64(60)
# Bytes of text that are encoded at once, and bytes of new units that are indexed at once.
BATCH_BYTES = 1 << 20
LEARN_BYTES = 256 << 10


class Model:
    """Pieces of a byte-pair model with byte fallback, spaces instead of the meta symbol."""

    def __init__(self, proto: bytes):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = held.get_piece_size()
        self.text: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_id = [0] * 256
        for i in range(self.size):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
                self.text.append(" ⁇ ".encode() if held.is_unknown(i) else b"")
            else:
                plain = piece.replace(META, " ")
                self.text.append(plain.encode())
                self.ids[plain] = i
                self.rank[plain] = -held.get_score(i)
        if any("\n" in p or " " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece goes over a line end or has a space after other letters")
        self.order_merges()
        flat = b"".join(self.text)
        sizes = np.array([len(t) for t in self.text])
        self.flat, self.sizes, self.begins = np.frombuffer(flat, np.uint8), sizes, np.cumsum(sizes) - sizes
        self.search = sorted((p.encode(), i) for p, i in self.ids.items())
        self.keys = np.frombuffer(b"".join(p[:DEPTH].ljust(DEPTH, b"\0") for p, _ in self.search), ">u8").reshape(-1, 2).astype(np.uint64)
        self.last_keys = np.frombuffer(b"".join(p[:DEPTH].ljust(DEPTH, b"\xff") for p, _ in self.search), ">u8").reshape(-1, 2).astype(np.uint64)
        self.lengths = np.array([len(p) for p, _ in self.search])
        self.numbers = np.array([i for _, i in self.search])
        self.forget()

    def forget(self) -> None:
        self.units: dict[bytes, int] = {}
        self.unit_flat, self.unit_begins, self.unit_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def last_merge(self, text: str) -> tuple[str, str] | None:
        """The two parts that are merged last when the best neighbours are merged again and again; None if that isn't the whole."""
        parts = list(text)
        while len(parts) > 2:
            ranked = [(self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(ranked)
            if best == np.inf:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if parts[0] in self.ids and parts[1] in self.ids else None

    def order_merges(self) -> None:
        """For each piece its place in the merge order and its last two parts; for each pair of pieces what it merges to."""
        v = self.size + 2
        self.place = np.full(v, -1, np.int64)
        self.left, self.right = np.zeros(v, np.int64), np.zeros(v, np.int64)
        self.made = np.zeros(v, bool)
        pairs = {}
        for text, i in self.ids.items():
            if len(text) == 1:
                self.made[i] = True
                continue
            self.place[i] = int(self.rank[text])
            parts = self.last_merge(text)
            if parts:
                self.made[i], self.left[i], self.right[i] = True, self.ids[parts[0]], self.ids[parts[1]]
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * v + b] = int(self.rank[text])
        # A table of pairs by the top bits of a product; a place that is taken leads to the next one.
        self.pairs, self.pair_place = np.full(1 << PAIR_BITS, -1, np.int64), np.full(1 << PAIR_BITS, NOTHING)
        self.probes = 1
        for key, slot in zip(pairs, self.slots(np.array(list(pairs), np.int64)).tolist()):
            steps = 1
            while self.pairs[slot] >= 0:
                slot, steps = (slot + 1) & ((1 << PAIR_BITS) - 1), steps + 1
            self.pairs[slot], self.pair_place[slot] = key, pairs[key]
            self.probes = max(self.probes, steps)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def merges(self, keys: np.ndarray) -> np.ndarray:
        """The place in the merge order of what the pairs merge to, or NOTHING."""
        slot = self.slots(keys)
        found = np.where(self.pairs[slot] == keys, self.pair_place[slot], NOTHING)
        open_ = np.flatnonzero((self.pairs[slot] >= 0) & (self.pairs[slot] != keys))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << PAIR_BITS) - 1)
            held = self.pairs[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.pair_place[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def stand_together(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the second piece follows the first in an encoding; the number ``size`` stands for the beginning.

        The merges next to the border are undone, the latest first. Before each of them the two pieces at the border
        must not have a better merge, nor an equally good one further left.
        """
        v = self.size + 2
        good = self.made[second] & (self.made[first] | (first >= self.size))
        at = np.flatnonzero(good & (first < self.size))
        one, two, limit = first[at], second[at], np.full(len(at), NOTHING)
        while len(at):
            broken = self.merges(one * v + two) < limit
            good[at[broken]] = False
            p1, p2 = self.place[one], self.place[two]
            keep = ~broken & (np.maximum(p1, p2) >= 0)
            at, one, two, p1, p2 = at[keep], one[keep], two[keep], p1[keep], p2[keep]
            undo = p1 > p2
            limit = np.where(undo, p1, p2 + 1)
            one, two = np.where(undo, self.right[one], one), np.where(undo, two, self.left[two])
        return good

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, piece) of every place of every piece, from the suffix array of ``data``."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(2 * DEPTH, np.uint8)])
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8]).view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((eight[8 : n + 8], eight[:n]))
        head, rest = eight[:n][order], eight[8 : n + 8][order]
        low = np.searchsorted(head, self.keys[:, 0], "left")
        high = np.searchsorted(head, self.last_keys[:, 0], "right")
        for row in np.flatnonzero((self.lengths > 8) & (high > low)):
            a, b = low[row], high[row]
            low[row] = a + np.searchsorted(rest[a:b], self.keys[row, 1], "left")
            high[row] = a + np.searchsorted(rest[a:b], self.last_keys[row, 1], "right")
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        begins = order[np.arange(len(which)) + np.repeat(low - (np.cumsum(counts) - counts), counts)]
        keep = np.ones(len(which), bool)
        for row in np.flatnonzero((self.lengths > DEPTH) & (counts > 0)):
            tail = np.frombuffer(self.search[row][0][DEPTH:], np.uint8)
            for k in np.flatnonzero(which == row):
                at = begins[k] + DEPTH
                keep[k] = np.array_equal(padded[at : at + len(tail)], tail)
        which, begins = which[keep], begins[keep]
        return begins, self.lengths[which], self.numbers[which]

    def learn(self, units: list[bytes]) -> None:
        """Encode units that are new and remember them."""
        data = np.frombuffer(b"\n".join(units) + b"\n", np.uint8)
        sizes = np.array([len(u) for u in units])
        firsts = np.cumsum(sizes + 1) - (sizes + 1)
        # Lone line ends are units of their own; they have no edges but the one of their byte.
        begin, length, piece = self.edges(data)
        letters = (data & 0xC0) != 0x80
        at = np.flatnonzero(letters)
        size = np.diff(np.append(at, len(data)))
        single = np.zeros(len(data), bool)
        next_letter = np.zeros(len(data) + 1, np.int64)
        next_letter[at] = at + size
        single[begin[begin + length == next_letter[begin]]] = True
        owner = np.repeat(np.arange(len(units)), sizes + 1)
        lone = at[~single[at]]
        lone = lone[lone - firsts[owner[lone]] < sizes[owner[lone]]]
        begin = np.concatenate([begin, lone])
        length = np.concatenate([length, next_letter[lone] - lone])
        piece = np.concatenate([piece, np.full(len(lone), self.size + 1)])
        end = begin + length
        step = end - firsts[owner[begin]]
        # A stable sort of small numbers takes linear time.
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        begin, end, piece, step = begin[order], end[order], piece[order], step[order]
        last, came = np.full(len(data) + 1, -1), np.full(len(data) + 1, -1)
        last[firsts] = self.size  # of a unit that is empty so far
        cuts = np.searchsorted(step, np.arange(1, (step.max() if len(step) else 0) + 2))
        for a, b in zip(cuts, cuts[1:]):
            b0, e0, p0 = begin[a:b], end[a:b], piece[a:b]
            before = last[b0]
            reached = before >= 0
            b0, e0, p0, before = b0[reached], e0[reached], p0[reached], before[reached]
            # After a letter without a piece nothing merges: what follows begins anew.
            good = p0 > self.size
            known = ~good
            good[known] = self.stand_together(np.minimum(before, self.size)[known], p0[known])
            last[e0[good]], came[e0[good]] = p0[good], b0[good]
        # Back from the ends of all units at once.
        unit, at = np.arange(len(units)), firsts + sizes
        found_unit, found_piece, found_at = [], [], []
        while len(unit):
            found_unit.append(unit)
            found_piece.append(last[at])
            found_at.append(came[at])
            at = came[at]
            more = at > firsts[unit]
            unit, at = unit[more], at[more]
        rows, numbers, places = map(np.concatenate, (found_unit, found_piece, found_at))
        order = np.lexsort((places, rows))
        rows, numbers, places = rows[order], numbers[order], places[order]
        unknown = numbers > self.size
        if unknown.any():
            wide = np.where(unknown, next_letter[places] - places, 1)
            index = np.repeat(np.arange(len(rows)), wide)
            inner = np.arange(len(index)) - np.repeat(np.cumsum(wide) - wide, wide)
            byte_ids = np.array(self.bytes_id)[data[np.minimum(places[index] + inner, len(data) - 1)]]
            numbers = np.where(unknown[index], byte_ids, numbers[index])
            rows = rows[index]
        counts = np.bincount(rows, minlength=len(units))
        base = len(self.unit_flat)
        known = len(self.units)
        self.units.update((u, known + k) for k, u in enumerate(units))
        self.unit_flat = np.concatenate([self.unit_flat, numbers.astype(np.int32)])
        self.unit_begins = np.concatenate([self.unit_begins, base + np.cumsum(counts) - counts])
        self.unit_sizes = np.concatenate([self.unit_sizes, counts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All piece numbers after one another, and how many each text has."""
        cut = [UNIT.findall(b" " + t.replace(META, " ").encode()) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.units))
        if len(self.units) + len(new) > REMEMBERED and self.units:
            self.forget()
            new = list(set().union(*cut))
        ends = np.cumsum([len(u) + 1 for u in new])
        cuts = [0]
        while cuts[-1] < len(new):
            begun = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, begun + LEARN_BYTES, "right"))))
            self.learn(new[cuts[-2] : cuts[-1]])
        per_text = np.array([len(u) for u in cut])
        index = np.fromiter(map(self.units.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        sizes = self.unit_sizes[index]
        total = np.cumsum(sizes)
        where = np.repeat(self.unit_begins[index] - (total - sizes), sizes) + np.arange(int(sizes.sum()))
        ends = np.concatenate([[0], total])[np.cumsum(per_text)]
        return self.unit_flat[where], np.diff(np.concatenate([[0], ends]))

    def decode(self, numbers: np.ndarray, counts: np.ndarray) -> list[str]:
        sizes = self.sizes[numbers]
        total = np.cumsum(sizes)
        where = np.repeat(self.begins[numbers] - (total - sizes), sizes) + np.arange(int(sizes.sum()))
        data = self.flat[where].tobytes()
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        parts = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        return [(p[1:] if p[:1] == b" " else p).decode("utf-8", "replace") for p in parts]


_loaded: dict[int, Model] = {}


def loaded(proto: bytes) -> Model:
    """One model for each worker."""
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(proto)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """The bytes of a model file on the driver; they travel to the executors, which don't need the file."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_path: str, *, text: str = "text", out: str = "_pieces", decoded: str | None = None) -> DataFrame:
    """``docs`` with the piece numbers of the text, and with ``decoded`` also the text that they decode to, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    docs = docs.drop(out, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers of earlier stages go on here.
        give_back()
        model = loaded(shared.value)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                numbers, counts = model.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                missing = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32()), mask=missing)
                arrays, names = [*part.columns, lists], [*part.schema.names, out]
                if decoded:
                    arrays.append(pa.array(model.decode(numbers, counts), pa.string(), mask=missing.to_numpy(zero_copy_only=False)))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()

    return docs.mapInArrow(run, with_fields(docs, f"{out} array<int>" + (f", {decoded} string" if decoded else "")))


def decode(encoded: DataFrame, model_path: str, *, pieces: str = "_pieces", out: str = "_decoded") -> DataFrame:
    """``encoded`` with the text of the piece numbers."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    encoded = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value)
        for batch in batches:
            at = 0
            lists = batch.column(batch.schema.get_field_index(pieces))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                begun = ends[at - 1] if at else 0
                size = max(1, int(np.searchsorted(ends, begun + (1 << 20), "right")) - at)
                part = batch.slice(at, size)
                column = part.column(part.schema.get_field_index(pieces))
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = model.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                held = pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, held], names=[*part.schema.names, out])
                at += size

    return encoded.mapInArrow(run, with_fields(encoded, f"{out} string"))
