"""LM scoring: online logistic mixing of hashed-context bit predictors.

A text is its lower-case words and one end. A word is spelled in bytes and a closing space, the end is a closing space
alone; each byte is eight bits. Predictors look up how often a bit was 0 or 1 after a context: the one, two and
four bytes before it, whatever word they belong to, and the whole word before it, each with the bits of the byte so far. The
log odds of the predictors are combined by weights, one set for each gate (place of the bit, trust in the longest
context). Every block of documents starts with equal weights and refines them over its training text, each bit judged
by counts without itself; the blocks' weights, weighed by their curvature, make one set, and all texts are scored with it.
Bits add up to the log probability. Every byte of every text is scored where it stands; bytes that agree in the four bytes
before them and in the word so far form a state, which a block works out once. A token's first four bytes depend on the four
before it, the rest on the word alone, so a block spells its distinct words, and distinct first bytes after distinct bytes before, and not each byte.

All counts come from the training documents, those whose crc32 of the id as text is not 0 modulo 10, and are exact:
for each context and next byte, a block sends the number of its own training text, packed by hash range, and gets back in
the same order how often the corpus goes that way after the context, down to each bit, as a tree in which keys of a context share what they share. So nothing of the counts is
broadcast, their number follows the corpus, and the counts behind a score depend on the text, not on its block. The count of
a word is that of its closing space. Training texts are scored with their own counts among those of the corpus, so their scores
don't compare with the scores of held-out texts.

The rows of a task are put in the order of a hash, ``WINDOW_BYTES`` of text at a time, so that copies side by side part, and
cut into blocks of at most about ``BLOCK_BYTES`` of text, which are written once as words and tokens; a longer text is a block of its own. Hash ranges
are as many as shuffle partitions, each in frames that hold the keys of about ``RANGE_BYTES`` of text, so that a task counts one frame at a time.
A block and a range share a row only if the block has keys there: there are never more rows than blocks times shuffle partitions, nor than keys.
The tokens are shuffled once, packed, to meet the counts; what met is written, and learning and scoring need no other shuffle.

Defined results: NULL and empty texts have the end as their only token; a NULL id counts as empty text, whose remainder is
0; repeated rows count and are scored each; without training tokens N and V are 0; an empty table gives an empty result.
Contexts and words are told apart by 54-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import LOWER, NOT_SPACE, _BASE, _BYTE_VALUES, give_back, mixed, slices, utf8, word_bounds, word_hashes
from palimpsest.plans.staging import staged

FOLDS = 10
# Text that a task puts in order at a time, and text of a block.
WINDOW_BYTES = 28 << 20
BLOCK_BYTES = 28 << 20
# Text for each frame of a hash range.
RANGE_BYTES = 32 << 20
ORDERS = 4
WORD = ORDERS - 1
PRIOR = 0.4
TRUST = (0, 2, 8, 64, 1024)
LEVELS = len(TRUST) + 1
GATES = 8 * LEVELS
RIDGE = 1.0
LARGEST = 0.5
# States for each step of learning, and the least number of steps of a block.
STEP = 2048
LEAST_STEPS = 64
CHUNK = 1 << 14
EVIDENCE = 1 << 12
SLICE = 1 << 19
SPACE = 32
START = 10


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def worded(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of some texts, each with its closing space, after that of the end; and the number of each token in the texts' order."""
    data, offsets = utf8(text)
    low, n, at, runs = LOWER[data], len(offsets) - 1, 0, []
    while at < n:
        end = min(max(int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1, at + 1), n)
        some = low[offsets[at] : offsets[end]]
        starts, ends, owner = word_bounds(some, offsets[at : end + 1] - offsets[at], NOT_SPACE)
        runs.append((starts + offsets[at], (ends - starts).astype(np.int32), (owner + at).astype(np.int32), word_hashes(some, starts, ends)))
        at = end
    columns = list(zip(*runs))
    del runs, data
    word, first = numbered(np.concatenate(columns.pop()))
    owner = np.concatenate(columns.pop())
    sizes, starts = np.concatenate(columns.pop())[first].astype(np.int64), np.concatenate(columns.pop())[first]
    chars = np.full(1 + int((sizes + 1).sum()), SPACE, np.uint8)
    chars[_runs(1 + np.cumsum(sizes + 1) - sizes - 1, sizes)] = low[_runs(starts, sizes)]
    tokens = np.zeros(len(word) + n, np.int32)
    tokens[np.arange(len(word)) + owner] = word + 1
    return chars, tokens


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, in the order in which they come, and where each comes first."""
    coded = pa.array(values).dictionary_encode()
    number = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    for a in range((len(number) - 1) // SLICE * SLICE, -1, -SLICE):
        first[number[a : a + SLICE][::-1]] = np.arange(a, min(a + SLICE, len(number)))[::-1]
    return number, first


class BlockStates:
    """The words of some texts, the states of their bytes, and the distinct (context, byte) keys of these, ascending.

    A token's first four bytes (its head) depend on the four before it; the rest (its tail) on the word alone. So heads and
    words are spelled once each."""

    def __init__(self, text: pa.ChunkedArray | tuple[np.ndarray, np.ndarray], training: np.ndarray):
        chars, self.tokens = worded(text) if isinstance(text, pa.ChunkedArray) else text
        close = np.flatnonzero(chars == SPACE)
        begin = np.concatenate([[0], close[:-1] + 1])
        length = (close - begin + 1).astype(np.int32)
        first, last = np.zeros(len(length), np.uint32), np.zeros(len(length), np.uint32)
        for k in range(4):
            inside = length > k
            first[inside] |= chars[begin[inside] + k].astype(np.uint32) << np.uint32(24 - 8 * k)
            last[inside] |= chars[close[inside] - k].astype(np.uint32) << np.uint32(8 * k)
        shown = np.minimum(length, 4).astype(np.uint8)
        # After an end comes a new text, with its starting bytes before it.
        last[0], shown[0] = START * 0x01010101, 4
        ends = self.tokens == 0
        self.texts = int(ends.sum())
        self.owner = np.cumsum(ends, dtype=np.int32)
        self.owner -= ends
        past = np.concatenate([np.zeros(4, np.int32), self.tokens])
        before, have = last[past[3:-1]], shown[past[3:-1]]
        for k in range(2, 5):
            some = np.flatnonzero(have < 4)
            back = past[some + 4 - k]
            before[some] |= last[back] << (np.uint32(8) * have[some])
            have[some] += shown[back]
        del past, have, ends
        mark = before.astype(np.uint64)
        mark <<= np.uint64(32)
        mark |= first[self.tokens]
        del before
        give_back()
        self.head, begun = numbered(mark)
        heads = mark[begun]
        del mark
        size = length[self.tokens[begun]]
        spot = np.cumsum(length[self.tokens], dtype=np.int64)
        stood = spot[begun] - size
        size = np.minimum(size, 4)
        # Where each word comes first, from its last place on.
        word_stood = np.zeros(len(length), np.int64)
        word_stood[self.tokens[::-1]] = spot[::-1]
        word_stood -= length
        del spot
        give_back()
        up = np.full(max(4, int(length.max())), _BASE, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        # The bytes before and in a head are one number of eight bytes; a state is five of them and its place.
        self.head_state, codes, words, stands, count = [], [], [], [], 0
        for k in range(4):
            some = np.flatnonzero(size > k).astype(np.int32)
            code = heads[some] >> np.uint64(24 - 8 * k) & np.uint64((1 << 40) - 1)
            number, at = numbered(code)
            self.head_state.append((some, number + np.int32(count)))
            code = code[at]
            word = np.full(len(code), k, np.uint64)
            for i in range(k):
                word += _BYTE_VALUES[(code >> np.uint64(8 * (k - i)) & np.uint64(0xFF)).astype(np.int64)] * up[i]
            codes.append(code)
            words.append(word)
            stands.append(stood[some[at]] + k)
            count += len(code)
        give_back()
        # In a tail the four bytes before are in the word, whose beginning and the byte are a state.
        self.tail_size = np.maximum(length - 4, 0)
        at = _runs(begin + 4, self.tail_size)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[chars] * up[_runs(np.zeros(len(length), np.int32), length)], out=sums[1:])
        mark = sums[at]
        mark -= np.repeat(sums[begin], self.tail_size)
        mark += _runs(np.full(len(length), 4, np.int32), self.tail_size).astype(np.uint64)
        del sums
        for a in range(0, len(mark), SLICE):
            mark[a : a + SLICE] = mixed(mark[a : a + SLICE])
        mark ^= chars[at]
        self.tail_state, one, have = np.empty(len(mark), np.int32), [], count
        # A few small tables instead of a large one.
        for k in range(8):
            some = np.flatnonzero(mark & np.uint64(7) == k)
            number, found = numbered(mark[some])
            self.tail_state[some] = number + np.int32(have)
            one.append(some[found])
            have += len(found)
        one = np.concatenate(one)
        owner = np.searchsorted(np.cumsum(self.tail_size), one, "right")
        at, word = at[one], mark[one] ^ chars[at[one]]
        code = chars[at].astype(np.uint64)
        for k in range(1, 5):
            code |= chars[at - k].astype(np.uint64) << np.uint64(8 * k)
        stands = np.concatenate([*stands, word_stood[owner] + at - begin[owner]])
        code, word = np.concatenate([*codes, code]), np.concatenate([mixed(np.concatenate(words)), word])
        del mark, at, number, one, owner, stood, word_stood, codes, words
        give_back()
        # States in the order of the text.
        order = np.argsort(stands)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.head_state = [(some, rank[state]) for some, state in self.head_state]
        self.tail_state = rank[self.tail_state]
        # The state of the closing space: in the tail of a long word, else the last of the head.
        self.long = length > 4
        self.word_close = np.zeros(len(length), np.int32)
        self.word_close[self.long] = self.tail_state[np.cumsum(self.tail_size)[self.long] - 1]
        self.head_close = np.zeros(len(heads), np.int32)
        for some, state in self.head_state:
            self.head_close[some] = state
        weight = training[self.owner].astype(float)
        of_head, of_word = np.bincount(self.head, weight, len(heads)), np.bincount(self.tokens, weight, len(length))
        train = np.zeros(len(order))
        train += np.bincount(self.tail_state, np.repeat(of_word, self.tail_size), len(order))
        for some, state in self.head_state:
            train += np.bincount(state, of_head[some], len(order))
        self.train = train.astype(np.int64)
        # 54 bits of the context, the byte, two bits of the order.
        four, tail = code >> np.uint64(8), (code & np.uint64(0xFF)) << np.uint64(2)
        del code, stands, close, begin, heads, weight, of_head, of_word, rank
        kept, rows, have = [], [], 0
        for k, c in enumerate((four & np.uint64(0xFF) | np.uint64(1 << 40), four & np.uint64(0xFFFF) | np.uint64(2 << 40), four | np.uint64(3 << 40), word)):
            key = mixed(c) >> np.uint64(10) << np.uint64(10) | tail | np.uint64(k)
            # The word contexts of the tails differ from state to state.
            some = count if k == WORD else len(key)
            number, at = numbered(key[:some])
            rows.append(np.concatenate([number, np.arange(len(at), len(at) + len(key) - some, dtype=np.int32)]) + np.int32(have))
            kept += [key[:some][at], key[some:]]
            have += len(at) + len(key) - some
        self.keys = np.concatenate(kept)
        del four, tail, word, key, kept, number, at
        give_back()
        place = np.argsort(self.keys)
        self.keys = self.keys[place]
        rank = np.empty(len(place), np.int32)
        rank[place] = np.arange(len(place))
        self.rows = np.stack([rank[x[order]] for x in rows])
        self.key_train = sum(np.bincount(x, train, len(place)) for x in self.rows).astype(np.int64)
        del rows, place, rank, train
        give_back()

    def cuts(self, parts: int) -> np.ndarray:
        step = -(-(1 << 64) // parts)
        # The keys of a context stay together.
        edges = [min(p * step, (1 << 64) - 1) >> 10 << 10 for p in range(1, parts)]
        return np.concatenate([[0], np.searchsorted(self.keys, np.array(edges, np.uint64)), [len(self.keys)]]).astype(np.int64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of the states over the bytes of each text."""
        heads = np.zeros(len(self.head_close))
        for some, state in self.head_state:
            heads[some] += values[state]
        tails = np.bincount(np.repeat(np.arange(len(self.tail_size)), self.tail_size), values[self.tail_state], len(self.tail_size))
        return np.bincount(self.owner, heads[self.head] + tails[self.tokens], self.texts)

    def per_token(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of the states over the tokens of each text."""
        return np.bincount(self.owner, np.where(self.long[self.tokens], values[self.word_close][self.tokens], values[self.head_close][self.head]), self.texts)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    total = np.cumsum(sizes, dtype=np.int64)
    out = np.repeat((starts - (total - sizes)), sizes)
    out += np.arange(len(out))
    return out


def ways(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each of all keys, ascending, how often its context goes on with its first 0 to 8 bits."""
    out = np.zeros((9, len(keys)), np.int64)
    for bits in range(9):
        node = keys >> np.uint64(10 - bits)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        out[bits] = np.add.reduceat(total, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def branches(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits, the nodes that it leads to in the tree of ascending keys: where they begin, which come second below
    their parent, which first before a second, and which are alone."""
    parent = np.concatenate([[True], keys[1:] >> np.uint64(10) != keys[:-1] >> np.uint64(10)])[: len(keys)]
    for bits in range(1, 9):
        node = keys >> np.uint64(10 - bits)
        new = np.concatenate([[True], node[1:] != node[:-1]])[: len(keys)]
        at = np.flatnonzero(new)
        second = ~parent[at]
        followed = np.concatenate([second[1:], [False]])[: len(at)]
        yield at, second, followed, ~second & ~followed
        parent = new


def own_contexts(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64) << np.uint64(10)


def pack_ways(way: np.ndarray, keys: np.ndarray | None = None) -> bytes:
    """The nine counts of each key as a tree: those of the contexts; where a node goes on both ways, the count of the first; where one
    way, what it loses, if anything. Without keys each has a context of its own."""
    if keys is None:
        keys = own_contexts(way.shape[1])
    context = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(10) != keys[:-1] >> np.uint64(10)])[: len(keys)])
    flags, numbers = [], [way[0, context]]
    for bit, (at, _, followed, alone) in enumerate(branches(keys)):
        lost = way[bit, at[alone]] - way[bit + 1, at[alone]]
        flags.append(lost > 0)
        numbers += [way[bit + 1, at[followed]], lost[lost > 0]]
    return np.packbits(np.concatenate(flags)).tobytes() + pack_numbers(np.concatenate(numbers))


def unpack_ways(raw: bytes, keys: np.ndarray | int) -> np.ndarray:
    if isinstance(keys, int):
        keys = own_contexts(keys)
    levels = list(branches(keys))
    n_flags = sum(int(alone.sum()) for *_, alone in levels)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_flags // 8)), count=n_flags).astype(bool)
    numbers = unpack_numbers(raw[-(-n_flags // 8) :]).view(np.int64)
    new = np.concatenate([[True], keys[1:] >> np.uint64(10) != keys[:-1] >> np.uint64(10)])[: len(keys)]
    number, flag = int(new.sum()), 0
    way = np.empty((len(keys), 9), np.int64)
    value = numbers[:number]
    way[:, 0] = value[np.cumsum(new) - 1]
    for bit, (at, second, followed, alone) in enumerate(levels):
        value = value[np.cumsum(~second) - 1]
        both = np.flatnonzero(followed)
        first, number = numbers[number : number + len(both)], number + len(both)
        value[both + 1] -= first
        value[both] = first
        one = np.flatnonzero(alone)
        less, flag = one[flags[flag : flag + len(one)]], flag + len(one)
        value[less] -= numbers[number : number + len(less)]
        number += len(less)
        way[:, bit + 1] = np.repeat(value, np.diff(at, append=len(keys)))
    return way


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: where a context begins, the bytes, and for each context its order and how far it is from the one before."""
    context = keys >> np.uint64(10)
    new = np.concatenate([[True], context[1:] != context[:-1]])[: len(keys)]
    some = keys[new]
    parts = (np.packbits(new), (keys >> np.uint64(2)).astype(np.uint8), (some & np.uint64(3)).astype(np.uint8))
    return len(keys).to_bytes(8, "little") + b"".join(x.tobytes() for x in parts) + pack_numbers(np.diff(context[new], prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    at = 8 + -(-n // 8)
    new = np.unpackbits(np.frombuffer(raw, np.uint8, at - 8, 8), count=n).astype(bool)
    some = int(new.sum())
    order = np.frombuffer(raw, np.uint8, some, at + n).astype(np.uint64)
    context = np.cumsum(unpack_numbers(raw[at + n + some :]), dtype=np.uint64) << np.uint64(10) | order
    return context[np.cumsum(new) - 1] | np.frombuffer(raw, np.uint8, n, at).astype(np.uint64) << np.uint64(2)


def pack_numbers(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(way: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the bit that came against the other one, and trust, for the eight bits of each key; ``own`` takes one count off."""
    odds, trust = np.empty((len(way), 8), np.float32), np.zeros((len(way), 8), np.int8)
    for a in range(0, len(way), EVIDENCE):
        here = slice(a, a + EVIDENCE)
        some = np.maximum(way[here] - int(own), 0).astype(float)
        right, both = some[:, 1:].copy(), some[:, :8].copy()
        for least in TRUST:
            trust[here] += both > least
        odds[here] = np.log((right + PRIOR) / (both - right + PRIOR))
    return odds, trust


def answered_evidence(states: BlockStates, sizes: list[int], found: pa.Array, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds and trust of all keys from the frames of the answers, and how often the corpus has each."""
    unpack, at, n = zstandard.ZstdDecompressor(), 0, len(states.keys)
    odds, trust, counts = np.empty((n, 8), np.float32), np.empty((n, 8), np.int8), np.empty(n, np.int64)
    for size, frame in zip(sizes, found):
        here = slice(at, at + size)
        way = unpack_ways(unpack.decompress(frame.as_buffer()), states.keys[here])
        odds[here], trust[here] = evidence(way, own)
        counts[here] = way[:, 8]
        at += size
    if at != n:
        raise ValueError(f"{n} keys of a block have {at} answers")
    return odds, trust, counts


def state_evidence(states: BlockStates, odds: np.ndarray, trust: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state and place, order) odds and (state and place) gates of some states."""
    seen = np.stack([odds[states.rows[k, some]] for k in range(ORDERS)], 2)
    gate = trust[states.rows[WORD, some]] + np.arange(8) * LEVELS
    return seen.reshape(-1, ORDERS), gate.ravel()


def equal_weights() -> np.ndarray:
    return np.full((GATES, ORDERS), 1 / ORDERS)


def learned(states: BlockStates, odds: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights refined over the training states in the order of the text, and the curvature that each gate has seen."""
    weights, curve = equal_weights(), np.zeros((GATES, ORDERS, ORDERS))
    rows = np.flatnonzero(states.train)
    if not len(rows):
        return weights, curve
    step = min(STEP, len(rows))
    turns = max(1, -(-LEAST_STEPS * step // len(rows)))
    ridge = RIDGE * np.eye(ORDERS)
    for _ in range(turns):
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            seen, gate = state_evidence(states, odds, trust, some)
            heavy = np.repeat(states.train[some], 8).astype(float)
            order = np.argsort(gate.astype(np.int16), kind="stable")
            seen, gate, heavy = seen[order].astype(float), gate[order], heavy[order]
            p = squash(np.einsum("ij,ij->i", seen, weights[gate]))
            cuts = np.searchsorted(gate, np.arange(GATES + 1))
            pull, bend = seen * ((1 - p) * heavy)[:, None], seen * (p * (1 - p) * heavy)[:, None]
            here = np.flatnonzero(np.diff(cuts))
            for g in here:
                part = slice(cuts[g], cuts[g + 1])
                curve[g] += bend[part].T @ seen[part]
            steps = np.linalg.solve(curve[here] + ridge, np.add.reduceat(pull, cuts[here])[:, :, None])[:, :, 0]
            weights[here] += np.clip(steps, -LARGEST, LARGEST)
    return weights, curve / turns


def joined_weights(curve: np.ndarray, bent: np.ndarray) -> np.ndarray:
    """The weights of all blocks from the sums of their curvatures, and of these times their weights."""
    ridge = RIDGE * np.eye(ORDERS)
    return np.linalg.solve(curve + ridge, (bent + equal_weights() @ ridge)[:, :, None])[:, :, 0]


def state_bits(states: BlockStates, odds: np.ndarray, trust: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits that the mixed model needs for each state."""
    weights = weights.astype(np.float32)
    spent = np.zeros(len(states.train))
    for a in range(0, len(spent), CHUNK):
        some = np.arange(a, min(a + CHUNK, len(spent)))
        seen, gate = state_evidence(states, odds, trust, some)
        z = np.einsum("ij,ij->i", seen, weights[gate]).astype(float)
        spent[some] = (np.maximum(-z, 0) + np.log1p(np.exp(-np.abs(z)))).reshape(-1, 8).sum(1) / np.log(2)
    return spent


def pack_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_rows(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """(block, rows, words, tokens): the rows of a task, a window's worth at a time, put in the order of a hash and cut; their words,
    and which stands where; nothing is shuffled."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number
            some = pa.Table.from_batches(held).sort_by("place").drop_columns("place")
            held.clear()
            ends = utf8(some["text"])[1]
            some = some.append_column("size", pa.array(np.diff(ends)))
            count = max(1, -(-int(ends[-1]) // BLOCK_BYTES))
            # A row belongs to the block where its text ends.
            cuts = np.searchsorted(ends[1:], [int(ends[-1]) * k // count for k in range(1, count)], "right")
            for a, z in zip([0, *cuts], [*cuts, len(some)]):
                if a < z:
                    chars, tokens = worded(some["text"].slice(a, z - a))
                    packed = [pack_rows(some.drop_columns("text").slice(a, z - a)), pack.compress(chars.tobytes()), pack.compress(pack_numbers(tokens))]
                    del chars, tokens
                    give_back()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "rows", "words", "tokens"])
                    number += 1

        size, window = 0, max(WINDOW_BYTES, BLOCK_BYTES)
        for batch in batches:
            for run in slices(batch, "text", max(1, window // 16)):
                more = int(utf8(run.column("text"))[1][-1])
                if held and size + more > window:
                    yield from blocks()
                    size = 0
                held.append(run)
                size += more
        if held:
            yield from blocks()

    return rows.withColumn("place", F.xxhash64("doc_id", "text")).mapInArrow(deal, "block long, rows binary, words binary, tokens binary")


def dealt_states(rows: pa.Scalar, words: pa.Scalar, tokens: pa.Scalar) -> tuple[pa.Table, BlockStates]:
    """The rows of a block but for their texts, and its states."""
    unpack = zstandard.ZstdDecompressor()
    table = unpack_rows(rows)
    spelled = (np.frombuffer(unpack.decompress(words.as_buffer()), np.uint8), unpack_numbers(unpack.decompress(tokens.as_buffer())).astype(np.int32))
    return table, BlockStates(spelled, ~table["held_out"].to_numpy())


def asked_counts(blocks: DataFrame, parts: int, frames: int) -> DataFrame:
    """(block, part, asked, counts): for each range of hashes where a block has keys, its frames of keys and of how often
    the block's training text has each."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, rows, words, tokens in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                _, states = dealt_states(rows, words, tokens)
                cuts = states.cuts(parts * frames)
                some = [p for p in range(parts) if cuts[p * frames] < cuts[(p + 1) * frames]]
                inside = [[slice(cuts[i], cuts[i + 1]) for i in range(p * frames, (p + 1) * frames)] for p in some]
                asked = [[pack.compress(pack_keys(states.keys[z])) for z in one] for one in inside]
                counts = [[pack.compress(pack_numbers(states.key_train[z])) for z in one] for one in inside]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()),
                    pa.array(asked, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.binary()))], names=["block", "part", "asked", "counts"])
                del states, asked, counts
                give_back()

    return blocks.mapInArrow(ask, "block long, part int, asked array<binary>, counts array<binary>")


def answered_counts(asked: DataFrame, tasks: int) -> DataFrame:
    """(block, part, sizes, found, n, v): for each request the corpus counts of its keys; n and v of a range stand in one row."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def opened(frame: pa.Scalar) -> bytes:
            return unpack.decompress(frame.as_buffer())

        for requests in _runs_of(batches, 1):
            n = v = 0
            sizes, found = [[] for _ in range(len(requests))], [[] for _ in range(len(requests))]
            for frame in range(len(requests["asked"][0])):
                lists = [unpack_keys(opened(one[frame])) for one in requests["asked"]]
                counts = np.concatenate([unpack_numbers(opened(one[frame])) for one in requests["counts"]])
                keys, where = np.unique(np.concatenate(lists), return_inverse=True)
                if len(keys):
                    total = np.bincount(where, counts.astype(float)).astype(np.int64)
                    way = ways(keys, total)
                    closing = total[keys & np.uint64(0x3FF) == np.uint64(SPACE << 2 | WORD)]
                    n, v = n + int(closing.sum()), v + int((closing > 0).sum())
                at = 0
                for i, one in enumerate(lists):
                    sizes[i].append(len(one))
                    found[i].append(pack.compress(pack_ways(way[:, where[at : at + len(one)]], one)) if len(one) else b"")
                    at += len(one)
            for i, (block, part) in enumerate(zip(requests["block"].to_pylist(), requests["part"].to_pylist())):
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([sizes[i]], pa.list_(pa.int64())),
                    pa.array([found[i]], pa.list_(pa.binary())), pa.array([n], pa.int64()), pa.array([v], pa.int64()),
                ], names=["block", "part", "sizes", "found", "n", "v"])
                n = v = 0

    return asked.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(
        answer, "block long, part int, sizes array<long>, found array<binary>, n long, v long")


def met_blocks(blocks: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """(rows, words, tokens, sizes, found, n, v, values): each block with the answers on all its keys, and what learning on it gives."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _runs_of(batches, 0):
            # The block comes first, then its answers.
            dealt = [met[c][0] for c in ("rows", "words", "tokens")]
            _, states = dealt_states(*dealt)
            sizes, found = (pa.concat_arrays(met[c].slice(1).chunks).flatten() for c in ("sizes", "found"))
            asked = sizes.to_numpy() > 0
            sizes, found = sizes.filter(pa.array(asked)), found.filter(pa.array(asked))
            odds, trust, _ = answered_evidence(states, sizes.to_pylist(), found, True)
            weights, curve = learned(states, odds, trust)
            values = np.concatenate([curve.ravel(), np.einsum("gij,gj->gi", curve, weights).ravel()])
            n, v = (sum(x for x in met[c].to_pylist() if x is not None) for c in ("n", "v"))
            del states, odds, trust
            give_back()
            yield pa.RecordBatch.from_arrays([
                *(pa.array([x.as_py()], pa.binary()) for x in dealt), pa.ListArray.from_arrays([0, len(sizes)], sizes),
                pa.ListArray.from_arrays([0, len(found)], found), pa.array([n], pa.int64()), pa.array([v], pa.int64()),
                pa.array([values], pa.list_(pa.float64()))], names=["rows", "words", "tokens", "sizes", "found", "n", "v", "values"])
            del met, dealt, sizes, found

    both = blocks.withColumn("part", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    return both.select("block", "part", "sizes", "found", "n", "v", "rows", "words", "tokens").repartition(tasks, "block").sortWithinPartitions(
        "block", "part").mapInArrow(
        meet, "rows binary, words binary, tokens binary, sizes array<long>, found array<binary>, n long, v long, values array<double>")


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frames = max(1, -(-size // (tasks * RANGE_BYTES)))
    blocks = staged(dealt_blocks(rows.withColumn("held_out", held_out(F.col("doc_id")))), "blocks")
    answers = answered_counts(asked_counts(blocks, tasks, frames), tasks)
    met = staged(met_blocks(blocks, answers, tasks), "met")
    sums = met.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = sums["n"] or 0, sums["v"] or 0
    # One row for each number of the gates' matrices and vectors.
    fitted = met.select(F.posexplode("values").alias("place", "value")).groupBy("place").agg(
        F.sum("value").alias("value")).orderBy("place").collect()
    values = np.array([r["value"] for r in fitted]) if fitted else np.zeros(GATES * ORDERS * (ORDERS + 1))
    bends = GATES * ORDERS * ORDERS
    weights = joined_weights(values[:bends].reshape(GATES, ORDERS, ORDERS), values[bends:].reshape(GATES, ORDERS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, tokens, sizes, found in zip(*batch.columns):
                block, states = dealt_states(rows, words, tokens)
                odds, trust, counts = answered_evidence(states, sizes.as_py(), found.values, False)
                counts = counts[states.rows[WORD]]
                base = np.log10((counts + 0.1) / (n_all + 0.1 * (v_all + 1)))
                total = states.per_text(state_bits(states, odds, trust, weights))
                done = pa.table({
                    "doc_id": block["doc_id"], "held_out": block["held_out"],
                    "n_tokens": np.bincount(states.owner, minlength=states.texts),
                    "n_known": states.per_token((counts > 0).astype(float)).astype(np.int64),
                    "train_tokens": np.full(states.texts, n_all), "base_score": states.per_token(base), "score": -total * np.log10(2),
                    "bits_per_byte": total / (block["size"].to_numpy() + 1),
                }).combine_chunks()
                del block, states, odds, trust, counts, base, total
                give_back()
                yield from done.to_batches()

    return met.select("rows", "words", "tokens", "sizes", "found").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _runs_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Runs of rows with one value in a column, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(column).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        for a, b in zip(cuts, cuts[1:]):
            if held and a < b and held[0].column(column)[0].as_py() != value[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
