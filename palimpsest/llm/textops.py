"""Text columns as arrays of bytes, for work inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
# Spark fills an Arrow batch with 10,000 rows or 64 MB, and grows its columns by doubling them outside the heap.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
# Words between white space, and words of letters, digits and everything beyond ASCII.
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
LETTERS = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))

_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and more columns after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another, and where each begins and the last ends; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each run of bytes that are ``inside``; no run goes over a text's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    held = inside[data]
    begins, ends = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    ends[:-1] &= ~held[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = held[cuts]
    ends[cuts - 1] = held[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_BASE, _INVERSE)):
        have = len(_powers[k])
        if have < n:
            more = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
            more[0] = 1
            _powers[k] = np.multiply.accumulate(more)
    return _powers[0], _powers[1]


def in_small_batches(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The jobs that ``run(docs, ...)`` itself starts hand rows to Python in Arrow batches of about BATCH_BYTES, where the session
    has no setting of its own."""
    @wraps(run)
    def run_in_small_batches(docs: DataFrame, *args, **how) -> DataFrame:
        conf = docs.sparkSession.conf
        if conf.get(BATCH_SETTING, None) is not None:
            return run(docs, *args, **how)
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
        try:
            return run(docs, *args, **how)
        finally:
            conf.unset(BATCH_SETTING)

    return run_in_small_batches


def give_back() -> None:
    """Return to the system what earlier work left in this worker: cached powers, Arrow's pool, and freed heap where the C library can."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes wherever they stand."""
    up, down = _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words on end, with their text; a shorter text is one shingle of all its words."""
    n = len(words) - width + 1
    full = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if n > 0:
        whole = text[:n] == text[width - 1 :]
        full = np.zeros(n, np.uint64)
        for k in range(width):
            full += words[k : k + n] * _POSITION[k]
        full, owner = mixed(full[whole]), text[:n][whole]
    texts, first, count = np.unique(text, return_index=True, return_counts=True)
    short = count < width
    if short.any():
        extra = np.zeros(int(short.sum()), np.uint64)
        for row, (begin, size) in enumerate(zip(first[short], count[short])):
            extra[row] = np.sum(words[begin : begin + size] * _POSITION[width : width + size]) + np.uint64(size)
        full = np.concatenate([full, mixed(extra)])
        owner = np.concatenate([owner, texts[short]])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, owner
