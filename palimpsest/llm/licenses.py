"""License scans: fuzzy search for short notices.

A notice of n letters with at most k edits is cut into k + 1 pieces. Wherever it stands with at most k edits, one
piece stands unchanged, so an exact search for the pieces finds every place; the bounded-error matching of
the regex library then verifies the window around it and counts the edits. Texts are compared as lower-case words
with one space between, so line breaks and punctuation are no edits.

Defined results: NULL and empty texts have no words and no hits; places of one notice that overlap count once,
the one with fewest edits; repeated rows are scanned each; an empty table gives an empty result. Work and memory
are linear in the text: every window has a fixed size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.textops import LETTERS, LOWER, slices, with_fields


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int


# The exact phrases that count as base places, with their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "under the gnu general public license", 3),
    Notice("gpl", "gnu general public license version", 3),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license version", 3),
    Notice("cc-by", "licensed under cc by 4 0", 1),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 1),
    Notice("cc", "creative commons attribution", 3),
)
HITS = "array<struct<label:string,notice:string,first_word:long,last_word:long,edits:int,likeness:double>>"

_WORD_BYTES = bytes(int(LOWER[b]) if LETTERS[LOWER[b]] else 32 for b in range(256))


def words_line(text: str | None) -> tuple[bytes, int]:
    """`` w1 w2 ... wn `` and n."""
    words = (text or "").encode().translate(_WORD_BYTES).split()
    return b" " + b" ".join(words) + b" ", len(words)


def pieces(phrase: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` pieces of about equal length with their places."""
    cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def compiled(notice: Notice) -> tuple[bytes, list[tuple[int, bytes]], regex.Pattern]:
    phrase = f" {notice.words} ".encode()
    # The spaces at both ends are not open to edits, so a match holds whole words.
    pattern = b"(?b) (?:" + regex.escape(notice.words.encode(), special_only=True) + b"){e<=%d} " % notice.errors
    return phrase, pieces(phrase, notice.errors), regex.compile(pattern)


def every_place(where: bytes, what: bytes) -> Iterator[int]:
    at = where.find(what)
    while at >= 0:
        yield at
        at = where.find(what, at + 1)


def fuzzy_spans(line: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(begin, end, edits) of the places in ``line`` that hold the notice, none overlapping another."""
    phrase, parts, pattern = compiled(notice)
    found, seen = set(), set()
    for offset, part in parts:
        for at in every_place(line, part):
            begin = max(0, at - offset - notice.errors - 1)
            if begin in seen:
                continue
            seen.add(begin)
            window = line[begin : at - offset + len(phrase) + notice.errors + 1]
            match = pattern.search(window)
            if match:
                found.add((sum(match.fuzzy_counts), begin + match.start(), begin + match.end()))
    kept: list[tuple[int, int, int]] = []
    last = -1
    # Fewest edits first within a run of overlapping places.
    run: list[tuple[int, int, int]] = []
    for edits, begin, end in sorted(found, key=lambda x: (x[1], x[2])):
        if run and begin >= last - 1:
            kept.append(min(run))
            run = []
        run.append((edits, begin, end))
        last = max(last, end) if len(run) > 1 else end
    if run:
        kept.append(min(run))
    return [(begin, end, edits) for edits, begin, end in kept]


def scan_text(text: str | None, notices: Sequence[Notice]) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base places, fuzzy places."""
    line, n_words = words_line(text)
    base = [(label, words, at, at + len(words) + 2, 0)
            for label, words in BASE for at in every_place(line, f" {words} ".encode())]
    fuzzy = [(n.label, n.words, *span) for n in notices for span in fuzzy_spans(line, n)]
    # One running count of words over all places, in their order.
    first_words, words_before, counted = {}, 0, 0
    for begin in sorted({hit[2] for hit in base + fuzzy}):
        words_before += line.count(b" ", counted, begin)
        first_words[begin], counted = words_before, begin

    def place(label, words, begin, end, edits):
        first = first_words[begin]
        return {"label": label, "notice": words, "first_word": first, "last_word": first + line.count(b" ", begin + 1, end - 1),
                "edits": edits, "likeness": 1 - edits / len(words)}

    return n_words, [place(*hit) for hit in base], [place(*hit) for hit in fuzzy]


def scan_licenses(docs: DataFrame, *, text: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """``docs`` with _n_words, _base and _fuzzy, the places of base phrases and of notices within their edits."""
    docs = docs.drop("_n_words", "_base", "_fuzzy")
    notices = tuple(notices)
    schema = with_fields(docs, f"_n_words long, _base {HITS}, _fuzzy {HITS}")
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()),
                               ("last_word", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n, base, fuzzy = [], [], []
                for value in part.column(part.schema.get_field_index(text)):
                    a, b, c = scan_text(value.as_py(), notices)
                    n.append(a)
                    base.append(b)
                    fuzzy.append(c)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n, pa.int64()), pa.array(base, kind), pa.array(fuzzy, kind)],
                    names=[*part.schema.names, "_n_words", "_base", "_fuzzy"],
                )

    return docs.mapInArrow(scan, schema)
