"""Phrase mining against plain counting, with collisions, pieces and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from brute import DOCS, lower, odd_documents
from pyspark.sql import functions as F

from palimpsest.llm import collocations


def expected(rows, longest=3, least=10, inside=50, best=2000):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                key = (lang, w[i : i + n])
                longer[key] = max(longer.get(key, 0), a)
    kept = []
    for (lang, w), a in candidates.items():
        if 100 * longer.get((lang, w), -1) >= inside * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], score))
    total = Counter()
    for (lang, w), a in f.items():
        total[lang] += a if len(w) == 1 else 0
    out = []
    for lang in total:
        own = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[5], -x[2], x[1].encode()))[:best]
        out += [(lang, i + 1, p, a, le, r, total[lang], s) for i, (_, p, a, le, r, s) in enumerate(own)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def sentences(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["New", "york", "ñ", "漢字"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " \t "]) for w in words)
        rows.append((i, text, rng.choice(["en", "de", None]), None, 0))
    return rows


@pytest.mark.parametrize(("longest", "bits"), [(3, 64), (3, 9), (4, 64), (2, 12)])
def test_equals_plain_counting(spark, longest, bits):
    rows = sentences(longest, 400)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    want = expected([(r[1], r[2]) for r in rows], longest=longest, best=30)
    assert want and got(collocations.collocations(frame, longest=longest, best=30, bits=bits, chunk_bytes=2000)) == want


def test_odd_rows(spark):
    rows = odd_documents() * 3 + [(1, "A b. a B, a  b\ta b", None, None, 0)] * 6 + [(2, "a b c", "und", None, 0)] * 5
    frame = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit(1)).withColumn("chunk", F.lit(2))
    want = expected([(r[1], r[2]) for r in rows])
    assert {w[2] for w in want if w[0] == "und"} >= {"a b"}
    assert got(collocations.collocations(frame)) == want
    assert got(collocations.collocations(frame, chunk_bytes=100)) == want
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0




def test_ties_and_the_share_of_the_longer_phrase(spark):
    rows = [(0, "p q r", "en", None, 0)] * 10 + [(0, "p q", "en", None, 0)] * 10 + [(0, "x y z", "en", None, 0)] * 10 + [(0, "x y", "en", None, 0)] * 11
    want = expected([(r[1], r[2]) for r in rows])
    phrases = {w[2] for w in want}
    # Half of the occurrences inside the longer one: dropped; a little less: kept.
    assert "p q" not in phrases and "x y" in phrases
    assert got(collocations.collocations(spark.createDataFrame(rows, DOCS))) == want


def packed_chunk(texts):
    data, ends = collocations.normal_bytes(pa.array(texts))
    return zstandard.compress(data.tobytes()), [int(ends[-1])]


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_colliding_fingerprints_part_in_a_chunk(bits):
    texts = ["a b a c. b a, a  b", "x", None, " ", "b\tA b"]
    payload, ends = packed_chunk(texts)
    chunk = collocations.Chunk(payload, ["en"], ends, 3, bits)
    h, counts, pointers = chunk.entries()
    phrase, n, _ = chunk.phrases(pointers)
    found = Counter()
    for p, c in zip(phrase.to_pylist(), counts.tolist()):
        found[p] += c
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\n]", lower(t)):
            w = piece.split()
            for k in range(1, 4):
                want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert found == want and (np.diff(h.astype(object)) >= 0).all()


def test_blocks_of_polynomials_do_not_matter(monkeypatch):
    payload, ends = packed_chunk([" ".join(f"w{i % 7}" for i in range(500))])
    whole = [x.tolist() for x in collocations.Chunk(payload, ["en"], ends, 3).entries()]
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 10)
    assert [x.tolist() for x in collocations.Chunk(payload, ["en"], ends, 3).entries()] == whole
