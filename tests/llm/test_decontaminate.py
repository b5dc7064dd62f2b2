"""Decontamination against plain Python: windows, short items, spans, both ways to meet the windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from brute import DOCS, lower, odd_documents
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate
from palimpsest.llm.queries import QUERIES

ITEMS = "item_id long, text string, source string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower(text))


def hit_words(text, items, width):
    """The numbers of the words inside windows, and the items met."""
    w, covered, met = words(text), set(), set()
    for item_id, item, *_ in items:
        own = words(item)
        windows = {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()
        for window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    covered |= set(range(i, i + len(window)))
                    if item_id is not None:
                        met.add(str(item_id))
    return covered, met


def expected(rows, items, width=10):
    out = []
    for doc_id, text, *_ in rows:
        covered, met = hit_words(text, items, width)
        spans = sum(1 for i in covered if i - 1 not in covered)
        out.append((doc_id, len(words(text)), len(covered), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(covered), spans))
    return sorted(out, key=lambda r: (r[0] is None, *map(str, r)))


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, *map(str, r)))


def planted(seed, width):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))), "b") for i in range(25)]
    items += [items[3], (None, items[4][1], "b"), (77, items[5][1], "b"), (78, None, None), (79, "!!", None)]
    rows = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        if i % 3 == 0 and items[i % 25][1]:
            text += items[i % 25][1].upper().split() + ["end"]
        rows.append((i, rng.choice([" ", ", ", "\n", "--"]).join(text), "en", None, 0))
    return items, rows + odd_documents()


@pytest.mark.parametrize(("seed", "width", "limit"), [(0, 10, None), (1, 7, None), (2, 10, 0), (3, 1, None), (4, 8, 0)])
def test_equals_plain_search(spark, seed, width, limit):
    """``limit`` 0: the set counts as too large to broadcast."""
    items, rows = planted(seed, width)
    if seed in (0, 2):
        items = [x for x in items if len(words(x[1])) >= 6 or x[1] is None]
    how = {} if limit is None else {"broadcast_bytes": limit}
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("size", F.lit(1)).withColumn("w", F.lit(2))
    assert got(decontaminate.judge(docs, spark.createDataFrame(items, ITEMS), width=width, **how)) == expected(rows, items, width)


def test_empty_tables(spark):
    items, rows = planted(5, 10)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.judge(none, spark.createDataFrame(items, ITEMS)).count() == 0
    docs = spark.createDataFrame(rows, DOCS)
    assert got(decontaminate.judge(docs, no_items)) == expected(rows, [])
    assert got(decontaminate.judge(docs, no_items, broadcast_bytes=0)) == expected(rows, [])


def test_colliding_hashes_do_not_hit(spark, monkeypatch):
    """With hashes of two values nearly every window meets wrong ones; only equal words stay."""
    items, rows = planted(6, 3)
    monkeypatch.setattr(decontaminate, "word_hash", lambda w: F.length(w).cast("long"))
    monkeypatch.setattr(decontaminate, "joined_hash", lambda a, b: F.pmod(a + b, F.lit(2)).cast("long"))
    docs, held = spark.createDataFrame(rows[:40], DOCS), spark.createDataFrame(items, ITEMS)
    assert got(decontaminate.judge(docs, held, width=3)) == expected(rows[:40], items, 3)
    assert got(decontaminate.judge(docs, held, width=3, broadcast_bytes=0)) == expected(rows[:40], items, 3)


def test_spans_and_documents_are_removed(spark):
    items, rows = planted(7, 10)
    items = [x for x in items if len(words(x[1])) >= 8]
    docs, held = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    left = decontaminate.remove_documents(docs, held)
    assert left.columns == docs.columns
    clean = [r for r in rows if not hit_words(r[1], items, 10)[0]]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, left.collect()), key=key) == sorted(clean, key=key)
    want = []
    for doc_id, text, *rest in rows:
        covered = hit_words(text, items, 10)[0]
        if covered:
            parts = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            text = "".join(p for i, p in enumerate(parts) if i not in covered) + text[len("".join(parts)) :]
        want.append((doc_id, text, *rest))
    assert sorted(map(tuple, decontaminate.remove_spans(docs, held).collect()), key=key) == sorted(want, key=key)


def test_hits_leave_the_scan_without_a_python_worker(spark):
    folder = "/root/testdata/sf0.001"
    plan = QUERIES["op12_decontaminate"](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
