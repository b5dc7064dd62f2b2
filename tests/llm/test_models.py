"""Classifier, URL filters and vectors against plain Python or held-out rows, with the odd cases."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import DOCS, lower, odd_documents, roots
from pyspark.sql import functions as F

from palimpsest.llm import quality, url_filter, vectors
from palimpsest.llm.queries import GOOD_GRADE, QUERIES, URL_RULES, graded

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_quality_of_rated_documents(spark):
    """Fitted on half of the ratings, held against the other half."""
    labels = graded(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    half = labels.where(F.xxhash64("doc_id", F.lit(3)) % 2 == 0)
    judged = quality.classify(docs, half, good=GOOD_GRADE).join(labels.join(half, "doc_id", "left_anti"), "doc_id").toPandas()
    assert judged[judged.grade == 2]._kept.mean() > 0.95
    assert judged[judged.grade == 0]._kept.mean() < 0.3
    means = judged.groupby("grade")._expected_grade.mean()
    assert means[0] < means[1] and means[0] < means[2] - 0.5
    assert judged._tail_probability.between(0, 1).all()


def test_quality_query_scores_every_document(spark):
    got = QUERIES["op10_quality"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert sorted(got.collect()) == sorted(QUERIES["op10_quality"](spark, SMALL).collect())


def test_quality_odd_cases(spark):
    odd = spark.createDataFrame(odd_documents(), DOCS)
    none = spark.createDataFrame([], "doc_id long, grade int")
    kept = {(r.doc_id, r.text): r._kept for r in quality.classify(odd, none, good=2).collect()}
    assert all(k == bool(re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", lower(text))) for (_, text), k in kept.items())
    assert quality.classify(odd, none, good=2).count() == len(odd_documents())
    ratings = spark.createDataFrame([(0, 2), (0, 1), (3, 0), (6, 2), (99, 1), (None, 1), (30, None), (15, 0)], "doc_id long, grade int")
    judged = quality.classify(odd.withColumn("_kept", F.lit("mine")), ratings, good=2)
    assert judged.count() == len(odd_documents()) and dict(judged.dtypes)["_kept"] == "boolean"
    assert quality.classify(spark.createDataFrame([], DOCS), ratings, good=2).count() == 0


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    n = 600
    score = rng.normal(0, 1, n)
    grade = np.digitize(score + rng.logistic(0, 0.2, n), [-0.7, 0.7])
    number = np.concatenate([np.zeros(n, int), np.ones(n, int)])
    value = np.concatenate([np.maximum(score, 0), np.maximum(-score, 0)])
    model = quality.fit(number, value, np.tile(np.arange(n), 2), grade, 2, bits=4)
    assert model.thresholds[0] < model.thresholds[1]
    found = model.weights[0] * np.maximum(score, 0) + model.weights[1] * np.maximum(-score, 0)
    tails = model.tails(found)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(1) == grade) > 0.75


def one_url(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (lower(found[1]), found[2]) if found else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def brute_verdicts(rows):
    """(page_id, host, path, rule, verdict) by the same method in plain Python."""
    counts = Counter()
    for _, _, html in rows:
        counts.update(w for w in re.split(url_filter.NOT_WORD, lower(re.sub("<[^>]*>", " ", html or ""))) if w)
    total = sum(counts.values()) or 1

    def tokens(host, path):
        names = [w for w in re.split(url_filter.NOT_WORD, host) if w]
        found = []
        for name in names:
            costs = {
                (i, k): math.log(total / counts[name[i : i + k]])
                for i in range(len(name)) for k in range(2, url_filter.LONGEST_WORD + 1)
                if i + k <= len(name) and counts[name[i : i + k]]
            }
            found += ["h:" + w for w in url_filter.viterbi(name, costs, math.log(total) + math.log(10))]
        return found, ["p:" + w for w in re.split(url_filter.NOT_WORD, lower(path)) if w]

    parsed = [(i, *one_url(u)) for i, u, _ in rows]
    seen, sizes = {"block": Counter(), "allow": Counter()}, Counter()
    for _, host, path, rule in parsed:
        a, b = tokens(host, path)
        if rule:
            sizes[rule.verdict] += 1
            seen[rule.verdict].update(a + b)
    every = {w for _, host, path, _ in parsed for w in sum(tokens(host, path), [])}

    def odds(w):
        each = [math.log((seen[v][w] + 1) / (sum(seen[v].values()) + len(every))) for v in ("block", "allow")]
        return each[0] - each[1]

    for i, host, path, rule in parsed:
        known = [w for w in sum(tokens(host, path), []) if seen["block"][w] + seen["allow"][w]]
        trained = sizes["block"] and sizes["allow"]
        score = math.log(sizes["block"] / sizes["allow"]) + sum(map(odds, known)) if known and trained else 0.0
        yield i, host, path, rule.text if rule else None, rule.verdict if rule else "block" if score > 0 else "allow"


def ordered(rows):
    return sorted(rows, key=str)


def test_urls_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r)[:5] for r in QUERIES["op9_url_filter"](spark, SMALL).collect()]
    assert ordered(got) == ordered(brute_verdicts(rows))
    assert {v for *_, rule, v in got if rule is None} == {"allow", "block"}


def test_urls_odd_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y", "x://notnet/", "http://example.net/en/1",
        "http://www.example.net/EN/1", "http://example.com/de/", "http://sub.Example.COM/de/a#b", "http://org/fr/", "http://a.org/fr", "http://a.org?x=/fr/",
        "http://b.net/a://org/fr/", "http://user@net:80/", "ftp://münchen.org/fr/ä", "http://" + "longname" * 400 + ".com/", "http://net/", "http://net/",
    ]
    rows = [(i % 18, u, "<p>long name www example net</p>" if i % 2 else None) for i, u in enumerate(urls)] + [(None, "http://q.org/fr/", "text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = [tuple(r)[:5] for r in url_filter.judge_urls(df, URL_RULES).collect()]
    assert ordered(got) == ordered(brute_verdicts(rows))
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_first_of_equally_long_rules(spark):
    rules = [url_filter.Rule("block", "a.org", "/x"), url_filter.Rule("allow", "a.org", "/x"), url_filter.Rule("allow", "org", "/"),
             url_filter.Rule("allow", "a.org", "/"), url_filter.Rule("block", "a.org", "/")]
    df = spark.createDataFrame([(1, "http://a.org/x1"), (2, "http://a.org/y"), (3, "http://b.org/y")], "page_id long, url string")
    got = url_filter.judge_urls(df.withColumn("html", F.lit("")), rules).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "a.org/x", "block"), (2, "a.org/", "allow"), (3, "org/", "allow")}


def test_long_words_inside_names(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    counts = spark.createDataFrame([(long, 50), ("donau", 50), ("dampf", 50), ("shop", 50), (long + "en", 1)], "word string, n long")
    names = spark.createDataFrame([(f"shop{long}shop",), (long,), (long[:-1],)], "name string")
    got = {r.name: r.words for r in url_filter.segmented_names(names, counts).collect()}
    assert got[f"shop{long}shop"] == ["shop", long, "shop"] and got[long] == [long]
    assert got[long[:-1]] == ["donau", "dampf", long[10:-1]]


def test_segmentation():
    costs = {(0, 4): 2.0, (4, 3): 2.0, (0, 7): 5.0, (2, 4): 1.0}
    assert url_filter.viterbi("freexyz", costs, 9.0) == ["free", "xyz"]
    assert url_filter.viterbi("abc", {}, 9.0) == ["abc"] and url_filter.viterbi("", {}, 9.0) == []


def brute_links(rows, limit=0.9):
    usable = [
        v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows
    ]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if u else None for u, (_, v) in zip(usable, rows)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= limit
    ]
    n = Counter(x for pair in links for x in pair)
    root = roots(len(rows), links)
    name = {}
    for i, r in enumerate(root):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None]
        name[i] = min(ids) if ids else None
    return [(rows[i][0], n[i], name[i]) for i in range(len(rows))]


def random_vectors(seed, dims=16):
    """Clusters, chains of slowly turning vectors, copies and lone ones."""
    rng = np.random.default_rng(seed)
    vectors_ = [rng.normal(size=dims) for _ in range(40)]
    for c in vectors_[:6]:
        vectors_ += [c + rng.normal(size=dims) * s for s in rng.uniform(0.01, 0.4, 25)]
    turn = rng.normal(size=dims)
    for _ in range(30):
        turn = turn / np.linalg.norm(turn) + rng.normal(size=dims) * 0.08
        vectors_.append(turn)
    vectors_ += [vectors_[0]] * 5 + [3 * vectors_[50]] * 3
    order = rng.permutation(len(vectors_))
    return [(int(k) * 2, [float(x) for x in vectors_[i]]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed,chunk", [(0, 8192), (1, 7), (2, 40)])
def test_vectors_against_brute_force(spark, seed, chunk):
    rows = random_vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in vectors.near_vectors(df, chunk=chunk).collect()]
    want = brute_links(rows)
    assert max(n for _, n, _ in want) > 10
    assert sorted(got) == sorted(want)


def test_vectors_odd_cases(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (10, [0.9, 0.4358898943540674]), (11, [-1.0, -0.0]), (12, [1e-200, 1e-201]), (13, [1e200, 0.0]), (7, [1.0, 0.0]), (14, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dims", F.lit("mine"))
    got = [tuple(r) for r in vectors.near_vectors(df).collect()]
    want = brute_links(rows)
    assert Counter((i, n) for i, n, _ in got) == Counter((i, n) for i, n, _ in want)
    assert {i: c for i, _, c in got} == {i: c for i, _, c in want}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op7_vectors"](spark, SMALL).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_links(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_fit_does_not_run_away():
    """Many steps over strong, overlapping features keep to a minimum."""
    rng = np.random.default_rng(4)
    n, m = 400, 60
    x = rng.gamma(0.3, 3.0, (n, m))
    grade = np.digitize(x[:, 0] - x[:, 1] + rng.logistic(0, 0.5, n), [-1.0, 1.0])
    model = quality.fit(np.tile(np.arange(m), n), x.ravel(), np.repeat(np.arange(n), m), grade, 2, bits=6, steps=2000)
    assert np.isfinite(model.weights).all() and np.diff(model.thresholds)[0] < 100
    tails = model.tails(x @ model.weights[:m])
    assert np.mean((tails > 0.5).sum(1) == grade) > 0.7
