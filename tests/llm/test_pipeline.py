"""The pipeline, stage by stage, and the queries that have SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
import sentencepiece
from brute import DOCS, odd_documents, roots, shingles, words
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, duck
from palimpsest.llm import queries as registered
from palimpsest.llm.queries import PIECE_MODEL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registered.SQL))
def test_queries_equal_their_sql(spark, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert compare(got, duck(FOLDER).execute(oracle_sql()[name]).df()) == ""


def test_all_operators_are_registered():
    found = [int(n[2:].split("_")[0]) for n in registered.QUERIES]
    assert sorted(found) == list(range(1, 14)) and "pipeline" in queries()
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "mixing sources", "sentencepiece"]


def test_stages_of_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    now, frames = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, FOLDER).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(now.toPandas())
        if k < len(pipeline.STAGES) - 1:
            assert now.dtypes == docs.dtypes
    judged, lines, groups, mixed, encoded = frames

    kept = {r.doc_id for r in registered.QUERIES["op10_quality"](spark, FOLDER).where("kept").collect()}
    assert set(judged.doc_id) == kept and len(judged) == len(kept)

    pages, total = defaultdict(set), defaultdict(set)
    for r in judged.itertuples():
        total[r.source].add(r.text)
        for line in r.text.split("\n"):
            if line.strip(" "):
                pages[r.source, line.strip(" ")].add(r.text)
    want = {}
    for r in judged.itertuples():
        stay = [x for x in r.text.split("\n") if len(pages[r.source, x.strip(" ")]) < 5 or len(pages[r.source, x.strip(" ")]) / len(total[r.source]) <= 0.1]
        if "\n".join(stay).strip(" ") or len(stay) == r.text.count("\n") + 1:
            want[r.doc_id] = "\n".join(stay)
    assert dict(zip(lines.doc_id, lines.text)) == want
    assert (lines.n_chars == lines.text.str.len()).all()

    ids, sets = lines.doc_id.tolist(), [shingles(t) for t in lines.text]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    smallest = {}
    for i, r in enumerate(roots(len(ids), links)):
        smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    assert sorted(groups.doc_id) == sorted(smallest.values())

    assert set(mixed.doc_id) <= set(groups.doc_id)
    assert max(Counter(mixed.doc_id).values()) <= 2
    assert set(map(tuple, mixed.itertuples(index=False))) <= set(map(tuple, groups.itertuples(index=False)))

    assert Counter(encoded.doc_id) == Counter(mixed.doc_id)
    for r in encoded.itertuples():
        assert list(r.pieces) == held.encode(r.text) and r.n_pieces == len(r.pieces)
    assert Counter(encoded.text) == Counter(mixed.text)


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame(odd_documents(), DOCS).withColumn("_kept", F.lit(1)).withColumn("_copies", F.lit("mine"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        assert out.count() > 0, name
        assert stage(spark, odd.limit(0), FOLDER).count() == 0, name
    kept = pipeline.join_copies(spark, odd, FOLDER).toPandas()
    # Rows without an id are no copies of any.
    assert kept.doc_id.dropna().is_unique and kept.doc_id.isna().sum() == 2
    encoded = pipeline.encode_pieces(spark, odd.withColumn("pieces", F.lit("mine")).withColumn("_pieces", F.lit(3)), FOLDER)
    assert encoded.count() == len(odd_documents()) and dict(encoded.dtypes)["pieces"] == "array<int>"
    assert {"_kept", "_copies", "_pieces"} <= set(encoded.columns)
    assert sum(len(words(t)) > 0 for t in pipeline.clean_lines(spark, odd, FOLDER).toPandas().text) > 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    one, two, other = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    near = one.replace("a39", "b39")
    rows = [(1, one), (1, two), (1, near), (1, one), (2, other), (2, near), (3, other), (4, "few words"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    kept = pipeline.join_copies(spark, docs, FOLDER).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    first = min((one, near), key=lambda t: [g[1] for g in got].count(t) == 0)
    assert got == sorted([(1, first), (1, two), (2, other), (4, "few words"), (4, None), (4, "")], key=str)
