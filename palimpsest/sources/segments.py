"""The word index on storage: segments of postings that batches add and a size-tiered policy joins.

An index is kept like an archive (``sources.archive``): folders below ``data``, commits that name the live ones. Its tables
are ``postings`` and ``gone``, the ids that a segment replaces or removes; the bucket number of a folder is the number of
the segment. A posting lives while no later segment has its id among the gone ones. Batches and merges fill new folders and add
their commit last, so a reader finds the index before or after one of them, never between; ``archive.vacuum`` deletes what
no kept commit names. One writer at a time; a commit made from an older state is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.search import build_index
from palimpsest.plans.ordered import join_by_key
from palimpsest.plans.staging import staged, staged_for
from palimpsest.sources.archive import Commit, add_commit, newest_sequence, read_commits, read_folders

TABLES = ("postings", "gone")
# So many segments of one size class are joined; the classes grow by the same factor.
MERGE_AT = 4


def _write(rows: DataFrame, path: str, version: str, name: str, segment: int, order: Sequence[str]) -> str:
    """Range-partitioned: common words spread over tasks, and statistics prune the rest.

    Finding the ranges reads the rows once, uneven tasks twice, before they are dealt; they are computed once for all that.
    """
    folder = f"data/{version}/{name}/bucket={segment}"
    with staged_for(rows, "segment") as kept:
        kept.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/{folder}")
    return folder


def _write_segment(
    path: str, version: str, segment: int, postings: DataFrame, gone: DataFrame
) -> dict[str, tuple[str, ...]]:
    return {
        "postings": (_write(postings, path, version, "postings", segment, ["token", "id"]),),
        "gone": (_write(gone, path, version, "gone", segment, ["id"]),),
    }


def write_index(postings: DataFrame, path: str) -> None:
    """Postings (token, id, positions) as an index of one segment; what the folder held before is of earlier commits."""
    spark, version = postings.sparkSession, uuid.uuid4().hex
    read, gone = newest_sequence(spark, path), postings.select("id").limit(0)
    written = _write_segment(path, version, 0, postings, gone)
    add_commit(spark, path, version, [
        Commit(read, name, order[0], tuple(order), 1, rows.schema, {0: written[name]})
        for name, rows, order in (("postings", postings, ["token", "id"]), ("gone", gone, ["id"]))
    ])


def append_changes(
    spark: SparkSession, path: str, changes: DataFrame, id_: str = "id", content: str = "content", merge_at: int = MERGE_AT
) -> None:
    """Add inserted, changed and removed (NULL content) messages, one row for each id, as the newest segment.

    Only they are indexed; stored segments stay as they are until a merge is due, which then runs.
    """
    states = read_commits(spark, path, TABLES)
    segment, version = max(states[0].folders) + 1, uuid.uuid4().hex
    changes = staged(changes.select(F.col(id_).alias("id"), F.col(content).alias("content")), "index-changes")
    written = _write_segment(
        path, version, segment, build_index(changes.where(F.col("content").isNotNull())), changes.select("id").distinct())
    add_commit(spark, path, version, [replace(s, folders={**s.folders, segment: written[s.name]}) for s in states])
    merge_due_segments(spark, path, merge_at)


def _segments(spark: SparkSession, path: str, commit: Commit, chosen: Sequence[int]) -> DataFrame:
    parts = [read_folders(spark, path, commit, [s]).withColumn("segment", F.lit(s)) for s in chosen]
    return reduce(DataFrame.unionByName, parts)


def _living(spark: SparkSession, path: str, states: Sequence[Commit], chosen: Sequence[int]) -> DataFrame:
    """The postings of adjacent segments that none of them replaces."""
    postings, gone = (_segments(spark, path, s, chosen) for s in states)
    if len(chosen) == 1:
        return postings.drop("segment")
    # Segment 0 replaces nothing that is there.
    latest = gone.where(F.col("segment") > min(chosen)).groupBy("id").agg(F.max("segment").alias("_gone"))
    met = join_by_key(postings, latest, ["id"])
    return met.where(F.col("_gone").isNull() | (F.col("segment") >= F.col("_gone"))).drop("segment", "_gone")


def read_index(spark: SparkSession, path: str, sequence: int | None = None) -> DataFrame:
    """The living postings as of the newest commit or an earlier one that is kept.

    A filter on ``token`` reaches the scans, so ids meet only its postings.
    """
    states = read_commits(spark, path, TABLES, sequence)
    return _living(spark, path, states, sorted(states[0].folders)).select("token", "id", "positions")


def due_segments(rows: Mapping[int, int], merge_at: int = MERGE_AT) -> list[int]:
    """The newest segments that a merge joins, by their numbers of postings; none if no merge is due.

    The size class of a segment is the power of ``merge_at`` that its rows reach. Where ``merge_at`` segments of one class stand
    together, but for smaller ones between and after them, they become one with these; the smallest class goes
    first. So a posting is written about once for each class, and as many segments stay as there are classes times ``merge_at``.
    """
    def size_class(n: int) -> int:
        found = 0
        while n >= merge_at:
            n //= merge_at
            found += 1
        return found

    classes = {s: size_class(n) for s, n in rows.items()}
    for wanted in sorted(set(classes.values())):
        run: list[int] = []
        for s in sorted(classes, reverse=True):
            if classes[s] > wanted:
                break
            run.append(s)
        if sum(classes[s] == wanted for s in run) >= merge_at:
            return sorted(run)
    return []


def merge_due_segments(spark: SparkSession, path: str, merge_at: int = MERGE_AT) -> list[int]:
    """Join the segments that are due, as one commit; gives their numbers. The result bears the number of the newest."""
    states = read_commits(spark, path, TABLES)
    every = sorted(states[0].folders)
    # Row counts come from the footers of the files.
    counted = {r["segment"]: r["n"] for r in _segments(spark, path, states[0], every).groupBy("segment").agg(
        F.count("*").alias("n")).collect()}
    due = due_segments({s: counted.get(s, 0) for s in every}, merge_at)
    if not due:
        return []
    version = uuid.uuid4().hex
    gone = _segments(spark, path, states[1], due).select("id").distinct()
    # Nothing stands before the first segment that could be gone.
    gone = gone.limit(0) if due[0] == every[0] else gone
    written = _write_segment(path, version, due[-1], _living(spark, path, states, due), gone)
    add_commit(spark, path, version, [
        replace(s, folders={**{n: f for n, f in s.folders.items() if n not in due}, due[-1]: written[s.name]}) for s in states
    ])
    return due
