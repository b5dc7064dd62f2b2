"""Batches merged into the stored archive: the buckets that change are written anew, older rows are appended."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.capture import KEPT, ORDER, classify_snapshots, merge_kept, state_of
from palimpsest.plans.ordered import HotKeys
from palimpsest.plans.staging import staged
from palimpsest.sources.archive import Commit, add_commit, bucket_of, read_commits, read_folders, write_buckets

# Folders of a bucket of older rows, beyond which a merge writes them as one.
MOST_FOLDERS = 16


def _buckets_of(rows: DataFrame, commit: Commit) -> list[int]:
    """The buckets that rows belong to; never more than the table has."""
    found = rows.select(bucket_of(commit.parent, commit.buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in found)


def merge_batch(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: Sequence[str],
    mutable: Sequence[str],
    *,
    current: str = "current",
    previous: str = "previous",
    immutable: Sequence[str] = (),
    extra: str | None = "_extra",
    order: Sequence[str] = ORDER,
    deleted: str = "_deleted",
    hot: HotKeys | None = None,
    most_folders: int = MOST_FOLDERS,
) -> DataFrame:
    """Merge observations into two tables of an archive as one commit; gives the batch with its results.

    ``current`` has one row per key with the immutable and mutable columns and the deletion mark, ``previous`` the older rows with the
    parent. The parent column is a key or immutable column, and an object keeps its parent: stored rows are read from the
    buckets of the batch alone. Of these, buckets where nothing was kept stay as they are. Rows that are replaced are added to
    ``previous`` in folders of their own; a bucket that has ``most_folders`` of them is written as one. NULL is a key and a parent
    like any other; a batch without changes makes no commit.
    """
    now, past = read_commits(spark, path, [current, previous])
    versioned = [order[0], *mutable, *([extra] if extra else [])]
    parent = [now.parent] if now.parent not in key else []
    batch = staged(batch, "batch")
    stored = read_folders(spark, path, now, _buckets_of(batch, now))
    results = staged(
        classify_snapshots(batch, key, state_of(mutable, extra), order=order, latest=stored, hot=hot), "batch-results")
    kept = results.where(F.col("result").isin(*KEPT))
    changed = _buckets_of(kept, now)
    if not changed:
        return results
    # The parent goes with every version, so that older rows are found by it as well.
    fixed = [c for c in immutable if c not in parent]
    after, added = merge_kept(
        read_folders(spark, path, now, changed), kept, key, [*versioned, *parent], immutable=fixed, deleted=deleted)
    version = uuid.uuid4().hex
    written = write_buckets(after.select(*now.columns.names), path, version, now.name, now.parent, now.sorted, now.buckets)
    added = staged(added.select(*past.columns.names), "replaced")
    full = [b for b in _buckets_of(added, past) if len(past.folders.get(b, ())) >= most_folders]
    older = added.unionByName(read_folders(spark, path, past, full)) if full else added
    appended = write_buckets(older, path, version, past.name, past.parent, past.sorted, past.buckets)
    folders = dict(past.folders)
    for b, new in appended.items():
        folders[b] = new if b in full else (*folders.get(b, ()), *new)
    add_commit(spark, path, version, [
        replace(now, folders={**now.folders, **written}),
        replace(past, folders=folders),
    ])
    return results
