"""The archive on storage: per-type tables of current rows, older rows, members, reactions, files.

Layout: ``<path>/data/<version>/<table>/bucket=<b>/*.parquet`` and ``<path>/commits/*.json``. A commit names, for each table that it
changes, the folders of every bucket. A writer fills new folders and adds its commit last, as one file; readers take the
newest commit of a table and open the folders it names, so a change rewrites the buckets that it touches and no other. A
writer that dies leaves no commit, so nobody reads half a table, and the job can simply run again. One writer at a time: a
commit that isn't the successor of the one its writer read is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.plans.staging import delete_folder, folder_names

COMMIT_SCHEMA = (
    "sequence long, committed_at long, version string, name string, parent string, sorted array<string>, buckets int, "
    "columns string, folders array<struct<bucket:int,folder:string>>"
)
BUCKETS = 64


@dataclass(frozen=True)
class Commit:
    """State of one table: its columns, how it is dealt to buckets, and the folders of each bucket below the archive."""

    sequence: int
    name: str
    parent: str
    sorted: tuple[str, ...]
    buckets: int
    columns: StructType
    folders: Mapping[int, tuple[str, ...]]

    def paths(self, buckets: Iterable[int] | None = None) -> list[str]:
        chosen = self.folders if buckets is None else [b for b in buckets if b in self.folders]
        return [f for b in sorted(chosen) for f in self.folders[b]]


def bucket_of(parent: str | Column, buckets: int) -> Column:
    """Coarse partition of a parent; NULL (direct channels) hashes like any other value."""
    column = F.col(parent) if isinstance(parent, str) else parent
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def write_buckets(
    rows: DataFrame, path: str, version: str, name: str, parent: str, order: Sequence[str], buckets: int
) -> dict[int, tuple[str, ...]]:
    """Write rows into new folders, without a commit; gives the folder of each bucket that has rows.

    Rows are range-partitioned by (bucket, parent, sort columns): a hot parent spreads over many
    files, and the statistics of a file cover few parents.
    """
    layout = ["bucket", parent, *[c for c in order if c != parent]]
    folder = f"data/{version}/{name}"
    (
        rows.withColumn("bucket", bucket_of(parent, buckets))
        .repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .write.partitionBy("bucket")
        .parquet(f"{path}/{folder}")
    )
    found = [n for n in folder_names(rows.sparkSession, f"{path}/{folder}") if n.startswith("bucket=")]
    return {int(n.removeprefix("bucket=")): (f"{folder}/{n}",) for n in found}


def add_commit(spark: SparkSession, path: str, version: str, tables: Sequence[Commit]) -> None:
    """Make a new state of some tables visible at once; ``sequence`` is that of the state it was made from."""
    newest = newest_sequence(spark, path)
    read = max(t.sequence for t in tables)
    if newest != read:
        raise RuntimeError(f"{path} is at commit {newest}, this change was made from {read}")
    now = time.time_ns() // 1_000_000
    rows = [
        (newest + 1, now, version, t.name, t.parent, list(t.sorted), t.buckets, t.columns.json(),
         [(b, f) for b in sorted(t.folders) for f in t.folders[b]])
        for t in tables
    ]
    spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/commits")


def _commit_rows(spark: SparkSession, path: str) -> DataFrame:
    if not folder_names(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits")


def newest_sequence(spark: SparkSession, path: str) -> int:
    return _commit_rows(spark, path).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("s")).first()["s"]


def read_commits(spark: SparkSession, path: str, names: Sequence[str], sequence: int | None = None) -> list[Commit]:
    """The state of some tables as of the newest commit, or as of an earlier one."""
    rows = _commit_rows(spark, path)
    if sequence is not None:
        rows = rows.where(F.col("sequence") <= sequence)
    newest = rows.agg(F.max("sequence").alias("s")).first()["s"]
    found = {
        r["name"]: r["c"] for r in rows.where(F.col("name").isin(*names)).groupBy("name")
        .agg(F.max_by(F.struct("*"), "sequence").alias("c")).collect()
    }
    commits = []
    for name in names:
        if name not in found:
            raise ValueError(f"no table {name!r} in the archive at {path}")
        row, folders = found[name], {}
        for f in row["folders"]:
            folders[f["bucket"]] = (*folders.get(f["bucket"], ()), f["folder"])
        columns = StructType.fromJson(json.loads(row["columns"]))
        commits.append(Commit(newest, name, row["parent"], tuple(row["sorted"]), row["buckets"], columns, folders))
    return commits


def read_folders(spark: SparkSession, path: str, commit: Commit, buckets: Iterable[int] | None = None) -> DataFrame:
    """The rows of a state, of some buckets or all."""
    paths = [f"{path}/{f}" for f in commit.paths(buckets)]
    return spark.read.schema(commit.columns).parquet(*paths) if paths else spark.createDataFrame([], commit.columns)


def write_archive(
    tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]], path: str, buckets: int = BUCKETS
) -> str:
    """Write the tables whole, as one commit; a table is (rows, parent column, sort columns)."""
    spark = next(iter(tables.values()))[0].sparkSession
    version, read = uuid.uuid4().hex, newest_sequence(spark, path)
    states = [
        Commit(read, name, parent, tuple(order), buckets, rows.schema, write_buckets(rows, path, version, name, parent, order, buckets))
        for name, (rows, parent, order) in tables.items()
    ]
    add_commit(spark, path, version, states)
    return version


def read_latest(
    spark: SparkSession, path: str, name: str, columns: Sequence[str] | None = None, sequence: int | None = None
) -> DataFrame:
    """All rows of a table as of its newest commit, or of an earlier one that is kept."""
    (commit,) = read_commits(spark, path, [name], sequence)
    rows = read_folders(spark, path, commit)
    return rows if columns is None else rows.select(*columns)


def read_children(spark: SparkSession, path: str, name: str, parent_id: int | None) -> DataFrame:
    """Rows of one parent: one bucket's folders, and in them the row groups whose range has the parent."""
    (commit,) = read_commits(spark, path, [name])
    value = F.lit(parent_id).cast(commit.columns[commit.parent].dataType)
    bucket = spark.range(1).select(bucket_of(value, commit.buckets).alias("b")).first()["b"]
    return children_of(read_folders(spark, path, commit, [bucket]), commit.parent, parent_id)


def children_of(rows: DataFrame, parent: str, parent_id: int | None) -> DataFrame:
    """Rows of one parent of any table; a NULL parent matches NULL."""
    return rows.where(F.col(parent).eqNullSafe(F.lit(parent_id)))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all but the newest ``keep`` commits of each table and delete the folders that none of these names.

    Commits go before folders, so a reader that starts later finds whole tables; one that still reads an older state fails.
    Not to be run beside a writer: its folders have no commit yet. Gives the number of folders deleted.
    """
    rows = _commit_rows(spark, path).select("*", F.col("_metadata.file_path").alias("file")) if folder_names(spark, f"{path}/commits") else None
    if rows is None:
        return 0
    # Names and numbers only: a row for each table that a commit changes.
    listed = rows.select("name", "sequence", "file", F.col("folders.folder").alias("folders")).collect()
    kept, named, files = {}, set(), {}
    for r in sorted(listed, key=lambda r: -r["sequence"]):
        kept[r["name"]] = kept.get(r["name"], 0) + 1
        files[r["file"]] = files.get(r["file"], False) or kept[r["name"]] <= keep
    for r in listed:
        # A commit that one table still needs stays for all its tables.
        if files[r["file"]]:
            named.update(r["folders"])
    for file in (f for f, needed in files.items() if not needed):
        delete_folder(spark, file)
    gone = 0
    for version in folder_names(spark, f"{path}/data"):
        for name in folder_names(spark, f"{path}/data/{version}"):
            every = [n for n in folder_names(spark, f"{path}/data/{version}/{name}") if n.startswith("bucket=")]
            for n in every:
                folder = f"data/{version}/{name}/{n}"
                if folder not in named:
                    delete_folder(spark, f"{path}/{folder}")
                    gone += 1
    return gone
