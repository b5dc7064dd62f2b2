"""What a stream knows of its keys: a table in buckets, one run of files for each micro-batch, runs merged by number.

``<folder>/<first>-<last>/bucket=<b>`` holds the newest rows of the keys that the micro-batches first to last changed. Micro-batch n
reads the runs that make up 0 to n - 1: the digits of n to the base ``fan``, the longest first, so at most
(fan - 1) * log(n) of them, and of each only the buckets of its own keys. A run that is not there yet is merged from
its ``fan`` parts before the micro-batch goes on, and what no later micro-batch needs is deleted then. Which runs there must be follows from n
alone: a repeated micro-batch writes its own run anew and a merge that was cut short is done again, from parts that are still there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.ordered import join_by_key, newest
from palimpsest.plans.staging import delete_folder, folder_names
from palimpsest.sources.archive import bucket_of

BUCKETS = 64
FAN = 8
START = "start"
BATCH = "batch"


def runs_before(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The runs (first, last) that make up the micro-batches before ``n``."""
    found, at, size = [], 0, 1
    while size * fan <= n:
        size *= fan
    while at < n:
        while at + size > n:
            size //= fan
        found.append((at, at + size - 1))
        at += size
    return found


class BatchState:
    """``columns``: DDL of the rows, ``key`` names one, ``by`` (part of the key) decides on the bucket; ``alive``: rows without it are
    forgotten when all that is known is merged."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, key: Sequence[str], *, by: Sequence[str] | None = None,
                 alive: Column | None = None, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.key, self.by = spark, folder, list(key), list(by or key)
        self.columns, self.alive, self.buckets, self.fan = f"{columns}, {BATCH} long", alive, buckets, fan
        self.names = [f.name for f in spark.createDataFrame([], columns).schema]

    def _bucket(self) -> Column:
        return bucket_of(F.struct(*self.by), self.buckets)

    def _path(self, run: tuple[int, int] | str) -> str:
        return f"{self.folder}/{run if run == START else f'{run[0]:09}-{run[1]:09}'}"

    def _write(self, rows: DataFrame, run: tuple[int, int] | str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self._path(run))

    def _read(self, runs: Sequence[tuple[int, int] | str], buckets: set[str] | None = None) -> DataFrame:
        paths = [
            f"{self._path(run)}/{name}" for run in runs for name in folder_names(self.spark, self._path(run))
            if name.startswith("bucket=") and (buckets is None or name in buckets)
        ]
        self.opened = paths
        return self.spark.read.schema(self.columns).parquet(*paths) if paths else self.spark.createDataFrame([], self.columns)

    def _done(self, run: tuple[int, int] | str) -> bool:
        return "_SUCCESS" in folder_names(self.spark, self._path(run))

    def start(self, rows: DataFrame) -> None:
        """What was known before the stream; only the first call counts."""
        if not self._done(START):
            self._write(rows.select(*self.names, F.lit(-1).cast("long").alias(BATCH)), START)

    def _runs(self, n: int) -> list[tuple[int, int] | str]:
        return [*([START] if self._done(START) else []), *runs_before(n, self.fan)]

    def prepare(self, n: int) -> None:
        """Merge what has to be merged before micro-batch ``n`` and delete what it replaces."""
        wanted = runs_before(n, self.fan)
        for run in wanted:
            self._merge(run)
        keep = {self._path(run).rsplit("/", 1)[1] for run in [START, *wanted]}
        for name in folder_names(self.spark, self.folder):
            if name not in keep and name[:1].isdigit() and int(name.split("-")[1]) < n:
                delete_folder(self.spark, f"{self.folder}/{name}")

    def _merge(self, run: tuple[int, int]) -> None:
        first, last = run
        size = (last - first + 1) // self.fan
        if not size or self._done(run):
            return
        parts = [(a, a + size - 1) for a in range(first, last + 1, size)]
        for part in parts:
            self._merge(part)
        rows = newest(self._read(parts), self.key, [BATCH])
        if self.alive is not None and first == 0 and not self._done(START):
            rows = rows.where(self.alive)
        self._write(rows.select(*self.names, BATCH), run)

    def known(self, keys: DataFrame, n: int) -> DataFrame:
        """The newest rows, before micro-batch ``n``, of all keys whose ``by`` columns are among ``keys``."""
        wanted = keys.select(*self.by).distinct()
        touched = {f"bucket={r['b']}" for r in wanted.select(self._bucket().alias("b")).distinct().collect()}
        stored = join_by_key(self._read(self._runs(n), touched), wanted, self.by, "left_semi")
        return newest(stored, self.key, [BATCH]).select(*self.names)

    def put(self, rows: DataFrame, n: int) -> None:
        self._write(rows.select(*self.names, F.lit(n).cast("long").alias(BATCH)), (n, n))
