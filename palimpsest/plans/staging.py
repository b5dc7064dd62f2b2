"""Work tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DIR_SETTING = "spark.checkpoint.dir"

_written: dict[str, list[str]] = {}
_own: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a session that runs in this process alone may lack the setting; it gets a folder that goes when the process ends.
    """
    root = spark.conf.get(DIR_SETTING, None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError(f"set {DIR_SETTING} to a folder that all executors share")
        root = _own.get(spark.sparkContext.applicationId)
        if root is None:
            root = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read back: the lineage ends here, and what reads the
    result twice does not compute it twice. Lost executors only cost a re-read."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_for(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``staged`` rows that go when the block ends, for what several jobs of one write read."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(df.sparkSession, path)
        _written[df.sparkSession.sparkContext.applicationId].remove(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    place, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def drop_work(spark: SparkSession) -> int:
    """Delete the work tables of this application, once the results that read them are stored; gives their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_folder(spark, path)
    return len(paths)
