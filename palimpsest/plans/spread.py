"""Parallelism for work that costs more CPU than reading its input."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS_SETTING = "spark.palimpsest.spreadTasks"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the setting says, else to those of a shuffle or one for each core; 0 and streams
    leave them where they are.

    A scan cannot split a row group, so with few of them most cores would be idle in parsing or text work, which costs
    more than the shuffle.
    """
    session = df.sparkSession
    tasks = int(session.conf.get(TASKS_SETTING, None) or max(
        session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(tasks) if tasks and not df.isStreaming else df
