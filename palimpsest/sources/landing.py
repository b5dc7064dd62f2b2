"""Landed API responses and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = "received_at long, payload string, kind string"
DISPATCH_SCHEMA = "t string, d string, seq long, received_at long, realtime boolean"
# What one micro-batch may read. It also bounds what one key can bring to one task.
BATCH_BYTES = 1 << 30


def read_payloads(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(received_at, kind, payload) with one JSON document per row.

    Files are JSON lines ``{"received_at": ms, "payload": document or list of documents}`` under
    ``kind=<name>`` folders; the kind prunes folders. Lists (pages) become one row per document.
    """
    rows = spark.read.schema(PAYLOAD_SCHEMA).json(path)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    documents = F.when(
        F.col("payload").startswith("["), F.from_json("payload", "array<string>")
    ).otherwise(F.array("payload"))
    return rows.select("received_at", "kind", F.explode(documents).alias("payload"))


def write_payloads(df: DataFrame, path: str) -> None:
    """Land (received_at, kind, payload text) in the layout ``read_payloads`` reads."""
    documents = df.withColumn("payload", F.parse_json("payload"))
    documents.write.partitionBy("kind").mode("append").json(path)


def read_dispatches(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES, **options: str) -> DataFrame:
    """Stream of change events (t, d, seq, received_at, realtime) from JSON-lines files.

    A Kafka source with the same five columns gives the same plan.
    """
    reader = spark.readStream.schema(DISPATCH_SCHEMA)
    if "maxFilesPerTrigger" not in options:
        # The source takes one of the two limits.
        reader = reader.option("maxBytesPerTrigger", str(batch_bytes))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.json(path)


def write_dispatches(df: DataFrame, path: str) -> None:
    """Land (t, d text, seq, received_at, realtime) as ``read_dispatches`` reads it."""
    df.withColumn("d", F.parse_json("d")).write.mode("append").json(path)
