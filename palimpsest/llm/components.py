"""Connected components of an edge table, by stars that shrink to their smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.staging import staged


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their component, over the edges (a, b)."""
    label = np.arange(n) if start is None else start
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # Roots move, too, so that whole trees meet.
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def contracted(edges: DataFrame) -> DataFrame:
    """Stars that connect what the edges of each task connect; no more edges than nodes seen there in a batch."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            nodes, local = np.unique(pair, return_inverse=True)
            local = local.reshape(pair.shape)
            root = smallest_labels(len(nodes), local[0], local[1])
            leaf = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); component is the smallest node that is reached.

    Large and small stars take turns: each node hands its larger, then its smaller neighbours to the smallest one.
    Minima are combined before each shuffle; every round is written, so a lost executor costs one round. The number
    of rounds grows with the logarithm of the longest path.
    """
    def sign(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = staged(contracted(edges.where("a <> b")).distinct(), "stars")
    held = sign(now)
    while held[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "stars")
        # a > b holds for every edge from here on.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                              F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = staged(small.where("a <> b").distinct(), "stars")
        was, held = held, sign(now)
        if held == was:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
