"""Embedding near-dedup: an exact metric range join of unit vectors.

cosine >= c means a distance of at most r = sqrt(2 - 2c) between unit vectors. Some vectors, the pivots, divide the space:
a vector belongs to the cell of its nearest pivot. By the triangle inequality a vector v of cell i can only have a partner
in cell j if d(v, p_j) - d(v, p_i) <= 2r, and none if d(v, p_j) > r + the radius of cell j; it is copied to the
cells that remain, which then join on their own. A cell sees all partners of its own vectors, so links are
counted there once and no pair has to be kept: a cell sends one count for each of its vectors and a forest of edges.

Equal vectors are one row. A cell with more than ``chunk`` own vectors is dealt to several tasks, which hold that many vectors
and see the copies one batch after another. Vectors without clusters lie about equally far from all pivots; then
few copies can be spared, and the join costs the square of the number of distinct vectors in arithmetic (not in rows).

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing and are a component of
their own; vectors of different lengths don't link; repeated ids are rows of their own, and links between them count;
a NULL id is no component's name unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components, smallest_labels
from palimpsest.plans.staging import staged

COSINE = 0.9
PIVOTS = 16
CHUNK = 8192
# Rows of a batch of copies, so that a block of cosines has a bounded size.
STRIP = 512
# Cosines this close to the limit are computed again, component by component.
DOUBT = 1e-9


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, dims, vector): the components as doubles in binary, NULL where a vector can't link."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, dims = [], []
            for one in batch.column(1):
                values = one.as_py()
                x = None if not values or any(v is None for v in values) else np.array(values, "<f8")
                # Scaled by the largest component first, so that no square overflows or vanishes.
                good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                held.append((x / np.abs(x).max() + 0.0).astype("<f8").tobytes() if good else None)
                dims.append(len(x) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(held, pa.binary())],
                                             names=["vec_id", "dims", "vector"])

    return table.select(F.col(vec_id).cast("long").alias("vec_id"), embedding).mapInArrow(
        convert, "vec_id long, dims int, vector binary")


def near_vectors(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                 pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row: the other rows within the cosine, and the smallest id reachable."""
    rows = staged(usable_vectors(table, vec_id, embedding), "vectors")
    distinct = staged(
        rows.where("vector IS NOT NULL").groupBy("dims", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
        .withColumn("node", F.coalesce("vec_id", F.xxhash64("vector"))), "distinct")
    # Pivots: at most that many of each length, those with the smallest hashes.
    sizes = [r["dims"] for r in distinct.select("dims").distinct().collect()]
    chosen = {
        d: np.stack(unit_rows([bytes(r["vector"]) for r in distinct.where(F.col("dims") == d).orderBy(
            F.xxhash64("vector", F.lit(7)), "vector").limit(pivots).select("vector").collect()]))
        for d in sizes
    }
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(chosen)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7

    def own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit_rows([batch.column(1)[i].as_py() for i in at.tolist()])
                distance = np.sqrt(np.maximum(0, 2 - 2 * x @ shared.value[d].T))
                cells[at], away[at] = distance.argmin(1), distance.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    placed = staged(distinct.select("dims", "vector", "node", "n").mapInArrow(
        own_cells, "dims int, vector binary, node long, n long, cell long, away double"), "cells")
    # A row for each cell: how many chunks its own vectors need, and how far they reach.
    reach = {(r["dims"], r["cell"]): (-(-r["k"] // chunk), r["far"]) for r in placed.groupBy("dims", "cell").agg(
        F.count("*").alias("k"), F.max("away").alias("far")).collect()}
    reach_shared = spark.sparkContext.broadcast(reach)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reach_shared.value
        for batch in batches:
            dims, cells, nodes = (batch.column(i).to_numpy() for i in (0, 4, 2))
            row, cell, part, own = [], [], [], []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit_rows([batch.column(1)[i].as_py() for i in at.tolist()])
                distance = np.sqrt(np.maximum(0, 2 - 2 * x @ shared.value[d].T))
                home = distance[np.arange(len(at)), cells[at]]
                for j in range(distance.shape[1]):
                    if (d, j) not in known:
                        continue
                    chunks, far = known[(d, j)]
                    goes = (cells[at] == j) | ((distance[:, j] - home <= 2 * radius) & (distance[:, j] <= far + radius))
                    for k in range(chunks):
                        here = at[goes]
                        mine = (cells[here] == j) & ((nodes[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(chunks) == k)
                        row.append(here)
                        cell.append(np.full(len(here), j))
                        part.append(np.full(len(here), k))
                        own.append(mine)
            if row:
                row, cell, part, own = (np.concatenate(x) for x in (row, cell, part, own))
                for a in range(0, len(row), 8192):
                    z = slice(a, a + 8192)
                    taken = batch.select(["dims", "vector", "node", "n"]).take(pa.array(row[z]))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cell[z]), pa.array(part[z]), pa.array(~own[z])],
                        names=["dims", "vector", "node", "n", "cell", "part", "foreign"])

    def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the own vectors of a cell's part, then the others, which only pass by."""
        now, own, own_nodes, own_n, links, seen, label = None, None, None, None, None, [], None

        def finished():
            if now is None or own is None:
                return
            nodes, count, edges = own_nodes, links, seen
            linked = np.flatnonzero(label != np.arange(len(label)))
            a = np.concatenate([nodes, nodes[linked], np.array([k for k, _ in edges], np.int64)])
            b = np.concatenate([nodes, nodes[label[linked]], np.array([v for _, v in edges], np.int64)])
            n = np.concatenate([count, np.zeros(len(linked) + len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n_links"])

        def near(x, y):
            close = x @ y.T
            found = close >= cosine
            doubt = np.argwhere(np.abs(close - cosine) < DOUBT)
            for i, j in doubt:
                found[i, j] = float(np.sum(x[i] * y[j])) >= cosine
            return found

        pending: list = []

        def settle():
            """The own vectors are complete: join them with one another."""
            nonlocal own, own_nodes, own_n, links, label, pending
            if own is not None or not pending:
                return
            own = np.concatenate([p[0] for p in pending])
            own_nodes, own_n = (np.concatenate([p[k] for p in pending]) for k in (1, 2))
            pending = []
            links, label = np.zeros(len(own), np.int64), np.arange(len(own))
            for a in range(0, len(own), STRIP):
                found = near(own[a : a + STRIP], own)
                links[a : a + STRIP] += found @ own_n
                i, j = np.nonzero(found)
                keep = i + a < j
                if keep.any():
                    label[:] = smallest_labels(len(own), i[keep] + a, j[keep], label.copy())

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4, 5, 6)], 1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, z in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
                if a == z:
                    continue
                key, foreign = tuple(keys[a, :3].tolist()), bool(keys[a, 3])
                if key != now:
                    settle()
                    yield from finished()
                    now, own, own_nodes, own_n, links, seen, label, pending = key, None, None, None, None, [], None, []
                part = batch.slice(a, z - a)
                x = unit_rows(part.column(1).to_pylist())
                nodes, n = part.column(2).to_numpy(), part.column(3).to_numpy()
                if not foreign:
                    pending.append((x, nodes, n))
                    continue
                settle()
                if own is None:
                    continue
                for s in range(0, len(x), STRIP):
                    found = near(own, x[s : s + STRIP])
                    links += found @ n[s : s + STRIP]
                    i, j = np.nonzero(found)
                    if len(i):
                        # One edge for each that passes by, and the own vectors it joins come together.
                        size = len(own)
                        label = smallest_labels(size + found.shape[1], i, j + size, np.concatenate([label, size + np.arange(found.shape[1])]))
                        joined = np.unique(j)
                        seen += list(zip(nodes[s + joined].tolist(), own_nodes[label[size + joined]].tolist()))
                        label = label[:size]
        settle()
        yield from finished()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = staged(
        placed.select("dims", "vector", "node", "n", "cell", "away").mapInArrow(
            copies, "dims int, vector binary, node long, n long, cell long, part long, foreign boolean")
        .repartition(parts, "dims", "cell", "part").sortWithinPartitions("dims", "cell", "part", "foreign")
        .mapInArrow(join_cells, "a long, b long, n_links long"), "links")
    counts = met.where("a = b").groupBy("a").agg(F.sum("n_links").alias("n_links"))
    joined = components(met.select("a", "b"))
    groups = distinct.join(counts, distinct.node == counts.a).join(joined, "node", "left").select(
        "dims", "vector", (F.col("n_links") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    names = distinct.select("node", "vec_id").join(joined, "node", "left").groupBy(
        F.coalesce("component", "node").alias("component")).agg(F.min("vec_id").alias("component_id"))
    named = groups.join(names, "component").select(
        F.col("dims").alias("_dims"), F.col("vector").alias("_vector"), "n_links", "component_id")
    return rows.join(named, (rows.dims == named._dims) & (rows.vector == named._vector), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
