"""Embedding whitening: principal components by contour integration, every vector projected on them with variance one.

The entries of a vector become whole numbers, floor(GRID * c) + OFFSET. The model is fitted on every distinct vector once, all of
them: exact sums per dimension, then the covariance of the vectors less their mean, both added up in the tasks that read the
vectors (a task sends as many rows as a vector has entries, or pairs of them). The driver holds one matrix of the vector's length
squared. ``feast`` places intervals by inertia counts; each interval is solved in a task of its own. Projection is one pass without a shuffle.

Vectors of each length are a space of their own, with its own model. Defined results: NULL and empty vectors and those with
NULL or non-finite entries give no rows; entries beyond LARGEST / GRID count as that; repeated rows and ids are projected each; a
component without variance (fewer distinct vectors than components) has NULL ``whitened`` and ``explained`` 0, NULL if nothing
varies; a ``deviation`` past 63 bits is NULL, ``deviation_exact`` keeps it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import feast
from palimpsest.plans.staging import staged

GRID = 64
OFFSET = 1_000_000
LARGEST = 4e18
COMPONENTS = 16
# Rows of a block inside a task.
STRIP = 4096


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: their number, sums, centres (whole part and rest of the mean), and components as columns."""

    n: int
    sums: tuple[int, ...]
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: a whole number exactly, then the fraction."""
        return (x - self.whole).astype(np.float64) - self.rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - S) ** 2 of every row, exact."""
        left = [s - self.n * w for s, w in zip(self.sums, self.whole.tolist())]
        apart = x - self.whole
        most = self.n * int(np.abs(apart).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * apart - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = self.n * apart.astype(object) - np.array(left, dtype=object)
        return (exact * exact).sum(1).tolist()


def grid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dims, x) of the usable rows."""
    c = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    scaled = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * float(GRID), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(OFFSET))
    kept = table.where((F.size(embedding) > 0) & finite)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("dims"), scaled.alias("x"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Runs of rows of one length, with their numbers as a matrix; columns ``dims`` and ``x``."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            rows = batch if (dims == d).all() else batch.filter(pa.array(dims == d))
            for a in range(0, rows.num_rows, STRIP):
                part = rows.slice(a, STRIP)
                yield d, part.column("x").flatten().to_numpy().reshape(-1, d), part


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """By length: the number of vectors and the sums per dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for d, x, _ in blocks(batches):
            one = held.setdefault(d, [0, np.zeros(d, object)])
            one[0] += len(x)
            # High and low halves, so that no sum of a block passes 63 bits.
            one[1] = one[1] + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)),
                 pa.array([Decimal(v) for v in s.tolist()], pa.decimal128(38, 0))], names=["dims", "at", "n", "s"])

    rows = distinct.select("dims", "x").mapInArrow(add, "dims int, at int, n long, s decimal(38,0)").groupBy("dims", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dims", "at").collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    return {d: (n, tuple(s)) for d, (n, s) in found.items()}


def added_products(distinct: DataFrame, seen) -> DataFrame:
    """(dims, i, j, v): sums of the products of all pairs (j >= i) of what ``seen(dims, x)`` gives for each vector."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, x, _ in blocks(batches):
            y = seen(d, x)
            held[d] = held.get(d, 0.0) + y.T @ y
        for d, g in held.items():
            for i in range(len(g)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([g[i, i:]], pa.list_(pa.float64()))], names=["dims", "i", "v"])

    rows = distinct.select("dims", "x").mapInArrow(multiply, "dims int, i int, v array<double>")
    return rows.select("dims", "i", F.posexplode("v").alias("j", "v")).groupBy("dims", "i", "j").agg(F.sum("v").alias("v"))


def matrices(products: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The symmetric matrices of ``added_products`` by length, ``sizes`` rows each."""
    found = {d: np.zeros((k, k)) for d, k in sizes.items()}
    for batch in products.toArrow().to_batches():
        dims, i, j, v = (batch.column(c).to_numpy() for c in ("dims", "i", "j", "v"))
        for d in np.unique(dims).tolist():
            at = dims == d
            found[d][i[at], i[at] + j[at]] = v[at]
            found[d][i[at] + j[at], i[at]] = v[at]
    return found


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length; ``distinct`` holds each vector once, as (dims, x)."""
    spark = distinct.sparkSession
    models = {}
    for d, (n, sums) in exact_sums(distinct).items():
        whole = [round(Fraction(s, n)) for s in sums]
        rest = [float(Fraction(s - n * w, n)) for s, w in zip(sums, whole)]
        models[d] = Model(n, sums, np.array(whole, np.int64), np.array(rest), np.zeros(0), np.zeros((d, 0)), 0.0)
    centres = spark.sparkContext.broadcast(models)
    covariance = {
        d: g / models[d].n
        for d, g in matrices(added_products(distinct, lambda d, x: centres.value[d].centred(x)), {d: d for d in models}).items()
    }
    shared = spark.sparkContext.broadcast(covariance)
    parts = [(d, float(p.low), float(p.high), p.count, p.first) for d, v in covariance.items() for p in feast.intervals(v, min(components, d))]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, *interval in zip(*(c.to_pylist() for c in batch.columns)):
                values, vectors = feast.solve_interval(shared.value[d], feast.Interval(*interval))
                first = interval[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), d, np.int32)), pa.array(np.arange(first, first + len(values), dtype=np.int32)),
                     pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["dims", "component", "value", "vector"])

    solved: dict[int, list] = {d: [] for d in models}
    if parts:
        todo = spark.createDataFrame(parts, "dims int, low double, high double, count int, first int").repartition(len(parts))
        for r in todo.mapInArrow(solve, "dims int, component int, value double, vector array<double>").orderBy("dims", "component").collect():
            solved[r["dims"]].append((r["value"], r["vector"]))
    for d, m in models.items():
        pairs = solved[d][: min(components, d)]
        models[d] = Model(m.n, m.sums, m.whole, m.rest, np.array([e for e, _ in pairs]),
                          np.array([v for _, v in pairs]).reshape(-1, d).T, float(np.trace(covariance[d])))
    return {d: _checked(m, e) for (d, m), e in zip(models.items(), identity_errors(distinct, models))}


def _checked(m: Model, error: float | None) -> Model:
    return Model(m.n, m.sums, m.whole, m.rest, m.values, m.vectors, m.trace, error)


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> list[float | None]:
    """By model: how far the covariance of the whitened vectors is from the identity at most.

    A column of ones beside them gives the sums; the whitened vectors are centred already, what is left of their mean goes off.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def seen(d: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([shared.value[d].project(x), np.ones((len(x), 1))], axis=1)

    held = matrices(added_products(distinct, seen), {d: len(m.values) + 1 for d, m in models.items()})
    errors = []
    for d, m in models.items():
        mean = held[d][-1, :-1] / m.n
        away = np.abs(held[d][:-1, :-1] / m.n - np.outer(mean, mean) - np.eye(len(m.values)))
        errors.append(float(away.max()) if away.size else None)
    return errors


def whiten(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact), a row for each vector and component."""
    rows = grid_vectors(table, vec_id, embedding)
    distinct = staged(rows.select("dims", "x").distinct(), "distinct-vectors")
    shared = table.sparkSession.sparkContext.broadcast(fit(distinct, components))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, part in blocks(batches):
            model = shared.value[d]
            k, found = min(components, d), len(model.values)
            whitened = np.zeros((len(x), k))
            whitened[:, :found] = model.project(x)
            exact = model.deviations(x)
            share = [*(model.values / model.trace).tolist(), *[0.0] * (k - found)] if model.trace > 0 else [None] * k
            missing = np.tile(np.arange(k) >= found, len(x))
            repeated = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(repeated)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, model.n)),
                pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(repeated)),
                pa.array(whitened.ravel(), mask=missing), pa.array(share * len(x), pa.float64()),
                pa.array([model.identity_error] * (len(x) * k), pa.float64()),
                pa.array([str(v) for v in exact]).take(pa.array(repeated)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                    "identity_error double, deviation_exact string")
