"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

A matrix is reduced to a tridiagonal one; the signs of the pivots of T - s give its inertia, the number of eigenvalues above s.
Counts place the borders of intervals in gaps of the spectrum. For one interval the quadrature of shifted solves over a circle through its ends,
(1 / 2 pi i) of the integral of (z - V)^-1 Y dz, projects Y onto the eigenvectors inside; Rayleigh-Ritz extracts them, and the
pass repeats until the residuals are rounding. An interval whose Ritz values differ from its inertia count is done again with
a larger subspace, so none is missed. Intervals don't know of one another and can run as tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NODES = 8
GROUP = 8
ROUNDS = 24


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by reflections."""
    a = np.array(v, np.float64)
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not np.any(x[1:]) or size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        q = 2 * (p - (x @ p) * x)
        rest -= np.outer(x, q) + np.outer(q, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, beside: np.ndarray, s: float) -> int:
    """The number of eigenvalues above ``s``: positive pivots of the tridiagonal matrix less ``s``."""
    tiny = np.finfo(float).tiny ** 0.5
    squares = (beside * beside).tolist()
    n, pivot = 0, 1.0
    for i, a in enumerate((diagonal - s).tolist()):
        pivot = a - (squares[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


@dataclass(frozen=True)
class Interval:
    """Borders with no eigenvalue near, the number of eigenvalues between, and the number of the largest of them (from 1)."""

    low: float
    high: float
    count: int
    first: int


def intervals(v: np.ndarray, wanted: int, group: int = GROUP) -> list[Interval]:
    """Intervals that hold the ``wanted`` largest eigenvalues which are not zero to rounding, tied ones together."""
    d = len(v)
    diagonal, beside = tridiagonal(v)
    bound = float(np.abs(v).sum(1).max()) if d else 0.0
    floor = bound * d * np.finfo(float).eps
    rank = above(diagonal, beside, floor) if bound > 0 else 0
    if not rank:
        return []

    def place(j: int) -> float:
        """The j-th largest eigenvalue, from counts alone."""
        a, b = 0.0, bound * (1 + 1e-9)
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if above(diagonal, beside, m) >= j else (a, m)
            if b - a <= 1e-13 * bound:
                break
        return (a + b) / 2

    values = [bound * (1 + 1e-6) * 2]
    tie = 1e-9 * bound
    while len(values) - 1 < rank and (len(values) - 1 < wanted or values[-2] - values[-1] <= tie):
        values.append(place(len(values)))
    # One more below, for the last border; a tie there brings its whole group in.
    following = place(len(values)) if len(values) - 1 < rank else floor
    while values[-1] - following <= tie and len(values) - 1 < rank:
        values.append(following)
        following = place(len(values)) if len(values) - 1 < rank else floor
    edges = [*values, min(following, values[-1])]
    gaps = [edges[i] - edges[i + 1] for i in range(1, len(edges) - 1)]  # below the value number i + 1
    found, begin, last = [], 1, len(values) - 1
    high = values[1] + max(values[1] - edges[-1], 0.1 * values[1])
    while begin <= last:
        ends = range(begin, min(begin + group - 1, last) + 1)
        end = last if last - begin < group else max(ends, key=lambda i: (gaps[i - 1] > tie, i > begin + group // 2 - 1, gaps[i - 1]))
        while end < last and gaps[end - 1] <= tie:
            end += 1
        low = (edges[end] + edges[end + 1]) / 2
        found.append(Interval(low, high, end - begin + 1, begin))
        begin, high = end + 1, low
    return found


def solve_interval(v: np.ndarray, part: Interval, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues inside, falling, and their unit vectors as columns."""
    d = len(v)
    scale = float(np.abs(v).sum(1).max())
    x, w = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    middle, radius = (part.low + part.high) / 2, (part.high - part.low) / 2
    eye = np.eye(d)
    size = min(d, 2 * part.count + 4)
    while True:
        y = np.random.default_rng(part.first).standard_normal((d, size))
        best = np.inf
        for _ in range(ROUNDS):
            if size < d:
                q = np.zeros((d, size))
                for turned, weight in zip(turn, w):
                    q += weight / 2 * np.real(radius * turned * np.linalg.solve((middle + radius * turned) * eye - v, y.astype(complex)))
            else:
                q = y
            q, _ = np.linalg.qr(q)
            ritz, mix = np.linalg.eigh(q.T @ v @ q)
            y = q @ mix
            inside = np.flatnonzero((ritz > part.low) & (ritz < part.high))[::-1]
            away = np.linalg.norm(v @ y[:, inside] - y[:, inside] * ritz[inside], axis=0).max(initial=0.0)
            if len(inside) == part.count and (away <= 4e-16 * scale or away >= best / 2):
                break
            best = min(best, away) if len(inside) == part.count else np.inf
        if len(inside) == part.count and away <= 1e-11 * scale:
            break
        if size == d:
            raise ArithmeticError(f"{len(inside)} Ritz values in an interval of {part.count} eigenvalues")
        size = min(d, 2 * size)
    vectors = y[:, inside] / np.linalg.norm(y[:, inside], axis=0)
    # The largest entry of a component is positive.
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(part.count)])
    return ritz[inside], vectors
