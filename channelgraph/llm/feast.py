"""Leading eigenpairs of a symmetric matrix by contour integration.

Inertia counts on shifted matrices tell how many eigenvalues lie above any number. They are used to cut the upper end of the
spectrum at its gaps into intervals of a few eigenvalues. For each interval the projector on its eigenvectors is a contour
integral of the resolvent; a quadrature of complex shifted solves applies it to a block of vectors, and a Rayleigh-Ritz
step on their span gives the eigenpairs. It is repeated until they are exact to double precision and as many as were
counted.
"""

from __future__ import annotations

import numpy as np

NODES, GROUP, ROUNDS = 8, 8, 60


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues (Householder reflections)."""
    a = np.array(a, dtype=np.float64)
    n = len(a)
    for i in range(n - 2):
        x = a[i + 1 :, i].copy()
        norm = np.sqrt((x * x).sum())
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.sqrt((x * x).sum())
        below = a[i + 1 :, i:]
        below -= 2 * np.outer(x, x @ below)
        right = a[i:, i + 1 :]
        right -= 2 * np.outer(right @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are greater than each shift: the positive pivots of the shifted matrix, whose entries are about 1."""
    tiny = np.finfo(float).eps * 1e-6
    pivot = diagonal[0] - shifts
    count = np.zeros(len(shifts), dtype=np.int64)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def _located(diagonal: np.ndarray, off: np.ndarray, low: float, high: float, steps: int = 44) -> np.ndarray:
    """All eigenvalues, the greatest first, by bisection with inertia counts."""
    n = len(diagonal)
    a, b = np.full(n, low), np.full(n, high)
    want = np.arange(1, n + 1)
    for _ in range(steps):
        middle = (a + b) / 2
        above = count_above(diagonal, off, middle) >= want
        a, b = np.where(above, middle, a), np.where(above, b, middle)
    return (a + b) / 2


def _intervals(values: np.ndarray, wanted: int, low: float, high: float) -> list[tuple[float, float]]:
    """Intervals around groups of neighbouring eigenvalues, from the top down: GROUP at most in each where gaps allow it.

    An interval is about as wide as its group, so that its ends are clear of the eigenvalues on both sides.
    """
    out, at, n = [], 0, len(values)
    gaps = np.append(values[:-1] - values[1:], np.inf)
    least = 1e-9 * (high - low)
    above = np.inf
    while at < min(wanted, n):
        ends = np.arange(at, min(at + GROUP, n))
        end = int(ends[np.argmax(gaps[ends])])
        while gaps[end] <= least and end < n - 1:
            end += 1
        below, spread = float(gaps[end]), float(values[at] - values[end])
        up, down = min(above / 2, max(spread, below / 2)), min(below / 2, max(spread, above / 2))
        out.append((max(low, float(values[end]) - down), min(high, float(values[at]) + up)))
        at, above = end + 1, below
    return out


def _interval(v: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator, exact: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between two numbers that are no eigenvalues."""
    n = len(v)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(-1j * np.pi / 2 * (nodes - 1))
    middle, radius = (low + high) / 2, (high - low) / 2
    shifted = [np.linalg.inv((middle + radius * t) * np.eye(n) - v) for t in turn]
    block, true = rng.standard_normal((n, min(n, count + max(4, count // 2)))), np.zeros(1, dtype=bool)
    for _ in range(ROUNDS if count else 0):
        projected = sum(w / 2 * np.real(radius * t * (s @ block)) for w, t, s in zip(weights, turn, shifted, strict=True))
        # what the projector takes away is rounding error only and must not come back as a direction
        q, kept, _ = np.linalg.svd(projected, full_matrices=False)
        q = q[:, kept > 1e-8 * kept[0]]
        ritz, inner = np.linalg.eigh(q.T @ v @ q)
        block = q @ inner
        # mixtures of vectors from both sides can have Ritz values inside, but are no eigenvectors
        true = (ritz > low) & (ritz < high) & (np.abs(v @ block - block * ritz).max(axis=0) <= exact)
        if true.sum() == count:
            return ritz[true], block[:, true]
    raise ArithmeticError(f"{int(true.sum())} of {count} eigenvalues found between {low} and {high}")


def leading(v: np.ndarray, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors as columns; all where there are fewer.

    Each vector's largest component (the first of equals) is positive.
    """
    n = len(v)
    if not n or not wanted:
        return np.zeros(0), np.zeros((n, 0))
    size = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is greater
    if size == 0:
        return np.zeros(min(n, wanted)), np.eye(n)[:, :wanted]
    v = v / size
    diagonal, off = tridiagonal(v)
    low, high = -1.01, 1.01
    ends = _intervals(_located(diagonal, off, low, high), wanted, low, high)
    counts = count_above(diagonal, off, np.array(ends).ravel()).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    found = [_interval(v, a, b, int(more - less), rng, 1e3 * np.finfo(float).eps) for (a, b), (more, less) in zip(ends, counts, strict=True)]
    # one more Rayleigh-Ritz step over all intervals makes the vectors orthogonal to each other
    q, _ = np.linalg.qr(np.concatenate([f[1] for f in found], axis=1))
    values, inner = np.linalg.eigh(q.T @ v @ q)
    if len(values) != counts[-1, 0]:
        raise ArithmeticError(f"{len(values)} of {counts[-1, 0]} eigenvalues found")
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], (q @ inner)[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values * size, vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1, 1)
