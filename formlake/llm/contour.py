"""The largest eigenvalues of a symmetric matrix and their vectors, by contour integration.

An interval that holds the wanted eigenvalues is found by counting: by Sylvester's law of inertia the positive pivots of a symmetric
factorisation of A - s I are as many as the eigenvalues above s. The projector on the interval's eigenvectors is an integral of
(z I - A)^-1 around it, taken as a quadrature of some complex shifted solves; of the subspace that it makes, Rayleigh and Ritz's method takes
the pairs, and both are repeated until the residuals are rounding errors. At last the pairs in the interval must be as many as counted.
"""

from __future__ import annotations

import numpy as np

#: Points of the quadrature on the upper half of the contour, rounds of projection at most, halvings of an interval at most.
POINTS, ROUNDS, HALVINGS = 16, 100, 60
#: What decides between a pivot of one and of two rows (Bunch and Parlett).
_ALPHA = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above `shift`: the positive ones of the pivots of a factorisation of a - shift I with whole pivoting."""
    a = a - shift * np.eye(len(a))
    above = 0
    while len(a):
        n = len(a)
        d = np.abs(np.diag(a))
        k = int(d.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), n)
        if d[k] == 0 and off[p, q] == 0:
            return above
        if n == 1 or d[k] >= _ALPHA * off[p, q]:
            rest = np.delete(np.arange(n), k)
            above += a[k, k] > 0
            c = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(c, c) / a[k, k]
        else:
            # A pivot of two rows has one positive and one negative eigenvalue.
            rest = np.delete(np.arange(n), [p, q])
            above += 1
            c = a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(a[np.ix_([p, q], [p, q])], c.T)
    return int(above)


def lower_end(a: np.ndarray, k: int, high: float) -> tuple[float, int]:
    """A place below the k-th largest eigenvalue with as much room as there is before the next one, and the eigenvalues above it (more than k where the k-th has equals). high: above all eigenvalues, which are not negative."""
    low, top, floor = -1e-3 * high, high, -1e-3 * high
    counted = len(a)
    for _ in range(HALVINGS):
        mid = (low + top) / 2
        n = count_above(a, mid)
        if n == k:
            # A gap: its two ends are found apart, and its middle is the place.
            up, down = (mid, top), (low, mid)
            for _ in range(8):
                x = sum(up) / 2
                up = (x, up[1]) if count_above(a, x) == k else (up[0], x)
                x = sum(down) / 2
                down = (down[0], x) if count_above(a, x) == k else (x, down[1])
            return (up[0] + down[1]) / 2, k
        low, top, counted = (mid, top, n) if n > k else (low, mid, counted)
    return (low, counted) if low > floor else (floor, len(a))


def top_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix without negative ones, in falling order, and their unit vectors as columns."""
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    high = 1.001 * scale
    low, inside = lower_end(a, k, high)
    # The interval's upper end comes near the largest eigenvalue: the narrower it is, the sharper it ends.
    below = low
    while high - below > 0.05 * (high - low) and high - low > 1e-3 * scale:
        middle = (below + high) / 2
        below, high = (middle, high) if count_above(a, middle) else (below, middle)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    theta = -(np.pi / 2) * (nodes - 1)
    middle, radius = (low + high) / 2, (high - low) / 2
    solvers = [np.linalg.inv((middle + radius * np.exp(1j * t)) * np.eye(n) - a) for t in theta]
    random = np.random.default_rng(13)
    y = random.standard_normal((n, min(n, 2 * inside + 8)))
    last, worst, found = np.inf, np.inf, -1
    for _ in range(ROUNDS):
        projected = sum(w / 2 * (radius * np.exp(1j * t) * (s @ y)).real for w, t, s in zip(weights, theta, solvers, strict=True))
        q, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(q.T @ a @ q)
        y = q @ small
        ours = values > low
        worst = np.linalg.norm(a @ y[:, ours] - y[:, ours] * values[ours], axis=0).max(initial=0) / scale
        found = int(ours.sum())
        if found == inside and (worst <= 1e-15 or worst > 0.7 * last and worst <= 1e-13):
            break
        if (found < inside or worst > 0.7 * last) and y.shape[1] < n:
            # Too slow, or some were missed: a wider subspace with new directions. As wide as the matrix it holds all.
            y = np.concatenate([y, random.standard_normal((n, min(n - y.shape[1], inside + 8)))], axis=1)
        last = worst
    if found != inside or worst > 1e-10:
        raise ArithmeticError(f"{found} eigenvalues were found of {inside} that were counted, with residuals of {worst:.3g}")
    order = np.argsort(-values)[:k]
    return values[order], y[:, order]
