"""Similarity of short texts where SQL has no function for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Texts whose lengths' product is larger are compared by digests of their runs.
SEARCHED = 1 << 24
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _searched(a: str, b: str) -> int:
    """The longest common run of two texts, the first the shorter: a window over it, one longer than the best run so far, is looked for in the other."""
    best = at = 0
    while at + best < len(a):
        end, half = at + best + 1, at + (best + 1) // 2
        # Where not even the window's second half is found, no window that holds all of it can be.
        if best > 3 and a[half:end] not in b:
            at = half + 1
        elif a[at:end] in b:
            best += 1
        else:
            at += 1
    return best


def _meeting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values x and which of y are in both."""
    low = np.uint64((1 << (4 * max(len(x), len(y), 1)).bit_length()) - 1)
    # Most values that are not are told by their low bits.
    seen = np.zeros(int(low) + 1, bool)
    seen[y & low] = True
    in_x = seen[x & low]
    seen[:] = False
    seen[x[in_x] & low] = True
    in_y = seen[y & low]
    both = np.intersect1d(x[in_x], y[in_y])
    in_x[in_x], in_y[in_y] = np.isin(x[in_x], both), np.isin(y[in_y], both)
    return in_x, in_y


def _digested(a: str, b: str) -> int:
    """The longest common run of two texts by 64-bit digests of runs: lengths are doubled as long as one is shared, then the gap is halved. Only places whose shorter runs are shared are looked at."""
    runs = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (a, b)]
    at = [p[shared] for p, shared in zip((np.arange(len(a)), np.arange(len(b))), _meeting(*runs), strict=True)]
    if not len(at[0]):
        return 0
    live = [np.zeros(len(r), bool) for r in runs]

    def longer(by: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The places and digests of shared runs that are made of one at a place and of one that begins `by` further on."""
        starts = [p[p + by < len(r)] for p, r in zip(at, runs, strict=True)]
        starts = [p[on[p + by]] for p, on in zip(starts, live, strict=True)]
        digests = [r[p] * _ODD[0] + r[p + by] * _ODD[1] for p, r in zip(starts, runs, strict=True)]
        digests = [(h ^ (h >> np.uint64(32))) * _ODD[0] for h in digests]
        shared = _meeting(*digests)
        return [p[s] for p, s in zip(starts, shared, strict=True)], [h[s] for h, s in zip(digests, shared, strict=True)]

    size = 1
    while True:
        for on, p in zip(live, at, strict=True):
            on[:] = False
            on[p] = True
        places, digests = longer(size)
        if not len(places[0]):
            break
        at, size = places, 2 * size
        for r, p, h in zip(runs, at, digests, strict=True):
            r[p] = h
    best, step = size, size // 2
    while step:
        places, _ = longer(best + step - size)
        if len(places[0]):
            at, best = places, best + step
        step //= 2
    return best


def _longest(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    return len(a) if a in b else _searched(a, b) if len(a) * len(b) <= SEARCHED else _digested(a, b)


@F.arrow_udf(IntegerType())
def common_run(a: pa.Array, b: pa.Array) -> pa.Array:
    """Characters of the longest run that two texts share; null where one is null."""
    return pa.array([None if x is None or y is None else _longest(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def common_run_ratio(a: Column, b: Column) -> Column:
    """Length of the longest common run over the shorter text; 0 where either is empty or null."""
    shorter = F.least(F.length(a), F.length(b))
    return F.coalesce(F.when(shorter > 0, common_run(a, b) / shorter), F.lit(0.0))
