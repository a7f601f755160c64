"""Whitening of vectors on their leading components, found by contour integration.

Entries are quantised (256 steps to a unit). Every distinct vector counts once for the fit: its sums, its covariance (centred before it is
multiplied) and the components; all rows are then projected. The covariance has as many numbers as the square of the dimension, whatever the
number of rows: only such matrices reach the driver, where `contour` finds the components.

Rows whose vector is null or holds null, not-a-number or infinite entries are left out. Vectors shorter than the longest are read as if zeros followed.
Rows that repeat come out as often; equal eigenvalues give some orthonormal vectors of their space. A table without rows, or whose vectors
are all equal, has no component and gives no rows; so many components are given as have an eigenvalue above rounding (1e-12 of the
sum). A deviation that no long can hold is null. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.contour import top_pairs
from formlake.llm.durable import checkpointed

#: Components, steps of a unit, the share of all variance that a component has at least.
COMPONENTS, STEPS, LEAST_SHARE = 4, 256, 1e-12


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long): the rows whose entries are all finite, quantised."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.lit(STEPS) * c).cast("long"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of d entries, zeros behind shorter ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


class Whitener:
    """What a fit has found: n and sums of the fit list, components (columns) with their eigenvalues, trace of the covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - sum)^2 over the dimensions, exact."""
        most = max((abs(self.n * int(v) - s) for k, s in enumerate(self.sums) for v in (x[:, k].min(), x[:, k].max())), default=0) if len(x) else 0
        if most * most * len(self.sums) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [e if e < 2**63 else None for e in exact]


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitener:
    """From distinct vectors (x)."""
    d = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    sums = fit_list.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    of = {r.k: int(r.s) for r in sums.collect()}
    n, total = fit_list.count(), [of.get(k, 0) for k in range(d)]
    mean = np.array([s / n for s in total]) if n else np.zeros(d)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            y = _matrix(batch.column("x"), d) - mean
            gram += y.T @ y
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], ["i", "j", "v"])

    v = np.zeros((d, d))
    for r in fit_list.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        v[r.i, r.j] = v[r.j, r.i] = r.v / n
    values, vectors = top_pairs(v, components)
    keep = values > LEAST_SHARE * max(np.trace(v), 0.0)
    return Whitener(n, total, values[keep], vectors[:, keep], float(np.trace(v)))


def _projected(rows: DataFrame, model: Whitener) -> DataFrame:
    """rows (vec_id, x) with deviation and w (array of whitened values)."""
    d = len(model.sums)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            w = sent.value.project(x)
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sent.value.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], ["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(fit_list: DataFrame, model: Whitener) -> float:
    """How far the whitened fit list's covariance is from the identity: the largest absolute entry of the difference."""
    m = len(model.values)
    if not m:
        return 0.0
    w = _projected(fit_list.withColumn("vec_id", F.lit(0)), model).select(*(F.col("w")[k].alias(f"w{k}") for k in range(m)))
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = w.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1 by falling eigenvalue), n, deviation, whitened, explained, identity_error of every finite vector."""
    rows = quantised(vectors)
    fit_list = checkpointed(rows.select("x").distinct())
    model = fit(fit_list, components)
    error = identity_error(fit_list, model)
    found = _projected(rows, model).select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.lit([float(e / model.trace) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    return found.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
