"""Embedding whitening from an exact integer scatter.

Entries become integers, floor(SCALE * entry). The fit list has each distinct vector once. A shift, any vector of the
list, is subtracted; each task adds up sums and cross-products of its rows in digits of 18 bits, whose products are
whole numbers below 2^53, so that matrix products of floats are exact; digits are added in Spark as longs and put
together in integers of any length. n XᵀX - SSᵀ is formed in integers and turned into floats only for eigh.

The driver gets sums over dimension pairs, which don't grow with the rows; rows stay in Arrow batches of bounded bytes.

Defined results: rows whose vector is null or has a null or non-finite entry are left out, and so are vectors of
another length than most of the rest (ties: the longest); null ids are kept; repeated rows give rows again, and count
once in the fit; entries beyond the range of a long are held at its end; components of no variance are left out, so
that a single distinct vector, an empty vector and an empty table give an empty result. deviation is null beyond 38
digits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import Batches, bounded_batches, materialize

SCALE = 256
#: Bits of a digit, rows of a block: products of digits stay below 2^34, their sums over a block below 2^51.
BITS, ROWS = 18, 1 << 16
HALF, MASK = 1 << (BITS - 1), (1 << BITS) - 1
#: Sums of a task that reach this are carried into the next digits.
CARRY = 1 << 60
#: Integers beyond this leave numpy's longs.
SAFE = 1 << 62
#: A component needs more than this share of the largest variance; below it, floats can't tell it from none.
LEAST = 1e-13


@dataclass
class Fit:
    """Exact moments of the fit list about the shift, and the leading components of its covariance."""

    n: int
    shift: list[int]
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integer_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """rows with x, the vector's integers, without rows that have none; all x are of one length."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = rows.filter(good).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))
    lengths = whole.groupBy(F.size("x").alias("_length")).agg(F.count(F.lit(1)).alias("_rows"))
    usual = lengths.agg(F.max_by("_length", F.struct("_rows", "_length")).alias("_usual"))
    return whole.join(F.broadcast(usual), F.size("x") == F.col("_usual")).drop("_usual")


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The rows of a list column, none of which is null."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, in Python's integers where longs might overflow."""
    if len(x) and max(int(x.max()), -int(x.min()), *map(abs, shift)) >= SAFE // 2:
        return x.astype(object) - np.array(shift, object)
    return x - np.array(shift, np.int64)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Floats of signed digits, lowest first: y is the sum of digit k times 2^(BITS k)."""
    out = []
    while True:
        low = ((y + HALF) & MASK) - HALF
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
        if not y.any():
            return out


def cross_sums(blocks: Iterator[np.ndarray], width: int) -> dict[int, np.ndarray]:
    """Cross-products of the columns of all blocks: the sum over k of longs[k] times 2^(BITS k), exactly.

    A block has a last column of ones beside its integers, so that its cross-products have sums and the count, too.
    """
    total: dict[int, np.ndarray] = {}

    def add(k: int, part: np.ndarray) -> None:
        have = total[k] = total.get(k, 0) + part
        if np.abs(have).max(initial=0) >= CARRY:
            low = ((have + HALF) & MASK) - HALF
            total[k] = low
            add(k + 1, (have - low) >> BITS)

    for block in blocks:
        for low in range(0, len(block), ROWS):
            y = block[low : low + ROWS]
            parts = digits(np.concatenate([y, np.ones((len(y), 1), y.dtype)], axis=1))
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    add(i + j, (a.T @ b).astype(np.int64))
    return total


def scatter(fit: DataFrame, shift: list[int]) -> list[list[int]]:
    """The (d + 1) by (d + 1) cross-products of (x - shift, 1) over fit, as Python's integers."""
    d = len(shift)

    def sums(batches: Batches) -> Batches:
        total = cross_sums((shifted(matrix(b.column(0), d), shift) for b in batches), d + 1)
        for k, longs in total.items():
            for i in range(d + 1):  # a row of the matrix is a batch
                row = longs[i, i:]
                low = row & 0xFFFFFFFF  # two halves, so that sums over tasks stay longs
                cells = np.arange(i * (d + 1) + i, (i + 1) * (d + 1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), k, np.int64)), pa.array(low), pa.array((row - low) >> 32)], ["cell", "k", "low", "high"])

    parts = fit.select("x").mapInArrow(sums, "cell long, k long, low long, high long").groupBy("cell", "k").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in parts.toLocalIterator():  # as many as pairs of dimensions, whatever the rows
        i, j = divmod(r["cell"], d + 1)
        out[i][j] += (r["low"] + (r["high"] << 32)) << (BITS * r["k"])
        out[j][i] = out[i][j]
    return out


def fitted(cross: list[list[int]], shift: list[int], components: int) -> Fit:
    """n XᵀX - SSᵀ in integers, then the components of largest variance with positive variance."""
    d, n = len(shift), cross[-1][-1]
    sums = cross[-1][:d]
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact], np.float64).reshape(d, d)  # quotients of integers, rounded once
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = [i for i in order if values[i] > 0 and values[i] > LEAST * values.max()]
    return Fit(n, shift, sums, values[order], vectors[:, order], sum(exact[i][i] for i in range(d)) / (n * n))


def deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n y - sums, exactly."""
    most = max((int(y.max()), -int(y.min()), 1)) if y.size else 1
    if y.dtype == object or n * most + max(map(abs, sums), default=0) >= SAFE:
        return y.astype(object) * n - np.array(sums, object)
    return y * n - np.array(sums, np.int64)


def squares(z: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly: in longs of 24-bit parts where the entries allow it."""
    most = max(int(z.max()), -int(z.min())) if z.size else 0
    if z.dtype == object or most >= 1 << 50 or z.shape[1] > 1 << 10:
        return [sum(int(v) * int(v) for v in row) for row in z]
    high, low = z >> 24, z & ((1 << 24) - 1)
    parts = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
    return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*parts, strict=True)]


def whitened(z: np.ndarray, fit: Fit) -> np.ndarray:
    """Rows n y - sums, centred before anything is rounded, on the components, in units of their deviation."""
    return (z.astype(np.float64) / fit.n) @ fit.vectors / np.sqrt(fit.values)


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, k = len(model.shift), len(model.values)

    def moments(batches: Batches) -> Batches:
        for b in batches:
            w = whitened(deviations(shifted(matrix(b.column(0), d), model.shift), model.n, model.sums), model)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2)), pa.array((w.T @ w).ravel())], ["cell", "value"])

    sums = fit.select("x").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (k + 1)^2 rows
    have = np.zeros((k + 1) ** 2)
    for r in sums:
        have[r["cell"]] = r["value"]
    have = have.reshape(k + 1, k + 1) / model.n
    return float(np.abs(have[:k, :k] - np.outer(have[k, :k], have[k, :k]) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(spark: SparkSession, rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """For each vector and component: identifier, component from 1, n, deviation, whitened, explained, identity_error."""
    bounded_batches(spark)
    kept = materialize(spark, integer_vectors(rows.select(identifier, vector), vector, scale).select(identifier, "x"), "vectors")
    fit = materialize(spark, kept.select("x").distinct(), "fit")
    kind = kept.schema[identifier].dataType.simpleString()
    schema = f"`{identifier}` {kind}, {SCHEMA}"
    first = fit.first()
    model = fitted(scatter(fit, first["x"]), first["x"], components) if first and first["x"] else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, d, k = identity_error(fit, model), len(model.shift), len(model.values)
    explained, digits_38 = model.values / model.trace, 10**38

    def project(batches: Batches) -> Batches:
        for b in batches:
            z = deviations(shifted(matrix(b.column(1), d), model.shift), model.n, model.sums)
            exact = [v if v < digits_38 else None for v in squares(z)]
            size = b.num_rows
            each = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, model.n)), pa.array(exact, pa.decimal128(38, 0)).take(each),
                    pa.array(whitened(z, model).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error)),
                ],
                [identifier, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select(identifier, "x").mapInArrow(project, schema)
