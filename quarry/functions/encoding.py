"""Run-length, delta, varint and tensor-train encodings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta_encode(df: DataFrame, group: list[str], order: str, value: str, out: str = "delta") -> DataFrame:
    """Differences from the value before; the first keeps its value."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decode(df: DataFrame, group: list[str], order: str, delta: str = "delta", out: str = "value") -> DataFrame:
    return df.withColumn(out, F.sum(delta).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def run_lengths(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: group, run (from 0), value, run_length, run_start."""
    w = Window.partitionBy(*group).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*group, "run", value).agg(F.count(F.lit(1)).alias("run_length"), F.min(order).alias("run_start"))


def run_expand(runs: DataFrame, length: str = "run_length") -> DataFrame:
    return runs.withColumn("at", F.explode(F.expr(f"sequence(0L, {length} - 1)")))


def varint(c: Column) -> Column:
    """Non-negative integers of an array<long> as LEB128 bytes."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for values in batch:
                data = bytearray()
                for v in values if values is not None else ():
                    v = int(v)
                    while v > 127:
                        data.append(v & 127 | 128)
                        v >>= 7
                    data.append(v)
                out.append(bytes(data))
            yield pd.Series(out)

    return encode(c)


def unvarint(c: Column) -> Column:
    @F.pandas_udf("array<long>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for data in batch:
                values, v, shift = [], 0, 0
                for b in data or b"":
                    v |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        values.append(v)
                        v = shift = 0
                out.append(values)
            yield pd.Series(out)

    return decode(c)


def tt_cores(v: np.ndarray, shape: tuple[int, ...], rank: int) -> list[np.ndarray]:
    """Tensor-train cores of a vector folded to shape, by truncated SVDs from the left."""
    rest, left, cores = np.asarray(v, float).reshape(1, -1), 1, []
    for n in shape[:-1]:
        u, s, vt = np.linalg.svd(rest.reshape(left * n, -1), full_matrices=False)
        k = max(1, min(rank, int((s > 1e-12).sum())))
        cores.append(u[:, :k].reshape(left, n, k))
        rest, left = s[:k, None] * vt[:k], k
    return [*cores, rest.reshape(left, shape[-1], 1)]


def tt_vector(cores: list[np.ndarray]) -> np.ndarray:
    out = cores[0]
    for core in cores[1:]:
        out = np.tensordot(out, core, axes=1)
    return out.reshape(-1)


def tt_dot(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Inner product in tensor-train form, without unfolding."""
    m = np.ones((1, 1))
    for x, y in zip(a, b, strict=True):
        m = np.einsum("ij,ink,jnl->kl", m, x, y)
    return float(m[0, 0])


def tt_cosine(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    n = (tt_dot(a, a) * tt_dot(b, b)) ** 0.5
    return tt_dot(a, b) / n if n else 0.0


def tt_compressed(c: Column, shape: tuple[int, ...], rank: int) -> Column:
    """array<float> -> its tensor-train approximation of the given rank, and the number of values kept."""

    @F.pandas_udf("kept int, approx array<double>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cores = [tt_cores(v, shape, rank) for v in batch]
            yield pd.DataFrame({"kept": [sum(x.size for x in k) for k in cores], "approx": [tt_vector(k) for k in cores]})

    return fold(c)
