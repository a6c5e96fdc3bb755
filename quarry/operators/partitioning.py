"""Placement of rows over partitions, and measures of how even and how local it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def placed(df: DataFrame, how: str, n: int, *keys: str) -> DataFrame:
    """df over n partitions by hash, by range, or by key modulo n."""
    if how == "hash":
        return df.repartition(n, *keys)
    if how == "range":
        return df.repartitionByRange(n, *keys)
    if how == "modular":
        return df.withColumn("_m", F.pmod(F.col(keys[0]).cast("long"), F.lit(n))).repartition(n, "_m").drop("_m")
    raise ValueError(f"unknown placement {how}")


def shard_of(df: DataFrame, how: str, n: int, key: str, bounds: list | None = None, out: str = "shard") -> DataFrame:
    """df with the number of each row's shard: hash, modular, or range between the given bounds."""
    if how == "hash":
        return df.withColumn(out, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    if how == "modular":
        return df.withColumn(out, F.pmod(F.col(key).cast("long"), F.lit(n)).cast("int"))
    if how == "range":
        edges = F.array(*[F.lit(b) for b in bounds])
        return df.withColumn(out, F.size(F.filter(edges, lambda b: b <= F.col(key))))
    raise ValueError(f"unknown placement {how}")


def skew(sharded: DataFrame, n: int, shard: str = "shard") -> DataFrame:
    """One row: rows, largest shard, mean over all n shards, and their ratio (1 is even)."""
    sizes = sharded.groupBy(shard).agg(F.count(F.lit(1)).alias("_n"))
    out = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest"))
    return out.withColumn("mean", F.col("rows") / n).withColumn("skew", F.when(F.col("rows") > 0, F.col("largest") / F.col("mean")).otherwise(1.0))


def edge_cut(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """One row: edges, those whose ends (id, shard in placement) lie apart, and their share."""
    a, b = placement.select(F.col("id").alias("src"), F.col("shard").alias("_a")), placement.select(F.col("id").alias("dst"), F.col("shard").alias("_b"))
    both = edges.join(a, "src").join(b, "dst")
    out = both.agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("cut"))
    return out.withColumn("share", F.when(F.col("edges") > 0, F.col("cut") / F.col("edges")).otherwise(0.0))
