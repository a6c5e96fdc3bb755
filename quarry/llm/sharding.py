"""Extendible hashing: a directory indexed by hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import hash60, materialize

BITS = 60
MAX_BYTES = 1 << 20
#: The first directory is this many bits finer than an even split needs; each further round adds ROUND_BITS.
SLACK_BITS, ROUND_BITS = 4, 8
#: A directory of at most this many entries (about 6 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ENTRIES = 1 << 16


def _refine(bins: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """Directory entries of depth high for bins (_bin, _bytes, _rows, _min, _max) below nodes of depth low.

    Every node from depth low to high is summed; a node is a bucket when it fits, or holds one
    hash value, and its parent doesn't. Each bucket is listed once for every entry it covers.
    Entries still too large at depth high have _open = true.
    """
    levels = bins.withColumn("_level", F.explode(F.sequence(F.lit(low), F.lit(high))))
    node = F.expr(f"shiftright(_bin, {high} - _level)")
    nodes = levels.groupBy("_level", node.alias("_node")).agg(
        F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"), F.min("_min").alias("_min"), F.max("_max").alias("_max")
    )
    nodes = materialize(nodes.withColumn("_fits", (F.col("_bytes") <= max_bytes) | (F.col("_min") == F.col("_max"))), "nodes")
    split = nodes.where(~F.col("_fits")).select((F.col("_level") + 1).alias("_level"), F.col("_node").alias("_parent"))
    child = nodes.withColumn("_parent", F.expr("shiftright(_node, 1)"))
    done = child.join(split, ["_level", "_parent"], "left_semi").where(F.col("_fits"))
    top = nodes.where((F.col("_level") == low) & F.col("_fits")).withColumn("_parent", F.lit(0).cast("long"))
    still = nodes.where((F.col("_level") == high) & ~F.col("_fits")).withColumn("_parent", F.lit(0).cast("long"))
    found = done.unionByName(top).withColumn("_open", F.lit(False)).unionByName(still.withColumn("_open", F.lit(True)))
    first = F.expr(f"shiftleft(_node, {high} - _level)")
    last = F.expr(f"shiftleft(_node + 1, {high} - _level) - 1")
    return found.select(
        F.explode(F.sequence(first, last)).alias("_entry"), F.col("_level").alias("depth"), F.col("_node"), "_open",
        F.col("_rows").alias("bucket_rows"), F.col("_bytes").alias("bucket_bytes"),
    )


def shard(df: DataFrame, key: Column, n_bytes: Column, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add shard, depth, shard_rows and shard_bytes to every row of df (no row is dropped).

    shard is the bucket's hash prefix as depth binary digits ('' is the whole table). A bucket
    over max_bytes splits on its next bit until it fits or has one hash value left. Rows of one
    hash value that together exceed max_bytes go to overflow pages of at most max_bytes (a row
    larger than max_bytes has a page of its own), named prefix + '+' + page. A null key hashes
    as the empty string; null n_bytes counts as 0; an empty table gives an empty result; equal
    keys share a bucket. Columns of df keep their names; clashing names are replaced.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    made = ["shard", "depth", "shard_rows", "shard_bytes"]
    rows = df.select(F.struct(*[c for c in df.columns if c not in made]).alias("_row"), hash60(key).alias("_h"), F.coalesce(n_bytes.cast("long"), F.lit(0).cast("long")).alias("_n"))
    total = rows.agg(F.sum("_n")).first()[0] or 0
    low, high = 0, min(BITS, max(SLACK_BITS, math.ceil(math.log2(max(1, total / max_bytes))) + SLACK_BITS))
    pending, parts = rows.select("_h", "_n"), []
    while True:
        bins = pending.groupBy(F.expr(f"shiftright(_h, {BITS - high})").alias("_bin")).agg(
            F.sum("_n").alias("_bytes"), F.count("*").alias("_rows"), F.min("_h").alias("_min"), F.max("_h").alias("_max")
        )
        found = materialize(_refine(bins, low, high, max_bytes), "directory")
        parts.append((high, found.where(~F.col("_open")).drop("_open"), found.where(~F.col("_open")).count()))
        opened = found.where(F.col("_open")).select(F.col("_entry").alias("_bin"))
        n_open = opened.count()
        if not n_open or high == BITS:
            break
        pending = pending.withColumn("_bin", F.expr(f"shiftright(_h, {BITS - high})"))
        pending = pending.join(F.broadcast(opened) if n_open <= BROADCAST_ENTRIES else opened, "_bin", "left_semi").drop("_bin")
        low, high = high + 1, min(BITS, high + ROUND_BITS)
    out = rows
    for k, (bits, directory, n) in enumerate(parts):
        own = directory.select(F.col("_entry").alias(f"_e{k}"), F.struct("depth", "_node", "bucket_rows", "bucket_bytes").alias(f"_d{k}"))
        out = out.withColumn(f"_e{k}", F.expr(f"shiftright(_h, {BITS - bits})"))
        out = out.join(F.broadcast(own) if n <= BROADCAST_ENTRIES else own, f"_e{k}", "left")
    out = out.withColumn("_d", F.coalesce(*[F.col(f"_d{k}") for k in range(len(parts))]))
    prefix = F.when(F.col("_d.depth") == 0, "").otherwise(F.expr("lpad(bin(_d._node), _d.depth, '0')"))
    out = out.withColumns({"shard": prefix, "depth": F.col("_d.depth"), "shard_rows": F.col("_d.bucket_rows"), "shard_bytes": F.col("_d.bucket_bytes")})
    out = out.select("_row", *made, "_h", "_n")
    full = [d.where((F.col("bucket_bytes") > max_bytes) & (F.col("bucket_rows") > 1)).limit(1).count() for _, d, _ in parts]
    return (_overflow(out, max_bytes) if any(full) else out).select("_row.*", *made)


def _overflow(out: DataFrame, max_bytes: int) -> DataFrame:
    """Cut buckets of one hash value into pages by a running sum of bytes, two-level: per input partition, then within."""
    over = (F.col("shard_bytes") > max_bytes) & (F.col("shard_rows") > 1)
    rest = out.where(~over)
    big = out.where(over).withColumn("_p", F.shiftright(F.monotonically_increasing_id(), 33))
    sums = big.groupBy("_h", "_p").agg(F.sum("_n").alias("_s"), F.max("_n").alias("_m"))
    before = Window.partitionBy("_h").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_h", "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.max("_m").over(Window.partitionBy("_h")).alias("_most"))
    within = Window.partitionBy("_h", "_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    big = big.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(base, ["_h", "_p"])
    page = F.floor((F.col("_base") + F.col("_within")) / F.greatest(F.lit(max_bytes) - F.col("_most"), F.lit(1)))
    big = big.withColumn("shard", F.concat("shard", F.lit("+"), page.cast("string")))
    pages = big.groupBy("shard").agg(F.count("*").alias("_r"), F.sum("_n").alias("_b"))
    big = big.join(pages, "shard").withColumns({"shard_rows": F.col("_r"), "shard_bytes": F.col("_b")})
    return rest.unionByName(big.select(*rest.columns))


def write_shards(sharded: DataFrame, path: str, n_files: int) -> None:
    """Write a sharded table as Parquet, rows of a shard side by side, in about n_files files."""
    sharded.repartitionByRange(n_files, "shard").sortWithinPartitions("shard").write.parquet(path)
