"""Joins and connected components that stay even when single keys or hubs hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shared import settle

#: A key is heavy when it holds at least this part of all rows; so there are at most HEAVY heavy keys.
HEAVY = 1000
MOST_ROUNDS = 60
#: At most this many links (2 MB) are joined up in one task instead of rounds over all of them; the result is the same.
MOST_LOCAL = 100_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], n_rows: str, total: int | None = None) -> DataFrame:
    """Left join to a table with one row per key, safe for keys that hold a large part of all rows.

    n_rows is right's count of left's rows per key. Keys with at least 1/HEAVY of all rows, of
    which there are at most HEAVY, are broadcast. Rows they serve take a salt that matches
    nothing, so the shuffle join that serves the rest deals them out evenly. Keys aren't null.
    total is the number of left's rows, or somewhat more, where it is known.
    """
    values = [c for c in right.columns if c not in keys]
    if total is None:
        total = right.agg(F.sum(n_rows)).first()[0] or 0
    least = max(2, -(-total // HEAVY))
    heavy = right.where(F.col(n_rows) >= least).select(*keys, F.struct(*values).alias("_heavy"))
    rest = right.where(F.col(n_rows) < least).select(*keys, F.struct(*values).alias("_rest"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(4093)).cast("int"))
    out = left.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    own = [c for c in left.columns if c not in keys]
    return out.select(*keys, *own, *[F.coalesce(F.col("_heavy")[v], F.col("_rest")[v]).alias(v) for v in values])


def _star(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """One step over edges (u, v), each listed in both directions: neighbours of u go to u's least neighbour."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    out = lookup(edges, least, ["u"], "_n", total)
    moved = out.where("v <= u" if small else "v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _united(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a bounded number of links; the least node stands for its component."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in list(parent)]})


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> (node, component) for every node that has a link; component is the least node reachable.

    Each round is a large-star and a small-star step; the number of rounds grows with the
    logarithm of a component's diameter. A table without links gives an empty result.
    """
    now = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    digest = (F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"))
    seen = now.agg(*digest).first()
    if 0 < seen["n"] <= MOST_LOCAL:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}")
    for _ in range(MOST_ROUNDS if seen["n"] else 0):
        large = _star(_both(now), 2 * seen["n"], small=False)
        now = settle(_star(_both(large), 2 * seen["n"], small=True), "star")
        before, seen = seen, now.agg(*digest).first()
        if seen == before:
            break
    else:
        if seen["n"]:
            raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
