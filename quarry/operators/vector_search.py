"""Vector collections: upserts, exact top-k with filters, inverted-file search, quantised codes.

A collection is a DataFrame with key, embedding (array<float>) and any metadata columns; several
collections may share a table with a collection column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators.conditions import TRUE, Condition, compile_condition
from quarry.shared import settle

#: Nearest-centroid tables (codebooks, coarse centroids) are parameters of at most this many rows.
MOST_CENTROIDS = 65_536
#: Rows of a part of a block where all pairs of rows are compared at once; two parts and their products are some 50 MB.
BLOCK_ROWS = 2048
#: Rows of the two blocks that a task holds (some 10 MB each of 64 numbers a row), and the blocks that smaller tables are cut into, so that all cores have tasks.
TASK_ROWS, TASK_BLOCKS = 16_384, 10
MOST_TASKS = 2000
#: Rows of either side of a task that looks for the most similar rows, and those of them that are compared at once.
MATCH_ROWS, MATCHED_ROWS = 4096, 512


def _meta(where: Condition | Column) -> Column:
    return where if isinstance(where, Column) else compile_condition(where, "meta")


def upsert(rows: DataFrame, new: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """rows with new ones in the place of those with the same key; of repeated keys in new the last in order counts."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def check_dimension(rows: DataFrame, dim: int, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows of the dimension, the others)."""
    fits = F.coalesce(F.size(embedding) == dim, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def set_metadata(rows: DataFrame, where: Condition | Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({k: F.when(_meta(where), v).otherwise(F.col(k)) if k in rows.columns else F.when(_meta(where), v) for k, v in values.items()})


def search(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Condition | Column = TRUE, key: str = "key", embedding: str = "embedding", threshold: float | None = None, offset: int = 0, query_key=None) -> DataFrame:
    """key, score and the other columns of the k best rows, ties by key.

    Filters run before scoring. Vectors of another dimension are skipped; a zero query finds
    nothing except by euclidean distance. query_key leaves the query's own row out.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = rows.where(_meta(where)).where(F.size(embedding) == len(query))
    if metric != "euclidean" and not any(query):
        rows = rows.where(F.lit(False))
    if query_key is not None:
        rows = rows.where(F.col(key) != F.lit(query_key))
    out = rows.withColumn("score", V.score(metric, F.col(embedding), V.literal(query)))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    out = out.orderBy(F.col("score").desc(), F.col(key))
    return out.offset(offset).limit(k) if offset else out.limit(k)


def search_by_key(rows: DataFrame, query_key, k: int, metric: str = "cosine", key: str = "key", embedding: str = "embedding", **more) -> DataFrame:
    """search() with the vector of an existing row, which isn't in the result."""
    found = rows.where(F.col(key) == F.lit(query_key)).select(embedding).first()
    if found is None:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    return search(rows, list(found[0]), k, metric, key=key, embedding=embedding, query_key=query_key, **more)


def post_filtered(rows: DataFrame, query: list[float], k: int, where: Condition | Column, metric: str = "cosine", oversample: int = 3, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """Filter after an oversampled search; may return fewer than k rows."""
    found = search(rows, query, k * oversample, metric, key=key, embedding=embedding)
    return found.where(_meta(where)).orderBy(F.col("score").desc(), key).limit(k)


def selectivity(rows: DataFrame, where: Condition | Column, sample: int = 100) -> float:
    """Part of a small sample that passes the filter; a diagnostic."""
    part = rows.limit(sample)
    n, hit = part.agg(F.count(F.lit(1)), F.count(F.when(_meta(where), 1))).first()
    return hit / n if n else 0.0


def top_per_group(rows: DataFrame, query: list[float], k: int, group: str, metric: str = "cosine", key: str = "key", embedding: str = "embedding") -> DataFrame:
    """The k best rows of each group with rank; a rank limit cuts each task's rows before the shuffle."""
    scored = rows.withColumn("score", V.score(metric, F.col(embedding), V.literal(query)))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def each_block_pair(rows: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, block_rows: int | None = None) -> DataFrame:
    """What run(left, right, same) returns for every two parts of rows, so that any two rows meet in exactly one task.

    Rows are dealt evenly to blocks of about TASK_ROWS by a hash, or to more and smaller ones while there are few. A task holds two blocks,
    whatever the rows have in common, and compares them in parts of block_rows (BLOCK_ROWS); each row is sent once for every block, and only
    what run returns leaves a task. same: both are one part.
    """
    part_rows, n = block_rows or BLOCK_ROWS, rows.count()
    blocks = max(1, -(-n // TASK_ROWS), min(TASK_BLOCKS, -(-n // min(part_rows, BLOCK_ROWS))))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    dealt = dealt.select("*", other).select(*rows.columns, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left, right = (_parts(pdf[pdf["_b"] == k], part_rows) for k in (i, j))
        found = [run(x, y, i == j and at == to) for at, x in enumerate(left) for to, y in enumerate(right) if i != j or at <= to]
        return pd.concat([f for f in found if len(f)] or found[:1] or [run(pdf[:0], pdf[:0], False)])

    return dealt.repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), "_i", "_j").groupBy("_i", "_j").applyInPandas(both, schema)


def most_similar(left: DataFrame, right: DataFrame, by: str, threshold: float) -> DataFrame:
    """(k, other): for each row of left (k, by, v) the key of the row of right (k, by, v) with the same by and the highest cosine, of equal ones the largest key.

    Rows below threshold, of another dimension and without by don't count. Rows of one value of by are dealt to blocks of about MATCH_ROWS,
    so that a value's rows are compared in as many tasks as they need, by matrix products.
    """
    left, right = (rows.where(F.col(by).isNotNull() & F.col("v").isNotNull()).select("k", by, F.col("v").cast("array<double>").alias("v")) for rows in (left, right))
    kinds = [rows.schema["k"].dataType.simpleString() for rows in (left, right)]
    sizes = [rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / MATCH_ROWS).cast("int").alias(n)) for rows, n in ((left, "_nl"), (right, "_nr"))]
    sizes = sizes[0].join(sizes[1], by)
    many = settle(sizes.where("_nl > 1 or _nr > 1"), "many")  # values of more than MATCH_ROWS rows, so few
    tasks = sizes.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 1

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(F.broadcast(many), by, "left")
        at = F.pmod(F.xxhash64("k"), F.coalesce(own, F.lit(1))).cast("int")
        return rows.select("k", by, "v", at.alias(own[1:]), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other[1:])).repartition(min(tasks, MOST_TASKS), by, "nl", "nr")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"k": left["k"][:0], "other": right["k"][:0], "score": np.empty(0)})]
        right = right.sort_values("k", ascending=False)  # of equal scores the largest key
        others = dict(list(right.groupby(right["v"].map(len))))
        for n, own in left.groupby(left["v"].map(len)):
            if n and n in others:
                m = _matrix(others[n]["v"])
                # of equal vectors the first one stands for all, so near ties are few
                first = np.sort(np.unique(np.ascontiguousarray(m).view(f"V{8 * n}").ravel(), return_index=True)[1])
                m, keys = m[first], others[n]["k"].to_numpy()[first]
                out += [_best_rows(part, m, keys, threshold) for part in _parts(own, MATCHED_ROWS)]
        return pd.concat([o for o in out if len(o)] or out[:1])

    pairs = dealt(left, "_nl", "_nr").groupBy(by, "nl", "nr").cogroup(dealt(right, "_nr", "_nl").groupBy(by, "nl", "nr"))
    found = pairs.applyInPandas(best, f"k {kinds[0]}, other {kinds[1]}, score double")
    return found.groupBy("k").agg(F.max_by("other", F.struct("score", "other")).alias("other"))


def _best_rows(own: pd.DataFrame, m: np.ndarray, keys: np.ndarray, threshold: float) -> pd.DataFrame:
    """(k, other, score) of the best row of m for each row of own. Those within rounding of the best are scored again in order of position, as SQL does."""
    v = _matrix(own["v"])
    s = cosines(v, m)
    s[np.isnan(s)] = -np.inf
    top = s.max(1)
    i, j = np.nonzero(s >= np.maximum(top, threshold)[:, None] - 1e-9)
    exact = np.concatenate([_in_order(v[i[k : k + 8192]], m[j[k : k + 8192]]) for k in range(0, len(i), 8192)] or [np.empty(0)])
    found = pd.DataFrame({"k": own["k"].to_numpy()[i], "other": keys[j], "score": exact, "at": i})
    found = found[found["score"] >= threshold].sort_values(["score", "other"], ascending=False, kind="stable")
    return found.drop_duplicates("at").drop(columns="at")


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that of b, summed from the first position to the last."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    n = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
    return np.clip(np.divide(total(a * b), n, out=np.zeros(len(n)), where=n > 0), -1, 1)


def _parts(rows: pd.DataFrame, size: int) -> list[pd.DataFrame]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in rows]) if len(rows) else np.empty((0, 1))


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each row of left with each of right; 0 where either is zero."""
    a, b = (np.linalg.norm(m, axis=1) for m in (left, right))
    n = a[:, None] * b[None, :]
    return np.divide(left @ right.T, n, out=np.zeros(n.shape), where=n > 0)


def near_pairs(rows: DataFrame, threshold: float, metric: str = "cosine", key: str = "key", embedding: str = "embedding", block: str | None = None, approximate: bool = False) -> DataFrame:
    """(a, b, score) of pairs of keys a < b that reach the threshold: all of them, by matrix products of blocks of rows.

    block restricts the pairs to rows that share that column. approximate compares only rows that share one of 24 sign codes
    of 10 random directions each; a pair at angle t is then found with probability 1 - (1 - (1 - t / pi)^10)^24.
    Metrics other than cosine and the blocked forms score pair by pair.
    """
    own = rows.select(F.col(key).alias("k"), F.col(embedding).alias("v"), *([F.col(block).alias("bl")] if block else []))
    if not block and not approximate and metric == "cosine":
        kind = rows.schema[key].dataType.simpleString()

        def products(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
            s = cosines(_matrix(left["v"]), _matrix(right["v"])) if len(left) and len(right) else np.empty((0, 0))
            i, j = np.nonzero(s >= threshold)
            x, y = left["k"].to_numpy()[i], right["k"].to_numpy()[j]
            keep = x < y if same else x != y
            i, j, x, y = i[keep], j[keep], x[keep], y[keep]
            return pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "score": s[i, j]})

        return each_block_pair(own, products, f"a {kind}, b {kind}, score double")
    if not block:
        codes = sign_codes(F.col("v"), tables=24, bits=10) if approximate else F.array(F.lit(0).cast("long"))
        own = own.withColumn("bl", F.explode(codes))
    a, b = own.select("bl", F.col("k").alias("a"), F.col("v").alias("va")), own.select("bl", F.col("k").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, "bl").where("a < b")
    scored = pairs.withColumn("score", V.score(metric, F.col("va"), F.col("vb"))).where(F.col("score") >= threshold)
    return scored.select("a", "b", "score").distinct()


def matching_keys(rows: DataFrame, where: Condition | Column, key: str = "key") -> DataFrame:
    """Keys of the rows that pass a metadata filter."""
    return rows.where(_meta(where)).select(key)


def count_matching(rows: DataFrame, where: Condition | Column) -> DataFrame:
    """n, the number of rows that pass a metadata filter."""
    return rows.where(_meta(where)).agg(F.count(F.lit(1)).alias("n"))


def sign_codes(embedding: Column, tables: int, bits: int, seed: int = 5) -> Column:
    """One code per table: the signs of dot products with random directions, as 'table:bits'."""

    @F.pandas_udf("array<long>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            for n, part in batch.groupby(batch.map(len)):
                p = planes.setdefault(n, np.random.default_rng(seed).normal(size=(tables * bits, n)))
                signs = (_matrix(part) @ p.T > 0).reshape(len(part), tables, bits)
                out.loc[part.index] = list(signs @ weights + (np.arange(tables) << bits))
            yield out

    return codes(embedding)


# inverted-file index: k-means centroids, rows partitioned by centroid


@dataclass(frozen=True)
class InvertedFile:
    """Centroids on the driver (at most MOST_CENTROIDS) and rows with their centroid's number in list."""

    centroids: np.ndarray
    rows: DataFrame
    key: str = "key"
    embedding: str = "embedding"

    def search(self, query: list[float], k: int, nprobe: int = 1, metric: str = "cosine", where: Condition | Column = TRUE) -> DataFrame:
        """Exact search in the nprobe nearest lists; with nprobe of all lists it is exact altogether."""
        d = ((self.centroids - np.asarray(query, float)) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[:nprobe].tolist()
        return search(self.rows.where(F.col("list").isin(*near)), query, k, metric, where, self.key, self.embedding)


@dataclass(frozen=True)
class StoredIndex:
    """An inverted file written as a folder per list, so that a search reads only the lists it probes."""

    centroids: np.ndarray
    path: str
    rows: DataFrame  # of the folders
    n_probe: int  # lists that reach the recall asked for on the sampled queries
    recall: float  # measured there
    key: str = "key"
    embedding: str = "embedding"

    def search(self, query: list[float], k: int, metric: str = "cosine", where: Condition | Column = TRUE, n_probe: int | None = None, query_key=None) -> DataFrame:
        """Exact scores over the nearest n_probe lists; all lists give the exact result."""
        lists = nearest_lists(self.centroids, np.asarray([query], float))[0][: n_probe or self.n_probe].tolist()
        return search(self.rows.where(F.col("list").isin(*lists)), query, k, metric, where, self.key, self.embedding, query_key=query_key).drop("list")


def nearest_lists(centroids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Lists of each query by falling cosine to their centroids."""
    return np.argsort(-cosines(queries, centroids), axis=1, kind="stable")


def build_index(rows: DataFrame, path: str, n_lists: int | None = None, recall: float = 0.95, k: int = 10, n_queries: int = 50, key: str = "key", embedding: str = "embedding", seed: int = 1) -> StoredIndex:
    """Write rows by their nearest centroid under path and choose how many lists a search probes.

    The centroids are those of unit vectors; there are about sqrt(rows) lists. n_queries rows, the first in hash order of their keys, are
    searched exactly against all rows, and n_probe is the least number of lists that hold recall of their k nearest.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to index")
    n_lists = n_lists or max(1, min(MOST_CENTROIDS, round(n**0.5)))
    length = V.norm(F.col(embedding))
    unit = rows.withColumn("_u", F.when(length > 0, F.transform(embedding, lambda x: x / length)).otherwise(F.col(embedding).cast("array<double>")))
    centroids = kmeans(unit, n_lists, "_u", seed) if n > n_lists else _matrix(unit.toPandas()["_u"])
    placed = nearest_centroid(unit, centroids, "_u", "cosine").drop("_u", "list_score")
    placed.repartition("list").write.partitionBy("list").parquet(path)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(path)
    sample = rows.orderBy(F.xxhash64(key), key).limit(n_queries).select(F.col(key).alias("k"), F.col(embedding).alias("v")).toPandas()
    queries = _matrix(sample["v"])
    kind = rows.schema[key].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = cosines(queries, _matrix(batch[embedding]))
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(queries)), at.shape[1]), "score": np.take_along_axis(s, at, 1).ravel(), "k": batch[key].to_numpy()[at].ravel(), "list": batch["list"].to_numpy()[at].ravel()})

    near = stored.select(key, embedding, "list").mapInPandas(best, f"q int, score double, k {kind}, list int")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "k")
    top = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("q", "list").toPandas()
    rank = np.argsort(nearest_lists(centroids, queries), axis=1)
    needed = np.sort(rank[top["q"].to_numpy(), top["list"].to_numpy()])  # lists to probe before each true neighbour's, less one
    n_probe = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return StoredIndex(centroids, path, stored, n_probe, float((needed < n_probe).mean()), key, embedding)


def update_centroid(centroid: Column, n: Column, embedding: Column) -> Column:
    """Mean of n vectors moved by one more."""
    return F.zip_with(centroid, embedding, lambda c, x: c + (x - c) / (n + 1))


def keys_page(rows: DataFrame, offset: int = 0, limit: int = 100, key: str = "key") -> DataFrame:
    return rows.select(key).orderBy(key).offset(offset).limit(limit)


def kmeans(rows: DataFrame, k: int, embedding: str = "embedding", seed: int = 1, rounds: int = 20) -> np.ndarray:
    """Centroids by distributed k-means (k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids")
    data = rows.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=rounds).fit(data).clusterCenters())


def nearest_centroid(rows: DataFrame, centroids: np.ndarray, embedding: str = "embedding", metric: str = "euclidean", out: str = "list") -> DataFrame:
    """rows with the number of the nearest centroid, and its similarity; centroids travel with the function."""
    c = np.asarray(centroids, float)

    @F.pandas_udf("n int, score double")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lengths = np.linalg.norm(c, axis=1)
        for batch in batches:
            m = np.stack([np.asarray(v, float) for v in batch]) if len(batch) else np.empty((0, c.shape[1]))
            if metric == "cosine":
                n = np.linalg.norm(m, axis=1)[:, None] * lengths
                s = np.divide(m @ c.T, n, out=np.zeros((len(m), len(c))), where=n > 0)
            else:
                s = 1 / (1 + np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1))))
            at = s.argmax(1) if len(m) else np.empty(0, int)
            yield pd.DataFrame({"n": at.astype("int32"), "score": s[np.arange(len(m)), at]})

    return rows.withColumn("_a", assign(F.col(embedding))).withColumns({out: F.col("_a.n"), f"{out}_score": F.col("_a.score")}).drop("_a")


def inverted_file(rows: DataFrame, n_lists: int, key: str = "key", embedding: str = "embedding", seed: int = 1) -> InvertedFile:
    centroids = kmeans(rows, n_lists, embedding, seed)
    return InvertedFile(centroids, nearest_centroid(rows, centroids, embedding), key, embedding)


@dataclass(frozen=True)
class ProductQuantizer:
    """Codebooks (parts x codes x width), trained per part of the vector."""

    books: np.ndarray

    @staticmethod
    def train(rows: DataFrame, parts: int, codes: int = 16, embedding: str = "embedding", seed: int = 1) -> ProductQuantizer:
        dim = rows.select(F.max(F.size(embedding))).first()[0]
        width = dim // parts
        books = [kmeans(rows.select(F.slice(embedding, p * width + 1, width).alias("part")), codes, "part", seed + p) for p in range(parts)]
        return ProductQuantizer(np.stack([np.resize(b, (codes, width)) for b in books]))

    def encode(self, rows: DataFrame, embedding: str = "embedding", out: str = "codes") -> DataFrame:
        books = self.books
        parts, _, width = books.shape

        @F.pandas_udf("array<int>")
        def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                m = _matrix(batch).reshape(len(batch), parts, width)
                near = [((m[:, p] ** 2).sum(1)[:, None] - 2 * m[:, p] @ books[p].T + (books[p] ** 2).sum(1)).argmin(1) for p in range(parts)]
                yield pd.Series(list(np.stack(near, axis=1).astype("int32")))

        return rows.withColumn(out, codes(F.col(embedding)))

    def distance(self, query: list[float], codes: Column) -> Column:
        """Asymmetric distance: squared distances of the query's parts to all codes are a table; a row sums its entries."""
        parts, _, width = self.books.shape
        q = np.asarray(query, float).reshape(parts, 1, width)
        table = ((self.books - q) ** 2).sum(2)
        t = F.array(*[V.literal(row.tolist()) for row in table])
        return F.sqrt(V.total(F.transform(codes, lambda c, p: F.element_at(t[p], c + 1))))
