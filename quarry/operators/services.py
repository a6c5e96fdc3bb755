"""Query-like parts of the services: prompt cache, blob store, audit log, access graphs, delta conflicts, history."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators.graph import BOTH, OUT, Graph
from quarry.operators.graph_algorithms import eigenvector, louvain, pagerank
from quarry.operators.vector_search import cosines, each_block_pair, most_similar, nearest_centroid, search
from quarry.shared import settle

# Prompt cache: key, prompt, response, embedding, created_at, expires_at, hits, last_hit, cost


def cache_live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def cache_put(cache: DataFrame, rows: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    rows = rows.withColumn("expires_at", (now.cast("timestamp").cast("long") + ttl_seconds).cast("timestamp").cast(cache.schema["expires_at"].dataType))
    return cache.join(rows.select("key"), "key", "left_anti").unionByName(rows, allowMissingColumns=True)


def cache_get(cache: DataFrame, prompt: str, query: list[float], now: Column, threshold: float = 0.9, metric: str = "cosine") -> DataFrame:
    """The exact entry, else the most similar one at or above the threshold; layer names which."""
    live = cache_live(cache, now)
    exact = live.where(F.col("prompt") == prompt).withColumn("score", F.lit(1.0)).withColumn("layer", F.lit("exact"))
    near = search(live, query, 1, metric, threshold=threshold).withColumn("layer", F.lit("semantic"))
    return exact.unionByName(near).orderBy("layer").limit(1)


def cache_get_all(cache: DataFrame, requests: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(request, key, layer) of many requests: exact matches by a join, the rest within the same model's block by similarity."""
    exact = requests.join(cache.select("prompt", "key"), "prompt", "left").withColumn("layer", F.when(F.col("key").isNotNull(), "exact"))
    rest = exact.where("key is null").drop("key", "layer")
    own, entries = (rows.select(F.col(key).alias("k"), "model", F.col("embedding").alias("v")) for rows, key in ((rest, "request"), (cache, "key")))
    best = most_similar(own, entries, "model", threshold).select(F.col("k").alias("request"), F.col("other").alias("key"))
    missed = rest.select("request").join(best, "request", "left").withColumn("layer", F.when(F.col("key").isNotNull(), "semantic").otherwise("miss"))
    return exact.where("key is not null").select("request", "key", "layer").unionByName(missed)


def eviction_score(strategy: str, now: Column) -> Column:
    """lru, lfu, cost or hybrid; the lowest score goes first."""
    age = now.cast("timestamp").cast("double") - F.col("last_hit").cast("timestamp").cast("double")
    recency, frequency, price = 1 / (1 + age), F.log1p(F.col("hits").cast("double")), F.col("cost") * F.col("hits")
    return {"lru": -age, "lfu": F.col("hits").cast("double"), "cost": price, "hybrid": 0.4 * recency + 0.3 * frequency + 0.3 * price}[strategy]


def cache_evict(cache: DataFrame, n: int, strategy: str, now: Column) -> DataFrame:
    gone = cache.select("key", eviction_score(strategy, now).alias("_s")).orderBy("_s", "key").limit(n).select("key")
    return cache.join(gone, "key", "left_anti")


def cache_stats(lookups: DataFrame) -> DataFrame:
    return lookups.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# Blobs: artifacts (id, name, content_type, created_by, tags, links, chunks array<string>, checksum), chunks (hash, data, size)


def chunked(files: DataFrame, chunk_bytes: int = 1 << 20, content: str = "content") -> DataFrame:
    """(id, seq, hash, data, size): content cut into chunks addressed by their hash."""
    n = F.greatest(F.ceil(F.octet_length(content) / chunk_bytes), F.lit(1))
    each = files.select("id", F.col(content).alias("_c"), F.posexplode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq", "_at"))
    part = each.withColumn("data", F.expr(f"substring(_c, cast(_at * {chunk_bytes} as int) + 1, {chunk_bytes})"))
    return part.select("id", "seq", F.concat(F.lit("sha256:"), F.sha2("data", 256)).alias("hash"), "data", F.octet_length("data").cast("long").alias("size"))


def blob_stats(chunks: DataFrame) -> DataFrame:
    """artifacts, chunks, stored chunks, bytes, stored bytes and the ratio saved by equal chunks."""
    stored = chunks.groupBy("hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("refs"))
    a = chunks.agg(F.count_distinct("id").alias("artifacts"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    b = stored.agg(F.count(F.lit(1)).alias("stored_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"))
    both = a.crossJoin(b)  # one row each
    return both.withColumn("dedup_ratio", F.when(F.col("bytes") > 0, 1 - F.col("stored_bytes") / F.col("bytes")).otherwise(0.0))


def by_tag(artifacts: DataFrame, tag: str) -> DataFrame:
    return artifacts.where(F.array_contains("tags", tag))


def by_type(artifacts: DataFrame, content_type: str) -> DataFrame:
    return artifacts.where(F.col("content_type") == content_type)


def by_creator(artifacts: DataFrame, who: str) -> DataFrame:
    return artifacts.where(F.col("created_by") == who)


def linked_to(artifacts: DataFrame, entity: str) -> DataFrame:
    return artifacts.where(F.array_contains("links", entity))


def by_prefix(artifacts: DataFrame, prefix: str) -> DataFrame:
    return artifacts.where(F.col("id").startswith(prefix))


def orphan_chunks(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored chunks that no artifact refers to."""
    used = artifacts.select(F.explode("chunks").alias("hash")).distinct()
    return chunks.join(used, "hash", "left_anti")


def collect_garbage(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    used = artifacts.select(F.explode("chunks").alias("hash")).distinct()
    return chunks.join(used, "hash", "left_semi")


def damaged_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose data no longer has their hash."""
    return chunks.where(F.concat(F.lit("sha256:"), F.sha2("data", 256)) != F.col("hash"))


# Access graphs: edges entity -> group (MEMBER) and -> secret (VAULT_ACCESS) with permission 1 read, 2 write, 3 admin


def permissions(g: Graph, entity, max_depth: int = 10) -> DataFrame:
    """(secret, permission): the best permission over membership steps that end in an access edge."""
    reached = g.distances([entity], OUT, max_depth, "MEMBER").select("id")
    access = g.edges.where("type = 'VAULT_ACCESS'")
    return access.join(reached, access["src"] == reached["id"], "left_semi").groupBy(F.col("dst").alias("secret")).agg(F.max("permission").alias("permission"))


def reachable_secrets(g: Graph, entities: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, reads, writes, admins): secrets that each entity reaches, by best permission."""
    reached = g.distances(entities, OUT, max_depth, "MEMBER")
    access = g.edges.where("type = 'VAULT_ACCESS'").select("src", F.col("dst").alias("secret"), "permission")
    best = reached.join(access, reached["id"] == access["src"]).groupBy("source", "secret").agg(F.max("permission").alias("p"))
    return best.groupBy(F.col("source").alias("id")).agg(*[F.count(F.when(F.col("p") == k, 1)).alias(n) for k, n in ((1, "reads"), (2, "writes"), (3, "admins"))])


def privilege_ranking(g: Graph) -> DataFrame:
    """Entities by PageRank with the secrets they reach."""
    return pagerank(g).join(reachable_secrets(g, g.nodes.select("id")), "id", "left").na.fill(0, ["reads", "writes", "admins"]).orderBy(F.col("score").desc(), "id")


def privilege_centrality(g: Graph) -> DataFrame:
    """Eigenvector score times one plus the admin secrets in reach."""
    counts = reachable_secrets(g, g.nodes.select("id"))
    joined = eigenvector(g).join(counts, "id", "left")
    return joined.select("id", (F.col("score") * (1 + F.coalesce("admins", F.lit(0)))).alias("score")).orderBy(F.col("score").desc(), "id")


def inferred_roles(g: Graph) -> DataFrame:
    """(community, members, secrets): communities of two and more with the secrets that all members reach."""
    part = settle(louvain(g), "roles")
    access = g.edges.where("type = 'VAULT_ACCESS'").select(F.col("src").alias("id"), F.col("dst").alias("secret")).distinct()
    size = part.groupBy("community").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = part.join(access, "id").groupBy("community", "secret").agg(F.count(F.lit(1)).alias("_n")).join(size, "community").where("_n = members")
    secrets = shared.groupBy("community").agg(F.array_sort(F.collect_list("secret")).alias("secrets"))
    return size.join(secrets, "community", "left")


def dependents(g: Graph, ident, max_depth: int | None = None, kind: str | None = None) -> DataFrame:
    """(id, depth) of everything that depends on ident over edges dependent -> dependency."""
    return g.distances([ident], "incoming", max_depth, kind).where("depth > 0").select("id", "depth")


def impact(g: Graph, ident, weight_column: str = "weight", max_depth: int | None = None) -> DataFrame:
    """(id, depth, impact): weight of the edge that leads there over its depth, largest first."""
    depth = settle(g.distances([ident], "incoming", max_depth).select("id", "depth"), "depths")
    down = g.edges.select(F.col("dst").alias("_from"), F.col("src").alias("id"), F.col(weight_column).cast("double").alias("_w"))
    steps = down.join(depth.select(F.col("id").alias("_from"), F.col("depth").alias("_d")), "_from").join(depth, "id").where("depth = _d + 1")
    return steps.groupBy("id", "depth").agg((F.max("_w") / F.first("depth")).alias("impact")).orderBy(F.col("impact").desc(), "id")


def single_points(g: Graph) -> DataFrame:
    """Secrets that only one entity reaches directly."""
    access = g.edges.where("type = 'VAULT_ACCESS'").select("src", "dst").distinct()
    return access.groupBy(F.col("dst").alias("secret")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("holder")).where("n = 1").select("secret", "holder")


def diffusion(g: Graph, start: DataFrame, time: float = 1.0, degree: int = 12) -> DataFrame:
    """(id, value): heat kernel exp(-t L) applied to start (id, value) by Chebyshev polynomials of the normalised Laplacian."""
    import numpy as np

    k = np.arange(degree + 1)
    x = np.cos(np.pi * (np.arange(200) + 0.5) / 200)
    c = [(2 if j else 1) / 200 * float((np.exp(-time * (x + 1)) * np.cos(j * np.arccos(x))).sum()) for j in k]
    adj = g.arcs(BOTH).where("src <> dst").select("src", "dst").distinct()
    d = adj.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    m = settle(adj.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("_n").alias("_m")), "dst").select("src", "dst", (-1 / F.sqrt(F.col("_n") * F.col("_m"))).alias("w")), "laplacian")
    zero = F.lit(0.0)

    def times(v: DataFrame) -> DataFrame:  # (L - 1) v: the spectrum of L lies in [0, 2]
        return m.join(v, m["src"] == v["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))

    base = g.nodes.select("id").join(start, "id", "left").select("id", F.coalesce("value", zero).alias("value"))
    before, now = settle(base, "t0"), settle(g.nodes.select("id").join(times(base), "id", "left").select("id", F.coalesce("value", zero).alias("value")), "t1")
    out = [before.withColumn("c", F.lit(c[0])), now.withColumn("c", F.lit(c[1]))]
    for j in range(2, degree + 1):
        twice = now.select("id").join(times(now).withColumnRenamed("value", "_t"), "id", "left").join(before.withColumnRenamed("value", "_b"), "id")
        before, now = now, settle(twice.select("id", (2 * F.coalesce("_t", zero) - F.col("_b")).alias("value")), f"t{j}")
        out.append(now.withColumn("c", F.lit(c[j])))
    return reduce(lambda a, b: a.unionByName(b), out).groupBy("id").agg(F.sum(F.col("c") * F.col("value")).alias("value"))


def access_buckets(log: DataFrame, width: str = "1 hour", ts: str = "ts", who: str = "entity", what: str = "secret") -> DataFrame:
    """Access counts by entity, secret and time bucket."""
    return log.groupBy(who, what, F.window(ts, width)["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def audit_since(log: DataFrame, since: Column, ts: str = "ts") -> DataFrame:
    return log.where(F.col(ts) >= since).orderBy(ts)


def by_glob(rows: DataFrame, column: str, glob: str) -> DataFrame:
    """Names that match a pattern with * and ?."""
    quoted = "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in glob)
    return rows.where(F.col(column).rlike(f"^{quoted}$"))


# History and deltas


def key_history(changes: DataFrame, key: str) -> DataFrame:
    return changes.where(F.col("key") == key).orderBy("height")


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks (height, hash, prev_hash) whose prev_hash isn't the hash of the block before. Blocks are compared by a join on height."""
    before = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("_before"))
    return blocks.join(before, "height").where(~F.col("prev_hash").eqNullSafe(F.col("_before"))).drop("_before")


# The thresholds that tell the classes of two deltas apart.
IDENTICAL, OPPOSITE, ORTHOGONAL, CONFLICT, STRUCTURAL = 0.99, -0.95, 0.1, 0.7, 0.5
CLASSES = ("Identical", "Opposite", "Orthogonal", "Conflicting", "Ambiguous", "LowConflict")


def conflict_class(cosine: Column, structure: Column, overlap: Column, same_keys: Column, merge_overlap: bool = False) -> Column:
    """Class of two deltas from their angle, the Jaccard index of the positions they change, and whether they share any or have the same keys.

    merge_overlap lets deltas that share keys without any other conflict be merged.
    """
    return (
        F.when((cosine >= IDENTICAL) & same_keys, CLASSES[0]).when((cosine <= OPPOSITE) & same_keys, CLASSES[1])
        .when((F.abs(cosine) < ORTHOGONAL) & (structure < STRUCTURAL), CLASSES[2]).when((cosine >= CONFLICT) | (structure >= STRUCTURAL), CLASSES[3])
        .when(overlap & F.lit(not merge_overlap), CLASSES[4]).otherwise(CLASSES[5])
    )


def delta_conflicts(deltas: DataFrame, classes: tuple[str, ...] = CLASSES, merge_overlap: bool = False) -> DataFrame:
    """(a, b, class) for all pairs a < b of deltas (id, v, keys) that fall into classes, by matrix products of blocks."""
    kind = deltas.schema["id"].dataType.simpleString()

    def classed(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = [pd.DataFrame({"a": left["id"][:0], "b": left["id"][:0], "class": pd.Series(dtype=str)})]
        for x, y, of in _conflicts(left, right, same, merge_overlap):
            for name in classes:
                i, j = np.nonzero(of[name])
                out.append(pd.DataFrame({"a": np.where(x[i] < y[j], x[i], y[j]), "b": np.where(x[i] < y[j], y[j], x[i]), "class": name}))
        return pd.concat([o for o in out if len(o)] or out[:1])

    return each_block_pair(deltas.select("id", "v", "keys"), classed, f"a {kind}, b {kind}, class string", CLASSED_ROWS)


def conflict_counts(deltas: DataFrame, merge_overlap: bool = False) -> DataFrame:
    """(class, n) over all pairs of deltas (id, v, keys); pairs are counted where they are compared."""

    def counted(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        n = dict.fromkeys(CLASSES, 0)
        for _, _, of in _conflicts(left, right, same, merge_overlap):
            for name, mask in of.items():
                n[name] += np.count_nonzero(mask)
        return pd.DataFrame({"class": list(n), "n": list(n.values())})

    found = each_block_pair(deltas.select("id", "v", "keys"), counted, "class string, n long", CLASSED_ROWS)
    return found.groupBy("class").agg(F.sum("n").alias("n")).where("n > 0")


#: Rows of a part whose numbers are prepared once, and those of them whose pairs are classed at once, in some 10 MB.
CLASSED_ROWS, STRIP_ROWS = 8192, 64


def _conflicts(left: pd.DataFrame, right: pd.DataFrame, same: bool, merge_overlap: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(ids of some rows of left, ids of right, table of the pairs of each class): unequal ids, of one part each pair once."""
    if not len(left) or not len(right):
        return
    ids, more = left["id"].to_numpy(), right["id"].to_numpy()
    own, other = (np.stack([np.asarray(v, float) for v in part["v"]]) for part in (left, right))
    # common positions are at least half of all where three times their number less both numbers isn't negative; exact in these floats
    kind = "float32" if own.shape[1] < 1 << 22 else "float64"
    used, also = (own != 0).astype(kind), (other != 0).astype(kind)
    n_used, n_also = used.sum(1, keepdims=True), also.sum(1, keepdims=True)
    used, also = np.hstack([3 * used, -n_used, -np.ones_like(n_used)]), np.hstack([also, np.ones_like(n_also), n_also]).T.copy()
    own, other = _unit(own), _unit(other).T.copy()
    held, holds, sets, others = _key_tables(left["keys"], right["keys"])
    shares, holds = not merge_overlap, holds.T.copy()
    apart = not same and not len(np.intersect1d(ids, more))
    for k in range(0, len(left), STRIP_ROWS):
        s = slice(k, k + STRIP_ROWS)
        cosine = own[s] @ other
        equal = sets[s, None] == others[None, :]
        alike = used[s] @ also >= 0
        shared = (held[s] @ holds > 0) & shares
        left_over = np.ones(cosine.shape, bool) if apart else ids[s, None] < more[None, :] if same else ids[s, None] != more[None, :]
        of = {}
        rules = ((cosine >= IDENTICAL) & equal, (cosine <= OPPOSITE) & equal, (cosine < ORTHOGONAL) & (cosine > -ORTHOGONAL) & ~alike, (cosine >= CONFLICT) | alike, shared)
        for name, rule in zip(CLASSES, rules, strict=False):
            of[name] = rule & left_over
            left_over = left_over & ~rule
        yield ids[s], more, {**of, CLASSES[5]: left_over}


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.zeros(rows.shape), where=n > 0)


def _key_tables(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each side, which keys its rows hold, and the number of each row's set of keys."""
    keys = [[frozenset(k) if k is not None else frozenset() for k in part] for part in (left, right)]
    sets = {own: n for n, own in enumerate(dict.fromkeys(own for part in keys for own in part))}
    number = {k: n for n, k in enumerate(dict.fromkeys(k for own in sets for k in own))}
    table = np.zeros((len(sets), len(number)), "float32")
    for own, n in sets.items():
        table[n, [number[k] for k in own]] = 1
    at = [np.array([sets[own] for own in part], "int32") for part in keys]
    return table[at[0]], table[at[1]], at[0], at[1]


def merged_deltas(deltas: DataFrame, group: str) -> DataFrame:
    """Sum of dense deltas per group, position by position."""
    each = deltas.select(group, F.posexplode("v").alias("pos", "x"))
    sums = each.groupBy(group, "pos").agg(F.sum("x").alias("x"))
    return sums.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v")).select(group, F.transform("_v", lambda e: e["x"]).alias("v"))


def quantized(rows: DataFrame, codebook, embedding: str = "embedding") -> DataFrame:
    """Nearest codebook entry by cosine."""
    return nearest_centroid(rows, codebook, embedding, "cosine", "code")


def code_transitions(rows: DataFrame, group: str, order: str, code: str = "code") -> DataFrame:
    """(before, after, n) of consecutive codes within a group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.lag(code).over(w)).where("before is not null").groupBy("before", F.col(code).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def nearest_other(rows: DataFrame, threshold: float, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """(a, b, score): each row's most similar other row at or above threshold, unordered pairs once; all rows are compared, block by block."""
    kind = rows.schema[key].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = []
        for own, others in ((left, right),) if same else ((left, right), (right, left)):
            if len(own) and len(others):
                others = others.sort_values("k", ascending=False)  # of equal scores the largest key
                s = cosines(*(np.stack([np.asarray(v, float) for v in part["v"]]) for part in (own, others)))
                s[own["k"].to_numpy()[:, None] == others["k"].to_numpy()[None, :]] = -np.inf
                at = s.argmax(1)
                out.append(pd.DataFrame({"x": own["k"].to_numpy(), "y": others["k"].to_numpy()[at], "score": s[np.arange(len(own)), at]}))
        found = pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "score": []})
        return found[found["score"] >= threshold]

    found = each_block_pair(rows.select(F.col(key).alias("k"), F.col(embedding).alias("v")), best, f"x {kind}, y {kind}, score double")
    found = found.groupBy("x").agg(F.max(F.struct("score", "y")).alias("m")).select("x", "m.*")
    # two rows that are each other's nearest are one pair, though the products of both directions may differ in the last bit
    return found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))


def cold_rows(rows: DataFrame, last_access: str, before: Column) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) by last access; rows never read are cold."""
    cold = F.coalesce(F.col(last_access) < before, F.lit(True))
    return rows.where(~cold), rows.where(cold)
