"""Graph algorithms: iterative ones as DataFrame rounds, inherently sequential ones as kernels per connected component."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import BOTH, OUT, Graph, weight
from quarry.operators.skew import components
from quarry.shared import settle

MOST_ROUNDS = 100
#: A sequential kernel takes one component into one task; larger ones are refused.
MOST_KERNEL_EDGES = 5_000_000
#: Walks from all nodes: steps that a task walks, tasks that share a component, partitions of tasks, and cells of a batch in a task (some 100 MB).
TASK_STEPS, MOST_TASKS, MOST_PARTITIONS, WALK_CELLS = 20_000_000, 256, 2000, 1 << 20


def _links(g: Graph) -> DataFrame:
    """Distinct undirected links a < b without loops."""
    return g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _adjacency(g: Graph) -> DataFrame:
    """Distinct neighbour pairs (src, dst) in both directions."""
    links = _links(g)
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))


# centrality


def pagerank(g: Graph, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = MOST_ROUNDS, direction: str = OUT) -> DataFrame:
    """(id, score), scores adding up to 1. Parallel edges count; ranks of nodes without out-edges are shared by all."""
    n = g.nodes.count()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    steps = g.arcs(direction).select("src", "dst")
    degree = steps.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    steps = settle(steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_m")).join(degree, "src").select("src", "dst", (F.col("_m") / F.col("_out")).alias("_p")), "steps")
    nodes = settle(g.nodes.select("id").join(degree, g.nodes["id"] == degree["src"], "left").select("id", F.col("_out").isNull().alias("_end")), "nodes")
    ranks = nodes.select("id", "_end", F.lit(1.0 / n).alias("score"))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("_end"), F.col("score"))), F.lit(0.0)).alias("_lost"))
        got = steps.join(ranks, steps["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("_p")).alias("_got"))
        new = ranks.withColumnRenamed("score", "_old").join(got, F.col("id") == got["dst"], "left").crossJoin(F.broadcast(lost))  # one row
        score = (1 - damping) / n + damping * (F.coalesce("_got", F.lit(0.0)) + F.col("_lost") / n)
        new = settle(new.select("id", "_end", "_old", score.alias("score")), "ranks")
        ranks = new.select("id", "_end", "score")
        if tolerance and (new.agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0] or 0.0) < tolerance:
            break
    return ranks.select("id", "score")


def eigenvector(g: Graph, tolerance: float = 1e-6, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, score) by power iteration over neighbour sets, of unit length."""
    n = g.nodes.count()
    steps = settle(_adjacency(g), "steps")
    scores = g.nodes.select("id", F.lit(1.0 / max(1, n)).alias("score"))
    for _ in range(rounds):
        got = steps.join(scores, steps["src"] == scores["id"]).groupBy("dst").agg(F.sum("score").alias("_got"))
        raw = settle(scores.withColumnRenamed("score", "_old").join(got, F.col("id") == got["dst"], "left").select("id", "_old", F.coalesce("_got", F.lit(0.0)).alias("_raw")), "raw")
        length = math.sqrt(raw.agg(F.sum(F.col("_raw") * F.col("_raw"))).first()[0] or 0.0)
        if not length:
            return g.nodes.select("id", F.lit(0.0).alias("score"))
        new = raw.select("id", "_old", (F.col("_raw") / length).alias("score"))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0] or 0.0
        scores = new.select("id", "score")
        if moved < tolerance:
            break
    return scores


def _sources(g: Graph, sample: int | None) -> DataFrame:
    ids = g.nodes.select("id")
    return ids if sample is None else ids.orderBy(F.xxhash64("id"), "id").limit(sample)


def closeness(g: Graph, direction: str = BOTH, sample: int | None = None) -> DataFrame:
    """(id, score): harmonic closeness, the sum of 1 / distance to the other nodes over n - 1."""
    n = g.nodes.count()
    sources = _sources(g, sample).distinct()
    found = _each_source(_steps(g, direction), sources, _harmonic, f"id {_id_type(g)}, score double", lambda steps, far: _harmonic_rounds(g, far, direction))
    return sources.join(found, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / max(1, n - 1)).alias("score"))


def betweenness(g: Graph, direction: str = BOTH, sample: int | None = None) -> DataFrame:
    """(id, score): shares of shortest paths through each node, halved."""
    found = _each_source(_steps(g, direction), _sources(g, sample).distinct(), _passed, f"id {_id_type(g)}, delta double", _passed_rounds)
    total = found.groupBy("id").agg((F.sum("delta") / 2).alias("score"))
    return g.nodes.select("id").join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _steps(g: Graph, direction: str) -> DataFrame:
    return settle(g.arcs(direction).where("src <> dst").select("src", "dst").distinct(), "steps")


def _each_source(steps: DataFrame, sources: DataFrame, run: Callable, schema: str, rounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What run(steps, sources) returns for groups of sources (component, id), each with all steps (component, src, dst) of its components.

    A task walks about TASK_STEPS steps: small components share one, the sources of a large one are dealt to up to MOST_TASKS, each of
    which gets its steps. Components of more than MOST_KERNEL_EDGES steps don't fit a task; rounds(steps, sources) walks from theirs.
    """
    part = settle(components(steps.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "part")
    own = settle(steps.join(part, steps["src"] == part["node"]).select("component", "src", "dst"), "own")
    starts = settle(sources.join(part, sources["id"] == part["node"]).select("component", "id"), "starts")
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("_m")).join(starts.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), "component")
    sizes = settle(sizes.select("component", "_m", F.ceil(F.col("_m").cast("double") * F.col("_n") / TASK_STEPS).alias("_tasks"), (F.col("_m").cast("double") * F.col("_n")).alias("_work")), "sizes")
    far = sizes.where(F.col("_m") > MOST_KERNEL_EDGES).select("component")
    large = sizes.where((F.col("_tasks") > 1) & (F.col("_m") <= MOST_KERNEL_EDGES))
    large = settle(large.select("component", F.monotonically_increasing_id().alias("_large"), F.least("_tasks", F.lit(MOST_TASKS)).cast("int").alias("_tasks")), "large")
    shared = max(1, math.ceil((sizes.where("_tasks <= 1").agg(F.sum("_work")).first()[0] or 0.0) / TASK_STEPS))
    groups = shared + (large.agg(F.sum("_tasks")).first()[0] or 0)

    def dealt(rows: DataFrame, columns: list[str], whole: bool) -> DataFrame:
        rows = rows.join(F.broadcast(far), "component", "left_anti").join(F.broadcast(large), "component", "left")  # components of hundreds of nodes
        tasks = F.coalesce("_tasks", F.lit(1))
        group = F.coalesce("_large", -1 - F.pmod(F.xxhash64("component"), F.lit(shared))).alias("_group")
        task = F.explode(F.sequence(F.lit(0), tasks - 1)) if whole else F.pmod(F.xxhash64("id"), tasks).cast("int")
        return rows.select("component", *columns, group, task.alias("_task")).repartition(min(groups, MOST_PARTITIONS), "_group", "_task")

    left, right = dealt(own, ["src", "dst"], True).groupBy("_group", "_task"), dealt(starts, ["id"], False).groupBy("_group", "_task")
    found = left.cogroup(right).applyInPandas(run, schema)
    return found if far.isEmpty() else found.unionByName(rounds(steps, starts.join(far, "component", "left_semi").select("id")))


def _walks(steps: pd.DataFrame, sources: pd.DataFrame, paths: bool) -> Iterator[tuple]:
    """(ids of a component's nodes, numbers of a batch of its sources, levels, sigma): breadth first from all sources of the batch at once.

    The node numbered v of the batch's source b is b * n + v. A level is (numbers reached, ends before and after of the steps there); the
    ends and sigma, the numbers of shortest paths, only with paths. A batch holds some WALK_CELLS cells and steps.
    """
    starts = dict(list(sources.groupby("component")["id"]))
    for component, arcs in steps.groupby("component"):
        if component not in starts:
            continue
        number, ids = pd.factorize(pd.concat([arcs["src"], arcs["dst"]], ignore_index=True))
        src, dst = number[: len(arcs)], number[len(arcs) :]
        n = len(ids)
        dst = dst[np.argsort(src, kind="stable")]
        degree = np.bincount(src, minlength=n)
        first = np.cumsum(degree) - degree
        at = pd.Index(ids).get_indexer(starts[component])
        size = max(1, WALK_CELLS // max(n, len(arcs)))
        for k in range(0, len(at), size):
            batch = at[k : k + size]
            front = np.arange(len(batch)) * n + batch
            seen, mark = np.full(len(batch) * n, -1, "int32"), np.empty(len(batch) * n, "int64")
            sigma = np.zeros(len(seen) if paths else 0)
            seen[front] = 0
            sigma[front if paths else []] = 1
            levels: list = []
            while len(front):
                v = front % n
                d = degree[v]
                below = np.repeat(first[v] - (np.cumsum(d) - d), d)
                below += np.arange(len(below))
                to, before = np.repeat(front - v, d) + dst[below], np.repeat(front, d) if paths else None
                new = seen[to] < 0
                to = to[new]
                order = np.arange(len(to))
                mark[to] = order
                front = to[mark[to] == order]  # each number once
                seen[front] = len(levels) + 1
                if paths:
                    before = before[new]
                    np.add.at(sigma, to, sigma[before])
                levels.append((front, before, to))
            yield ids, batch, levels, sigma


def _harmonic(steps: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    out = [pd.DataFrame({"id": [], "score": []})]
    for ids, batch, levels, _ in _walks(steps, sources, False):
        score = sum(np.bincount(front // len(ids), minlength=len(batch)) / (depth + 1) for depth, (front, _, _) in enumerate(levels))
        out.append(pd.DataFrame({"id": ids[batch], "score": score}))
    return pd.concat(out[1:] or out)


def _passed(steps: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Brandes: from the deepest level back, each node hands the share of paths through it to the nodes before it."""
    out = [pd.DataFrame({"id": [], "delta": []})]
    for ids, batch, levels, sigma in _walks(steps, sources, True):
        delta = np.zeros(len(sigma))
        for _, before, to in reversed(levels):
            np.add.at(delta, before, sigma[before] / sigma[to] * (1 + delta[to]))
        delta[np.arange(len(batch)) * len(ids) + batch] = 0
        out.append(pd.DataFrame({"id": ids, "delta": delta.reshape(len(batch), len(ids)).sum(0)}))
    return pd.concat(out[1:] or out).groupby("id", as_index=False)["delta"].sum()


def _harmonic_rounds(g: Graph, sources: DataFrame, direction: str) -> DataFrame:
    reached = g.distances(sources, direction)
    return reached.groupBy(F.col("source").alias("id")).agg(F.coalesce(F.sum(F.when(F.col("depth") > 0, 1 / F.col("depth"))), F.lit(0.0)).alias("score"))


def _passed_rounds(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, delta) by joins, all sources walk level by level at once."""
    level = settle(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("sigma")), "level")
    levels, reached = [level], level
    while True:
        new = level.join(steps, level["id"] == steps["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = new.join(reached.select("source", "id"), ["source", "id"], "left_anti")
        level = settle(new.select("source", "id", F.lit(len(levels)).alias("depth"), "sigma"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        reached = reached.unionByName(level)
    below, parts = None, []
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth].select("source", "id", "sigma")
        if below is not None:
            here = here.join(below, ["source", "id"], "left").select("source", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        else:
            here = here.withColumn("delta", F.lit(0.0))
        here = settle(here, "delta")
        parts.append(here.select("id", "delta"))
        up = levels[depth - 1].select("source", F.col("id").alias("_up"), F.col("sigma").alias("_us"))
        flow = here.join(steps, here["id"] == steps["dst"]).withColumn("_up", F.col("src")).join(up, ["source", "_up"])
        below = flow.groupBy("source", F.col("_up").alias("id")).agg(F.sum(F.col("_us") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    scores = None
    for p in parts:
        scores = p if scores is None else scores.unionByName(p)
    return steps.select(F.col("src").alias("id"), F.lit(0.0).alias("delta")).limit(0) if scores is None else scores


# communities


def connected_components(g: Graph) -> DataFrame:
    """(id, component): component is the smallest id that is connected, ignoring direction. Large-star, small-star rounds, hubs dealt out."""
    found = components(_links(g).select("a", "b"))
    return g.nodes.select("id").join(found, g.nodes["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(g: Graph, rounds: int = 10) -> DataFrame:
    """(id, community): all nodes at once take the most frequent label around them, ties to the smallest; odd and even rounds alternate halves."""
    steps = settle(_adjacency(g), "steps")
    labels = settle(g.nodes.select("id", F.col("id").alias("community")), "labels")
    for r in range(rounds):
        votes = steps.join(labels, steps["dst"] == labels["id"]).groupBy("src", "community").agg(F.count(F.lit(1)).alias("_n"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("_n"), F.col("community"))).alias("_new"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        new = labels.withColumnRenamed("community", "_old").join(best, F.col("id") == best["src"], "left")
        new = settle(new.select("id", "_old", F.when(turn, F.coalesce("_new", "_old")).otherwise(F.col("_old")).alias("community")), "labels")
        changed = not new.where("community <> _old").isEmpty()
        labels = new.select("id", "community")
        if not changed and r % 2:
            break
    return labels


def modularity(g: Graph, communities: DataFrame, resolution: float = 1.0) -> float:
    """Over existing edges: inner share minus resolution times the expected share of each community."""
    c = communities.select("id", "community")
    e = g.edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("_a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("_b")), "dst")
    m = e.count()
    if not m:
        return 0.0
    inner = e.where("_a = _b").count() / m
    ends = e.select(F.explode(F.array("_a", "_b")).alias("c")).groupBy("c").agg((F.count(F.lit(1)) / (2.0 * m)).alias("s"))
    return inner - resolution * (ends.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0)


def communities_by_size(communities: DataFrame, column: str = "community") -> DataFrame:
    return communities.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


# cores, triangles, spanning trees


def core_numbers(g: Graph) -> DataFrame:
    """(id, core): the largest k whose k-core holds the node, by peeling layer after layer."""
    left = settle(_adjacency(g), "left")
    done = [g.nodes.select("id").join(left.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("core", F.lit(0))]
    k = 1
    while not left.isEmpty():
        degree = left.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        thin = settle(degree.where(F.col("d") <= k).select("id"), "thin")
        if thin.isEmpty():
            k = degree.agg(F.min("d")).first()[0]
            continue
        rest = left.join(thin, left["src"] == thin["id"], "left_anti").join(thin, F.col("dst") == thin["id"], "left_anti")
        rest = settle(rest, "left")
        done.append(thin.withColumn("core", F.lit(k)))
        # nodes that lost their last link leave with this layer
        gone = left.select(F.col("src").alias("id")).distinct().join(thin, "id", "left_anti").join(rest.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        done.append(settle(gone.withColumn("core", F.lit(k)), "gone"))
        left = rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("id").agg(F.max("core").alias("core"))


def k_core(g: Graph, k: int) -> DataFrame:
    return core_numbers(g).where(F.col("core") >= k)


def degeneracy(g: Graph) -> int:
    return core_numbers(g).agg(F.max("core")).first()[0] or 0


def triangles(g: Graph) -> DataFrame:
    """(a, b, c) with every triangle once. Links point to the end of higher degree, which bounds what a hub opens."""
    links = _links(g)
    degree = _adjacency(g).groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    da, db = degree.select(F.col("src").alias("a"), F.col("_d").alias("_da")), degree.select(F.col("src").alias("b"), F.col("_d").alias("_db"))
    up = F.struct("_da", "a") < F.struct("_db", "b")
    arcs = links.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    one, two, close = arcs, arcs.select("x", F.col("y").alias("z")), arcs.select(F.col("x").alias("_p"), F.col("y").alias("_q"))
    open_ = one.join(two, "x").where("y <> z")
    found = open_.join(close, (F.col("y") == F.col("_p")) & (F.col("z") == F.col("_q")))
    ends = F.array_sort(F.array("x", "y", "z"))
    return found.select(ends[0].alias("a"), ends[1].alias("b"), ends[2].alias("c"))


def triangle_counts(g: Graph) -> DataFrame:
    each = triangles(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return g.nodes.select("id").join(each, "id", "left").select("id", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles"))


def clustering(g: Graph) -> DataFrame:
    """(id, triangles, coefficient): closed pairs of neighbours over all pairs; 0 below two neighbours."""
    degree = _adjacency(g).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    d = F.coalesce("d", F.lit(0))
    pairs = d * (d - 1) / 2
    return triangle_counts(g).join(degree, "id", "left").select("id", "triangles", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0).alias("coefficient"))


def transitivity(g: Graph) -> float:
    """Three times the triangles over the connected triples; 0 without triples."""
    degree = _adjacency(g).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    triples = degree.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()[0] or 0.0
    return 3 * triangles(g).count() / triples if triples else 0.0


def spanning_forest(g: Graph, weight_column: str | None = "weight", default: float = 1.0) -> DataFrame:
    """(a, b, w): edges of a minimum spanning forest by Boruvka rounds; ties by the ends, so that no cycle closes."""
    e = g.edges.where("src <> dst")
    links = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight(e, weight_column, default).alias("w"))
    links = settle(links.groupBy("a", "b").agg(F.min("w").alias("w")), "links")
    part = settle(g.nodes.select("id", F.col("id").alias("p")), "parts")
    chosen = None
    while True:
        pa, pb = part.select(F.col("id").alias("a"), F.col("p").alias("pa")), part.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        cut = settle(links.join(pa, "a").join(pb, "b").where("pa <> pb"), "cut")
        if cut.isEmpty():
            break
        ends = cut.select(F.explode(F.array("pa", "pb")).alias("p"), F.struct("w", "a", "b", "pa", "pb").alias("e"))
        best = settle(ends.groupBy("p").agg(F.min("e").alias("e")).select("e.*").distinct(), "best")
        chosen = best.select("a", "b", "w") if chosen is None else chosen.unionByName(best.select("a", "b", "w"))
        joined = connected_components(Graph(part.select(F.col("p").alias("id")).distinct(), best.select(F.col("pa").alias("src"), F.col("pb").alias("dst"))))
        part = settle(part.join(joined.select(F.col("id").alias("p"), "component"), "p").select("id", F.col("component").alias("p")), "parts")
        links = cut.select("a", "b", "w")
    return links.limit(0) if chosen is None else chosen


# neighbour similarity


def neighbour_similarity(g: Graph, metric: str = "jaccard", limit: int | None = None) -> DataFrame:
    """(a, b, score) of node pairs with a common neighbour, best first.

    jaccard, cosine, common, adamic_adar, resource_allocation or preferential_attachment.
    """
    adj = settle(_adjacency(g), "adjacency")
    degree = adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    hub = adj.join(degree, adj["src"] == degree["id"]).select(F.col("src").alias("h"), F.col("dst").alias("n"), "d")
    one, two = hub.select("h", F.col("n").alias("a"), "d"), hub.select("h", F.col("n").alias("b"))
    pairs = one.join(two, "h").where("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("d") > 1, 1 / F.log(F.col("d").cast("double")))).alias("aa"), F.sum(1 / F.col("d")).alias("ra")
    )
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    pairs = pairs.join(da, "a").join(db, "b")
    score = {
        "jaccard": F.col("c") / (F.col("da") + F.col("db") - F.col("c")), "cosine": F.col("c") / F.sqrt(F.col("da") * F.col("db")), "common": F.col("c").cast("double"),
        "adamic_adar": F.coalesce("aa", F.lit(0.0)), "resource_allocation": F.col("ra"), "preferential_attachment": (F.col("da") * F.col("db")).cast("double"),
    }[metric]
    out = pairs.select("a", "b", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "a", "b")
    return out if limit is None else out.limit(limit)


# sequential kernels, one task per connected component


def _kernel(g: Graph, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame], weight_column: str | None = None) -> DataFrame:
    """run(edges src, dst, w of one component) for each component with edges; larger components than MOST_KERNEL_EDGES are refused."""
    part = settle(connected_components(g), "component")
    e = g.edges.select("src", "dst", weight(g.edges, weight_column).alias("w"))
    e = e.join(part, e["src"] == part["id"]).select("component", "src", "dst", "w")
    most = e.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_KERNEL_EDGES:
        raise ValueError(f"a component has {most} edges; this algorithm is sequential and takes at most {MOST_KERNEL_EDGES}")
    return e.groupBy("component").applyInPandas(run, schema)


def _id_type(g: Graph) -> str:
    return g.nodes.schema["id"].dataType.simpleString()


def strongly_connected(g: Graph) -> DataFrame:
    """(id, component): component is the smallest id of the strongly connected set."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for a, b in zip(edges["src"], edges["dst"], strict=True):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
        index, low, on, stack, label, n = {}, {}, set(), [], {}, 0
        for root in sorted(out):
            if root in index:
                continue
            work = [(root, iter(out[root]))]
            index[root] = low[root] = n
            n += 1
            stack.append(root)
            on.add(root)
            while work:
                v, it = work[-1]
                w = next(it, None)
                if w is None:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        members = []
                        while not members or members[-1] != v:
                            members.append(stack.pop())
                            on.discard(members[-1])
                        label.update(dict.fromkeys(members, min(members)))
                elif w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                elif w in on:
                    low[v] = min(low[v], index[w])
        return pd.DataFrame({"id": list(label), "component": list(label.values())})

    kind = _id_type(g)
    found = _kernel(g, f"id {kind}, component {kind}", run)
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def condensation(g: Graph) -> DataFrame:
    """(src, dst) between strongly connected components, an acyclic graph."""
    part = settle(strongly_connected(g), "scc")
    e = g.edges.join(part.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src").join(part.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst")
    return e.where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def is_strongly_connected(g: Graph) -> bool:
    return strongly_connected(g).select("component").distinct().count() == 1


def biconnected(g: Graph) -> DataFrame:
    """(kind, a, b, part): kind 'edge' lists each link with its biconnected part, 'bridge' the bridges, 'articulation' cut nodes (b NULL)."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for a, b in zip(edges["src"], edges["dst"], strict=True):
            if a != b:
                adj.setdefault(a, set()).add(b)
                adj.setdefault(b, set()).add(a)
        rows, cut, n, part = [], set(), 0, 0
        index, low = {}, {}
        for root in sorted(adj):
            if root in index:
                continue
            index[root] = low[root] = n
            n += 1
            stack, work, children = [], [(root, None, iter(sorted(adj[root])))], 0
            while work:
                v, parent, it = work[-1]
                w = next(it, None)
                if w is None:
                    work.pop()
                    if not work:
                        continue
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= index[u]:
                        if u != root:
                            cut.add(u)
                        members = []
                        while not members or members[-1] != (u, v):
                            members.append(stack.pop())
                        rows += [("edge", min(e), max(e), part) for e in members]
                        if len(members) == 1:
                            rows.append(("bridge", min(u, v), max(u, v), part))
                        part += 1
                elif w not in index:
                    index[w] = low[w] = n
                    n += 1
                    children += v == root
                    stack.append((v, w))
                    work.append((w, v, iter(sorted(adj[w]))))
                elif w != parent and index[w] < index[v]:
                    low[v] = min(low[v], index[w])
                    stack.append((v, w))
            if children > 1:
                cut.add(root)
        rows += [("articulation", v, None, None) for v in sorted(cut)]
        return pd.DataFrame(rows, columns=["kind", "a", "b", "part"], dtype=object)

    kind = _id_type(g)
    return _kernel(g, f"kind string, a {kind}, b {kind}, part long", run)


def articulation_points(g: Graph) -> DataFrame:
    return biconnected(g).where("kind = 'articulation'").select(F.col("a").alias("id"))


def bridges(g: Graph) -> DataFrame:
    return biconnected(g).where("kind = 'bridge'").select("a", "b")


def louvain(g: Graph, weight_column: str | None = None, resolution: float = 1.0, passes: int = 20) -> DataFrame:
    """(id, community): local moving on one level, nodes in id order, gain = weight into a community minus into the own, ties to the smallest."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for a, b, w in zip(edges["src"], edges["dst"], edges["w"], strict=True):
            if a != b:
                adj.setdefault(a, {}).setdefault(b, 0.0)
                adj.setdefault(b, {}).setdefault(a, 0.0)
                adj[a][b] += w
                adj[b][a] += w
            else:
                adj.setdefault(a, {})
        home = {v: v for v in adj}
        for _ in range(passes):
            moved = False
            for v in sorted(adj):
                to: dict = {}
                for w, k in adj[v].items():
                    to[home[w]] = to.get(home[w], 0.0) + k
                own = to.get(home[v], 0.0)
                best = max(to, key=lambda c: (to[c], -c if isinstance(c, int | float | np.integer) else 0), default=home[v])
                if (to.get(best, 0.0) - own) * resolution > 1e-12:
                    home[v], moved = best, True
            if not moved:
                break
        least: dict = {}
        for v, c in home.items():
            least[c] = min(least.get(c, v), v)
        return pd.DataFrame({"id": list(home), "community": [least[c] for c in home.values()]})

    kind = _id_type(g)
    found = _kernel(g, f"id {kind}, community {kind}", run, weight_column)
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def a_star(g: Graph, a, b, weight_column: str | None = "weight", heuristic: Callable | None = None, positions: dict | None = None, kind: str = "euclidean") -> tuple[list, float] | None:
    """(path, total) by A*; heuristic(node, goal), or euclidean or manhattan over positions {id: (x, y)}; None without a path.

    The component's edges come to the driver, at most MOST_KERNEL_EDGES of them.
    """
    import heapq

    arcs = g.arcs(OUT)
    if arcs.limit(MOST_KERNEL_EDGES + 1).count() > MOST_KERNEL_EDGES:
        raise ValueError("too many edges for A*; use weighted_paths")
    adj: dict = {}
    for r in arcs.select("src", "dst", weight(arcs, weight_column).alias("w")).toLocalIterator():
        adj.setdefault(r["src"], []).append((r["dst"], r["w"]))
    if heuristic is None:
        def heuristic(v, goal):
            if not positions or v not in positions:
                return 0.0
            dx, dy = (p - q for p, q in zip(positions[v], positions[goal], strict=True))
            return abs(dx) + abs(dy) if kind == "manhattan" else math.hypot(dx, dy)
    heap, best, via = [(heuristic(a, b), 0.0, a)], {a: 0.0}, {}
    while heap:
        _, d, v = heapq.heappop(heap)
        if v == b:
            path = [v]
            while path[-1] != a:
                path.append(via[path[-1]])
            return path[::-1], d
        if d > best[v]:
            continue
        for w, k in adj.get(v, ()):
            if d + k < best.get(w, math.inf):
                best[w], via[w] = d + k, v
                heapq.heappush(heap, (d + k + heuristic(w, b), d + k, w))
    return None
