"""Property graphs as two DataFrames: scans, changes, degrees, traversal, paths and patterns.

nodes has id, and may have labels (array<string>) and property columns. edges has src and dst, and
may have id, type, directed (default true) and property columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.conditions import TRUE, Condition, compile_condition
from quarry.operators.relational import aggregate_column, page
from quarry.shared import settle

OUT, IN, BOTH = "outgoing", "incoming", "both"
MOST_HOPS, MOST_PATHS, MOST_MATCHES = 20, 1000, 1000


class NegativeWeightError(ValueError):
    pass


def _where(df: DataFrame, condition: Condition | Column | None) -> DataFrame:
    if condition is None:
        return df
    return df.where(condition if isinstance(condition, Column) else compile_condition(condition, "graph"))


def weight(edges: DataFrame, column: str | None, default: float = 1.0) -> Column:
    """An edge's weight as double; missing or unreadable weights are default."""
    return F.coalesce(F.expr(f"try_cast({column} as double)"), F.lit(default)) if column and column in edges.columns else F.lit(default)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # scans and lookups

    def node(self, ident) -> DataFrame:
        return self.nodes.where(F.col("id") == F.lit(ident))

    def edge(self, ident) -> DataFrame:
        return self.edges.where(F.col("id") == F.lit(ident))

    def with_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("labels", label))

    def with_all_labels(self, labels: list[str]) -> DataFrame:
        return self.nodes.where(F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0)

    def with_any_label(self, labels: list[str]) -> DataFrame:
        return self.nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))

    def labels(self) -> DataFrame:
        return self.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def find_nodes(self, where: Condition | Column = TRUE, label: str | None = None) -> DataFrame:
        return _where(self.with_label(label) if label else self.nodes, where)

    def find_edges(self, where: Condition | Column = TRUE, kind: str | None = None) -> DataFrame:
        return _where(self.edges.where(F.col("type") == kind) if kind else self.edges, where)

    # pages in id order, with the number of all rows where it is asked for

    def nodes_page(self, offset: int = 0, limit: int = 100, where: Condition | Column = TRUE, label: str | None = None, total: bool = False) -> tuple[DataFrame, bool, int | None]:
        return self._page(self.find_nodes(where, label), offset, limit, total)

    def edges_page(self, offset: int = 0, limit: int = 100, where: Condition | Column = TRUE, kind: str | None = None, total: bool = False) -> tuple[DataFrame, bool, int | None]:
        return self._page(self.find_edges(where, kind), offset, limit, total)

    def incident_page(self, ident, offset: int = 0, limit: int = 100, direction: str = BOTH, total: bool = False) -> tuple[DataFrame, bool, int | None]:
        return self._page(self.incident(ident, direction), offset, limit, total)

    def neighbours_page(self, ident, offset: int = 0, limit: int = 100, direction: str = BOTH, kind: str | None = None, total: bool = False) -> tuple[DataFrame, bool, int | None]:
        return self._page(self.neighbours(ident, direction, kind), offset, limit, total)

    @staticmethod
    def _page(df: DataFrame, offset: int, limit: int, total: bool) -> tuple[DataFrame, bool, int | None]:
        """(rows of the page, whether there are more, number of all rows or None)."""
        rows, more = page(df, ["id"], offset, limit)
        return rows, more, df.count() if total else None

    # changes, copy on write

    def add_nodes(self, rows: DataFrame) -> Graph:
        return replace(self, nodes=self.nodes.unionByName(rows, allowMissingColumns=True))

    def add_edges(self, rows: DataFrame) -> Graph:
        """Edges whose ends exist are added; dangling_edges() lists the others."""
        ids = self.nodes.select("id")
        rows = rows.join(ids, rows["src"] == ids["id"], "left_semi").join(ids, rows["dst"] == ids["id"], "left_semi")
        return replace(self, edges=self.edges.unionByName(rows, allowMissingColumns=True))

    def dangling_edges(self, rows: DataFrame) -> DataFrame:
        ids = self.nodes.select(F.col("id").alias("_i"))
        lost = [rows.join(ids, rows[end] == ids["_i"], "left_anti") for end in ("src", "dst")]
        return lost[0].unionByName(lost[1]).dropDuplicates()

    def update_nodes(self, where: Condition | Column, changes: dict[str, Column]) -> Graph:
        hit = F.coalesce(where if isinstance(where, Column) else compile_condition(where, "graph"), F.lit(False))
        return replace(self, nodes=self.nodes.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()}))

    def update_edges(self, where: Condition | Column, changes: dict[str, Column]) -> Graph:
        hit = F.coalesce(where if isinstance(where, Column) else compile_condition(where, "graph"), F.lit(False))
        return replace(self, edges=self.edges.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()}))

    def add_label(self, where: Condition | Column, label: str) -> Graph:
        return self.update_nodes(where, {"labels": F.array_union("labels", F.array(F.lit(label)))})

    def remove_label(self, where: Condition | Column, label: str) -> Graph:
        return self.update_nodes(where, {"labels": F.array_remove("labels", label)})

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Nodes of a table with an id column, and their edges."""
        gone = ids.select(F.col("id").alias("_g"))
        edges = self.edges.join(gone, self.edges["src"] == gone["_g"], "left_anti").join(gone, F.col("dst") == gone["_g"], "left_anti")
        return Graph(self.nodes.join(gone, self.nodes["id"] == gone["_g"], "left_anti"), edges)

    def delete_edges(self, where: Condition | Column) -> Graph:
        hit = where if isinstance(where, Column) else compile_condition(where, "graph")
        return replace(self, edges=self.edges.where(~F.coalesce(hit, F.lit(False))))

    # constraints: the rows that violate them

    def violates_unique(self, prop: str, label: str | None = None) -> DataFrame:
        rows = self.with_label(label) if label else self.nodes
        return rows.where(F.col(prop).isNotNull()).groupBy(prop).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def violates_exists(self, prop: str, label: str | None = None) -> DataFrame:
        return (self.with_label(label) if label else self.nodes).where(F.col(prop).isNull())

    def violates_type(self, prop: str, kind: str, label: str | None = None) -> DataFrame:
        rows = self.with_label(label) if label else self.nodes
        return rows.where(F.col(prop).isNotNull() & F.expr(f"try_cast({prop} as {kind})").isNull())

    # arcs, degrees, neighbours

    def arcs(self, direction: str = OUT, kind: str | None = None, where: Condition | Column | None = None) -> DataFrame:
        """Edges as walkable steps (src, dst, ...): undirected edges go both ways, incoming turns directed ones round."""
        edges = _where(self.edges.where(F.col("type") == kind) if kind else self.edges, where)
        turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        if direction == BOTH:
            return edges.unionByName(turned)
        undirected = ~F.coalesce(F.col("directed"), F.lit(True)) if "directed" in edges.columns else None
        if direction == OUT:
            return edges if undirected is None else edges.unionByName(turned.where(undirected))
        return turned if undirected is None else turned.unionByName(edges.where(undirected))

    def degrees(self, direction: str = BOTH, by_type: bool = False) -> DataFrame:
        """id, [type,] degree of every node with an edge end of that direction."""
        keys = ["type"] if by_type else []
        ends = {OUT: ["src"], IN: ["dst"], BOTH: ["src", "dst"]}[direction]
        each = self.edges.select(F.explode(F.array(*ends)).alias("id"), *keys)
        return each.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("degree"))

    def incident(self, ident, direction: str = BOTH) -> DataFrame:
        src, dst = F.col("src") == F.lit(ident), F.col("dst") == F.lit(ident)
        return self.edges.where({OUT: src, IN: dst, BOTH: src | dst}[direction])

    def neighbours(self, ident, direction: str = BOTH, kind: str | None = None, where: Condition | Column | None = None) -> DataFrame:
        """Distinct neighbouring nodes in id order, the node itself left out."""
        near = self.arcs(direction, kind).where((F.col("src") == F.lit(ident)) & (F.col("dst") != F.lit(ident))).select(F.col("dst").alias("id")).distinct()
        return _where(self.nodes.join(near, "id", "left_semi"), where).orderBy("id")

    # traversal

    def distances(self, sources: DataFrame | Iterable, direction: str = BOTH, max_depth: int | None = None, kind: str | None = None, where: Condition | Column | None = None) -> DataFrame:
        """(source, id, depth) of all nodes within reach by breadth-first search, the source at depth 0.

        One join per level over the frontier only; levels are cut off from their lineage.
        """
        spark = self.nodes.sparkSession
        if not isinstance(sources, DataFrame):
            kind_of = self.nodes.schema["id"].dataType.simpleString()
            sources = spark.createDataFrame([(s,) for s in sources], f"id {kind_of}")
        steps = settle(self.arcs(direction, kind, where).select("src", "dst").where("src <> dst").distinct(), "steps")
        frontier = sources.join(self.nodes.select("id"), "id", "left_semi").select(F.col("id").alias("source"), "id", F.lit(0).alias("depth")).distinct()
        frontier = reached = settle(frontier, "level")
        depth = 0
        while max_depth is None or depth < max_depth:
            depth += 1
            new = frontier.join(steps, frontier["id"] == steps["src"]).select("source", F.col("dst").alias("id")).distinct()
            frontier = settle(new.join(reached, ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        return reached

    def traverse(self, start, direction: str = BOTH, max_depth: int = 3, kind: str | None = None, edge_where: Condition | Column | None = None, node_where: Condition | Column | None = None) -> DataFrame:
        """Nodes within max_depth of start with depth; node_where gates the output, not the walk, and start always stays."""
        found = self.distances([start], direction, max_depth, kind, edge_where).select("id", "depth")
        rows = self.nodes.join(found, "id")
        kept = rows if node_where is None else rows.where((F.col("id") == F.lit(start)) | (node_where if isinstance(node_where, Column) else compile_condition(node_where, "graph")))
        return kept.orderBy("depth", "id")

    def shortest_paths(self, a, b, direction: str = OUT, max_depth: int | None = None, most: int | None = None) -> DataFrame:
        """path (array of ids) of every shortest path from a to b in order, or the first most of them; none if b is out of reach."""
        reached = settle(self.distances([a], direction, max_depth).select("id", "depth"), "depths")
        goal = reached.where(F.col("id") == F.lit(b)).first()
        kind = self.nodes.schema["id"].dataType.simpleString()
        if goal is None:
            return self.nodes.sparkSession.createDataFrame([], f"path array<{kind}>")
        steps = self.arcs(direction).select("src", "dst").distinct()
        # backwards from b, the steps of each level that lead to it; every path along them is a shortest one
        on, levels = reached.where(F.col("id") == F.lit(b)).select(F.col("id").alias("_on")), []
        for depth in range(goal["depth"] - 1, -1, -1):
            level = reached.where(F.col("depth") == depth).select(F.col("id").alias("_up"))
            levels.append(settle(steps.join(level, steps["src"] == level["_up"], "left_semi").join(on, F.col("dst") == F.col("_on"), "left_semi"), "level"))
            on = levels[-1].select(F.col("src").alias("_on")).distinct()
        return self._walk(reached.where(F.col("depth") == 0).select(F.array("id").alias("path")), reversed(levels), most).orderBy("path")

    @staticmethod
    def _walk(paths: DataFrame, levels, most: int | None) -> DataFrame:
        """paths grown by one step of each level. As every beginning can be completed, the first most beginnings hold the first most paths."""
        for steps in levels:
            paths = paths.withColumn("_tail", F.element_at("path", -1)).join(steps, F.col("_tail") == steps["src"]).select(F.concat("path", F.array("dst")).alias("path"))
            if most is not None:
                paths = settle(paths.orderBy("path").limit(most), "paths")
        return paths

    def shortest_path(self, a, b, max_depth: int | None = None) -> DataFrame:
        """The least of the shortest paths, over edges in both directions whatever their own."""
        return self.shortest_paths(a, b, BOTH, max_depth, 1)

    def weighted_distances(self, source, weight_column: str | None = "weight", direction: str = OUT, default: float = 1.0) -> DataFrame:
        """(id, distance, via): least total weight from source by rounds of relaxation from nodes that improved."""
        arcs = self.arcs(direction)
        steps = settle(arcs.select("src", "dst", weight(arcs, weight_column, default).alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "steps")
        if not steps.where("w < 0").isEmpty():
            raise NegativeWeightError("weights must not be negative")
        none = F.lit(None).cast(self.nodes.schema["id"].dataType)
        best = changed = settle(self.node(source).select("id", F.lit(0.0).alias("distance"), none.alias("via")), "best")
        while True:
            offers = changed.join(steps, changed["id"] == steps["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("_d"), F.col("src").alias("_v"))
            offers = offers.groupBy("id").agg(F.min(F.struct("_d", "_v")).alias("_o"))
            better = offers.join(best.select("id", "distance"), "id", "left").where("distance is null or _o._d < distance")
            changed = settle(better.select("id", F.col("_o._d").alias("distance"), F.col("_o._v").alias("via")), "changed")
            if changed.isEmpty():
                return best
            best = settle(best.join(changed.select("id"), "id", "left_anti").unionByName(changed), "best")

    def weighted_paths(self, a, b, weight_column: str | None = "weight", direction: str = OUT, most: int | None = None) -> DataFrame:
        """(path, total) of every path of least total weight from a to b in order, or the first most of them, without repeated nodes."""
        best = settle(self.weighted_distances(a, weight_column, direction).select("id", "distance"), "dist")
        goal = best.where(F.col("id") == F.lit(b)).first()
        arcs = self.arcs(direction)
        steps = arcs.select("src", "dst", weight(arcs, weight_column).alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w"))
        tight = steps.join(best.select(F.col("id").alias("src"), F.col("distance").alias("_ds")), "src").join(best.select(F.col("id").alias("dst"), F.col("distance").alias("_dd")), "dst")
        tight = settle(tight.where(F.abs(F.col("_ds") + F.col("w") - F.col("_dd")) < 1e-9).select("src", "dst"), "tight")
        # only steps that lead to b, found backwards
        on = new = best.where(F.col("id") == F.lit(b)).select("id")
        while not new.isEmpty():
            before = tight.join(new, tight["dst"] == new["id"], "left_semi").select(F.col("src").alias("id")).distinct()
            new = settle(before.join(on, "id", "left_anti"), "new")
            on = settle(on.unionByName(new), "on")
        tight = settle(tight.join(on, tight["dst"] == on["id"], "left_semi"), "useful")
        open_ = self.node(a).select(F.array("id").alias("path")) if goal is not None else best.limit(0).select(F.array("id").alias("path"))
        done = open_.where(F.col("path")[0] == F.lit(b))
        open_ = open_.where(F.col("path")[0] != F.lit(b))
        while not open_.isEmpty():
            grown = open_.withColumn("_tail", F.element_at("path", -1)).join(tight, F.col("_tail") == tight["src"]).where(~F.array_contains("path", F.col("dst")))
            grown = grown.select(F.concat("path", F.array("dst")).alias("path"))
            grown = settle(grown.orderBy("path").limit(most) if most is not None else grown, "paths")
            done = done.unionByName(grown.where(F.element_at("path", -1) == F.lit(b)))
            open_ = grown.where(F.element_at("path", -1) != F.lit(b))
        out = done.withColumn("total", F.lit(goal["distance"] if goal else None).cast("double")).orderBy("path")
        return out if most is None else out.limit(most)

    def simple_paths(self, a, b, least: int = 1, most_hops: int = 5, direction: str = OUT, kind: str | None = None, most: int | None = None) -> DataFrame:
        """path of every simple path of least to most_hops hops, shortest first, or the first most of them."""
        if most_hops > MOST_HOPS:
            raise ValueError(f"at most {MOST_HOPS} hops")
        steps = self.arcs(direction, kind).select("src", "dst").distinct()
        grown = self.node(a).select(F.array("id").alias("path"))
        found = None
        for hop in range(1, most_hops + 1):
            grown = grown.withColumn("_tail", F.element_at("path", -1)).join(steps, F.col("_tail") == steps["src"])
            grown = grown.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
            if hop >= least:
                hit = grown.where(F.element_at("path", -1) == F.lit(b))
                found = hit if found is None else found.unionByName(hit)
            grown = grown.where(F.element_at("path", -1) != F.lit(b))
        found = found.orderBy(F.size("path"), "path")
        return found if most is None else found.limit(most)

    # aggregates over properties

    def node_aggregate(self, prop: str, calls: list[str], where: Condition | Column = TRUE, label: str | None = None) -> DataFrame:
        """count, sum, avg, min, max of a property; the sum of nothing stays NULL."""
        return self.find_nodes(where, label).agg(*[aggregate_column(c, prop, None) for c in calls])

    def edge_aggregate(self, prop: str, calls: list[str], where: Condition | Column = TRUE, kind: str | None = None) -> DataFrame:
        return self.find_edges(where, kind).agg(*[aggregate_column(c, prop, None) for c in calls])

    # patterns

    def match(self, pattern: Pattern, limit: int | None = None) -> DataFrame:
        """Bindings of a path pattern: a column per variable, node and edge ids (or paths for variable lengths).

        Matching is homomorphic: nodes and edges may repeat. A variable used twice must bind the
        same node. One join per hop; the planner orders and prunes them.
        """
        out = None
        for i, n in enumerate(pattern.nodes):
            var = n.name or f"_n{i}"
            rows = self.find_nodes(n.where, n.label).select(F.col("id").alias(f"_id{i}"))
            if out is None:
                out = rows.withColumn(var, F.col(f"_id{i}"))
                continue
            e = pattern.edges[i - 1]
            out = self._hop(out, e, i)
            out = out.join(rows, f"_id{i}", "left_semi")
            out = out.where(F.col(var) == F.col(f"_id{i}")) if var in out.columns else out.withColumn(var, F.col(f"_id{i}"))
        named = [c for c in out.columns if not c.startswith("_")]
        out = out.select(*named)
        return out if limit is None else out.limit(limit)

    def _hop(self, out: DataFrame, e: EdgePattern, i: int) -> DataFrame:
        arcs = self.arcs(e.direction, e.type, e.where)
        ident = F.col("id") if "id" in arcs.columns else F.lit(None).cast("long")
        steps = arcs.select(F.col("src").alias(f"_s{i}"), F.col("dst").alias(f"_id{i}"), ident.alias(f"_e{i}"))
        if e.least == 1 and e.most == 1:
            out = out.join(steps, out[f"_id{i - 1}"] == steps[f"_s{i}"]).drop(f"_s{i}")
            return out.withColumn(e.name, F.col(f"_e{i}")).drop(f"_e{i}") if e.name else out.drop(f"_e{i}")
        if e.most > MOST_HOPS:
            raise ValueError(f"at most {MOST_HOPS} hops")
        grown = out.withColumn("_path", F.array(f"_id{i - 1}"))
        parts = [grown] if e.least == 0 else []
        pairs = steps.select(F.col(f"_s{i}").alias("_a"), F.col(f"_id{i}").alias("_b")).distinct()
        for hop in range(1, e.most + 1):
            grown = grown.withColumn("_tail", F.element_at("_path", -1)).join(pairs, F.col("_tail") == F.col("_a"))
            grown = grown.where(~F.array_contains("_path", F.col("_b"))).withColumn("_path", F.concat("_path", F.array("_b"))).drop("_tail", "_a", "_b")
            if hop >= e.least:
                parts.append(grown)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.withColumn(f"_id{i}", F.element_at("_path", -1))
        return found.withColumnRenamed("_path", e.name) if e.name else found.drop("_path")

    def count_matches(self, pattern: Pattern) -> int:
        return self.match(pattern, None).count()

    def has_match(self, pattern: Pattern) -> bool:
        return not self.match(pattern, 1).isEmpty()

    def merge_node(self, where: Condition, create: DataFrame, on_match: dict[str, Column] | None = None) -> Graph:
        """MERGE: change the nodes that match, or add the given ones when none does."""
        if self.find_nodes(where).isEmpty():
            return self.add_nodes(create)
        return self.update_nodes(where, on_match or {})


@dataclass(frozen=True)
class NodePattern:
    name: str | None = None
    label: str | None = None
    where: Condition | Column = TRUE


@dataclass(frozen=True)
class EdgePattern:
    """One step; least and most other than 1 bind a path of that many hops without repeated nodes."""

    name: str | None = None
    type: str | None = None
    direction: str = OUT
    where: Condition | Column | None = None
    least: int = 1
    most: int = 1


@dataclass(frozen=True)
class Pattern:
    nodes: list[NodePattern]
    edges: list[EdgePattern] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.nodes) != len(self.edges) + 1:
            raise ValueError("a path pattern has one more node than edges")


# Edges between string-keyed entities: (src_key, dst_key, type, directed).


def entity_neighbours(edges: DataFrame, key: str, direction: str = BOTH, kind: str | None = None) -> DataFrame:
    """Distinct keys linked to key; undirected edges count in both directions."""
    rows = edges.where(F.col("type") == kind) if kind else edges
    undirected = ~F.coalesce(F.col("directed"), F.lit(True)) if "directed" in edges.columns else F.lit(False)
    out = rows.where(F.col("src_key") == key).select(F.col("dst_key").alias("key"))
    inn = rows.where(F.col("dst_key") == key).select(F.col("src_key").alias("key"))
    if direction == OUT:
        inn = rows.where((F.col("dst_key") == key) & undirected).select(F.col("src_key").alias("key"))
    elif direction == IN:
        out = rows.where((F.col("src_key") == key) & undirected).select(F.col("dst_key").alias("key"))
    return out.union(inn).distinct()


def entities_with_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_key", "dst_key")).alias("key")).distinct()
