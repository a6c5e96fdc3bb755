"""Cross-model operators: entities that have fields, links and an embedding; FIND over nodes, edges, rows and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import display
from quarry.operators.conditions import TRUE, Condition, compile_condition
from quarry.operators.graph import BOTH, Graph, entity_neighbours
from quarry.operators.vector_search import search, search_by_key

MOST_PATHS = 100
ITEM = "source string, id string, data map<string,string>, score double"


def entity_view(entities: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per key with its fields, neighbours and embedding."""
    near = edges.select(F.col("src_key").alias("key"), F.col("dst_key").alias("n")).union(edges.select(F.col("dst_key"), F.col("src_key")))
    near = near.groupBy("key").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))
    return entities.join(near, "key", "left").join(embeddings.select("key", "embedding"), "key", "left")


def delete_entities(keys: DataFrame, entities: DataFrame, edges: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the keys and their links."""
    gone = keys.select(F.col("key").alias("_k"))
    kept = edges.join(gone, edges["src_key"] == gone["_k"], "left_anti").join(gone, F.col("dst_key") == gone["_k"], "left_anti")
    drop = lambda df: df.join(gone, df["key"] == gone["_k"], "left_anti")
    return drop(entities), kept, drop(embeddings)


def connect(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.unionByName(rows, allowMissingColumns=True)


def disconnect(edges: DataFrame, a: str, b: str, kind: str | None = None) -> tuple[DataFrame, int]:
    """(edges without those between a and b, how many they were)."""
    hit = ((F.col("src_key") == a) & (F.col("dst_key") == b)) | ((F.col("src_key") == b) & (F.col("dst_key") == a))
    hit = F.coalesce(hit & (F.col("type") == kind) if kind else hit, F.lit(False))
    return edges.where(~hit), edges.where(hit).count()


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failures): batches report failures row by row."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def similar_connected(embeddings: DataFrame, edges: DataFrame, query: list[float], entity: str, k: int, metric: str = "cosine", where: Condition | Column = TRUE, oversample: int | None = None) -> DataFrame:
    """The k entities most similar to query among the neighbours of entity.

    Neighbours are taken first, so k of them are found where there are k. With oversample the
    search comes first, for k x oversample rows, and may leave fewer.
    """
    near = entity_neighbours(edges, entity, BOTH)
    if oversample:
        found = search(embeddings, query, k * oversample, metric, where)
        return found.join(near, "key", "left_semi").orderBy(F.col("score").desc(), "key").limit(k)
    return search(embeddings.join(near, "key", "left_semi"), query, k, metric, where)


def neighbours_by_similarity(embeddings: DataFrame, edges: DataFrame, entity: str, query: list[float] | None, k: int, metric: str = "cosine") -> DataFrame:
    """Neighbours of entity ranked by similarity to query, or to the entity's own vector."""
    near = embeddings.join(entity_neighbours(edges, entity, BOTH), "key", "left_semi")
    if query is None:
        return search_by_key(near.unionByName(embeddings.where(F.col("key") == entity)), entity, k, metric)
    return search(near, query, k, metric)


def _items(df: DataFrame, source: str, ident: Column, score: Column | None = None) -> DataFrame:
    """Rows in the common shape: source, id, data (all columns as text), score."""
    kinds = dict(df.dtypes)
    pairs = [x for c in df.columns if not kinds[c].startswith(("array", "map", "struct")) for x in (F.lit(c), display(F.col(c), kinds[c]))]
    data = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(source).alias("source"), ident.cast("string").alias("id"), data.alias("data"), (score if score is not None else F.lit(None).cast("double")).alias("score"))


def find_nodes(g: Graph, label: str | None = None, where: Condition | Column = TRUE, limit: int | None = None) -> DataFrame:
    out = _items(g.find_nodes(where, label), "graph", F.col("id"))
    return out if limit is None else out.orderBy(F.col("id")).limit(limit)


def find_edges(g: Graph, kind: str | None = None, where: Condition | Column = TRUE, limit: int | None = None) -> DataFrame:
    edges = g.find_edges(where, kind)
    out = _items(edges, "graph", F.col("id") if "id" in edges.columns else F.concat_ws("->", "src", "dst"))
    return out if limit is None else out.orderBy(F.col("id")).limit(limit)


def find_rows(table: DataFrame, name: str, id_col: str, where: Condition | Column = TRUE, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = table.where(where if isinstance(where, Column) else compile_condition(where, "sql"))
    rows = rows.select(*dict.fromkeys([id_col, *(columns or table.columns)]))
    out = _items(rows, f"relational:{name}", F.col(id_col))
    return out if limit is None else out.orderBy(F.col("id")).limit(limit)


def find_similar(embeddings: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    found = search(embeddings, query, k, metric)
    return _items(found, "vector", F.col("key"), F.col("score"))


def endpoints(g: Graph, end: str) -> DataFrame:
    """Nodes named by a numeric id, else by a label."""
    return g.node(int(end)) if end.lstrip("-").isdigit() else g.with_label(end)


def find_paths(g: Graph, start: str, end: str, kind: str | None = None, limit: int = MOST_PATHS) -> DataFrame:
    """(start, end, path) of a shortest path for each pair of end nodes, walked both ways; kind filters by edge type on the way."""
    a, b = endpoints(g, start).select("id"), endpoints(g, end).select("id")
    level = a.select(F.col("id").alias("start"), "id", F.array("id").alias("path"))
    steps = g.arcs(BOTH, kind).select("src", "dst").where("src <> dst").distinct()
    from quarry.shared import settle

    steps, level = settle(steps, "steps"), settle(level, "level")
    reached = level
    while not level.isEmpty():
        new = level.join(steps, level["id"] == steps["src"]).select("start", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("start", "id").agg(F.min("path").alias("path"))
        level = settle(new.join(reached.select("start", "id"), ["start", "id"], "left_anti"), "level")
        reached = reached.unionByName(level)
    found = reached.join(b, "id", "left_semi").where("start <> id")
    return found.select("start", F.col("id").alias("end"), "path").orderBy(F.size("path"), "start", "end").limit(limit)
