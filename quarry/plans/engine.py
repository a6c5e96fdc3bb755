"""The engine: a catalog of tables, one graph and vector collections, and statements run against them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import graph_algorithms as A
from quarry.operators import relational as R
from quarry.operators import services as B
from quarry.operators import unified as U
from quarry.operators import vector_search as S
from quarry.operators.graph import Graph
from quarry.plans import patterns
from quarry.plans.parser import Statement, parse, split_script
from quarry.session import ship
from quarry.shared import settle, shared_dir
from quarry.sources.store import Checkpoints

NODES = "id long, labels array<string>"
EDGES = "id long, src long, dst long, type string, directed boolean"
LINKS = "src_key string, dst_key string, type string, directed boolean"
EMBEDDINGS = "key string, embedding array<float>, collection string"
CACHE = "key string, prompt string, response string, embedding array<float>, created_at timestamp, expires_at timestamp, hits long, last_hit timestamp, cost double"
ARTIFACTS = "id string, content_type string, created_by string, tags array<string>, links array<string>, chunks array<string>, size long"
CHUNKS = "hash string, data binary, size long"
MOST_NAME, CHUNK_BYTES, TTL_SECONDS = 255, 1 << 20, 86_400
#: Inserts after which a table's parts are written as one.
MOST_PARTS = 16


class CatalogError(ValueError):
    pass


#: What a transaction keeps to go back to; tables are immutable versions, so references are enough.
STATE = ("tables", "constraints", "indexes", "nodes", "edges", "links", "embeddings", "entities", "graph_constraints", "graph_indexes", "cache", "artifacts", "chunks", "collections", "vector_indexes", "secrets", "grants")
SECRETS = "key string, value string, version int"
GRANTS = "entity string, key string, level string"


class Engine:
    """Tables, constraints, graph and embeddings of one session; every change is a new version written once."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        ship(spark)
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.constraints: dict[str, list[tuple]] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}
        empty = lambda schema: spark.createDataFrame([], schema)
        self.nodes, self.edges, self.links, self.embeddings, self.entities = (empty(x) for x in (NODES, EDGES, LINKS, EMBEDDINGS, "key string"))
        self.checkpoints = Checkpoints(spark, root) if root else None
        self.graph_constraints: dict[str, tuple] = {}
        self.cache, self.artifacts, self.chunks = empty(CACHE), empty(ARTIFACTS), empty(CHUNKS)
        self.secrets, self.grants = empty(SECRETS), empty(GRANTS)
        self.collections: dict[str, tuple[int | None, str]] = {}
        self.vector_indexes: dict[str | None, tuple[DataFrame, S.StoredIndex]] = {}
        self.graph_indexes: list[str] = []
        self.parts: dict[str, int] = {}  # written since a table was last written as a whole
        self._before: dict[str, Any] | None = None

    # catalog

    def register(self, name: str, df: DataFrame) -> None:
        """Put a DataFrame into the catalog, in place of a table of that name."""
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def create_table(self, name: str, columns: list[tuple[str, str, bool]], constraints: list[tuple] = (), if_not_exists: bool = False) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise CatalogError(f"table {name} exists")
        if not name or len(name) > MOST_NAME:
            raise CatalogError("a table name has 1 to 255 characters")
        schema = ", ".join(f"`{c}` {kind}" for c, kind, _ in columns)
        self.register(name, self.spark.createDataFrame([], schema))
        self.constraints[name] = [*constraints, ("not_null", [c for c, _, nullable in columns if not nullable])]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name]

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise CatalogError(f"no table {name}")
        if self.tables.pop(name, None) is not None:
            self.spark.catalog.dropTempView(name)
        self.constraints.pop(name, None)
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}

    def add_constraint(self, table: str, constraint: tuple) -> None:
        """Checked on the rows that are there, then on every later write."""
        self._check(table, self.table(table), [constraint])
        self.constraints.setdefault(table, []).append(constraint)

    def drop_constraint(self, table: str, constraint: tuple) -> None:
        self.constraints[table].remove(constraint)

    def _check(self, table: str, df: DataFrame, constraints: list[tuple] | None = None) -> None:
        for kind, *rest in self.constraints.get(table, []) if constraints is None else constraints:
            if kind == "not_null":
                bad = R.violates_not_null(df, rest[0]) if rest[0] else None
            elif kind == "primary_key":
                bad = R.violates_primary_key(df, rest[0])
            elif kind == "unique":
                bad = R.violates_unique(df, rest[0])
            elif kind == "check":
                bad = df.where(f"NOT ({rest[0]})")
            elif kind == "foreign_key":
                bad = R.violates_foreign_key(df, self.table(rest[1]), list(zip(rest[0], rest[2], strict=True)))
            else:
                bad = None
            if bad is not None and not bad.isEmpty():
                raise CatalogError(f"{kind} constraint of {table} is violated")

    def _write(self, table: str, df: DataFrame) -> None:
        df = settle(df, table)
        self._check(table, df)
        self.register(table, df)

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    # running statements

    def execute(self, text: str) -> DataFrame:
        """Run one statement; changes return one row with the number of rows they touched."""
        return self.run(parse(text))

    def execute_all(self, script: str) -> list[DataFrame]:
        return [self.execute(s) for s in split_script(script)]

    def to_pandas(self, text: str):
        """One statement's rows on the driver."""
        return self.execute(text).toPandas()

    def cached(self, prompt: str, compute, ttl_seconds: int = TTL_SECONDS) -> str:
        """The cached response to prompt, or the one that compute(prompt) gives, which is cached."""
        found = self.execute_statement("cache_get", prompt=prompt).first()
        if found is not None:
            return found["response"]
        response = compute(prompt)
        self.execute_statement("cache_put", prompt=prompt, response=response)
        return response

    def execute_statement(self, kind: str, **args) -> DataFrame:
        return self.run(Statement(kind, args))

    # transactions: one at a time, over everything the engine holds

    def _begin(self) -> DataFrame:
        if self._before is not None:
            raise CatalogError("a transaction is open")
        self._before = {k: v.copy() if isinstance(v := getattr(self, k), (dict, list)) else v for k in STATE}
        return self._done()

    def _commit(self) -> DataFrame:
        if self._before is None:
            raise CatalogError("no transaction is open")
        self._before = None
        return self._done()

    def _undo(self) -> DataFrame:
        """ROLLBACK: every table, the graph and all else as they were at BEGIN."""
        if self._before is None:
            raise CatalogError("no transaction is open")
        before, self._before = self._before, None
        for name in set(self.tables) - set(before["tables"]):
            self.spark.catalog.dropTempView(name)
        for k, v in before.items():
            setattr(self, k, v)
        for name, df in self.tables.items():
            self.register(name, df)
        return self._done()

    def stream(self, text: str) -> Iterator[Row]:
        return self.execute(text).toLocalIterator(prefetchPartitions=True)

    def run(self, s: Statement) -> DataFrame:
        return getattr(self, f"_{s.kind}")(**{k if k not in ("from", "return", "type") else f"{k}_": v for k, v in s.args.items()})

    def _done(self, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    def _sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def _expr(self, where: str | None) -> Column:
        return F.lit(True) if where is None else F.expr(where)

    def _insert(self, table: str, columns: list[str] | None, rows: list[list[str]] | None = None, select: str | None = None) -> DataFrame:
        df = self.table(table)
        columns = columns or df.columns
        if select is not None:
            new = self.spark.sql(select).toDF(*columns)
        else:
            new = self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(r)})" for r in rows)).toDF(*columns)
        defaults = {c[1]: c[2] for c in self.constraints.get(table, []) if c[0] == "default"}
        kinds = dict(df.dtypes)
        new = new.select(*[(F.col(c) if c in columns else F.expr(defaults.get(c, "NULL"))).cast(kinds[c]).alias(c) for c in df.columns])
        new = settle(new, "new")
        self._append(table, new)
        return self._done(new.count())

    def _append(self, table: str, new: DataFrame) -> None:
        """Add rows as one more written part; only they, and the rows that share a unique key with them, are checked."""
        old = self.table(table)
        for c in self.constraints.get(table, []):
            if c[0] in ("primary_key", "unique"):
                keys = new.select(*c[1]).dropna().distinct()
                self._check(table, old.join(keys, c[1], "left_semi").select(*new.columns).unionByName(new), [c])
            else:
                self._check(table, new, [c])
        self.parts[table] = self.parts.get(table, 0) + 1
        both = old.unionByName(new)
        if self.parts[table] > MOST_PARTS:
            both, self.parts[table] = settle(both, table), 0
        self.register(table, both)

    def _update(self, table: str, changes: dict[str, str], where: str | None) -> DataFrame:
        df = self.table(table)
        n = df.where(self._expr(where)).count()
        kinds = dict(df.dtypes)
        self._write(table, R.update(df, self._expr(where), {c: F.expr(v).cast(kinds[c]) for c, v in changes.items()}))
        return self._done(n)

    def _delete(self, table: str, where: str | None) -> DataFrame:
        df = self.table(table)
        n = df.where(self._expr(where)).count()
        for child, constraints in self.constraints.items():
            for c in constraints:
                if c[0] == "foreign_key" and c[2] == table and child in self.tables:
                    _, kids = R.delete_referenced(df, self.tables[child], list(zip(c[1], c[3], strict=True)), self._expr(where), c[4])
                    self.register(child, settle(kids, child))
        self._write(table, R.delete(df, self._expr(where)))
        return self._done(n)

    def _create_table(self, table: str, columns: list, constraints: list, if_not_exists: bool) -> DataFrame:
        self.create_table(table, columns, constraints, if_not_exists)
        return self._done()

    def _create_index(self, name: str, table: str, columns: list[str], unique: bool) -> DataFrame:
        """Indexes are notes: scans prune by Parquet statistics. A unique one is a constraint."""
        if unique:
            self.add_constraint(table, ("unique", columns))
        self.indexes[name] = (table, columns)
        return self._done()

    def _drop_table(self, name: str, if_exists: bool) -> DataFrame:
        self.drop_table(name, if_exists)
        return self._done()

    def _drop_index(self, name: str, if_exists: bool) -> DataFrame:
        if self.indexes.pop(name, None) is None and not if_exists:
            raise CatalogError(f"no index {name}")
        return self._done()

    def _add_column(self, table: str, name: str, type_: str, nullable: bool = True, default: str | None = None) -> DataFrame:
        """A NOT NULL column without a default is refused where there are rows."""
        new = self.table(table).withColumn(name, F.expr(default or "NULL").cast(type_))
        if not nullable:
            self._check(table, new, [("not_null", [name])])
            self.constraints.setdefault(table, []).append(("not_null", [name]))
        if default is not None:
            self.constraints.setdefault(table, []).append(("default", name, default))
        self._write(table, new)
        return self._done()

    def _drop_column(self, table: str, name: str) -> DataFrame:
        if any(name in part for c in self.constraints.get(table, []) if c[0] != "check" for part in c[1:] if isinstance(part, list)):
            raise CatalogError(f"a constraint uses {name}")
        self._write(table, self.table(table).drop(name))
        return self._done()

    def _rename_column(self, table: str, old: str, new: str) -> DataFrame:
        swap = lambda part: [new if x == old else x for x in part] if isinstance(part, list) else part
        self.constraints[table] = [(c[0], *[swap(part) for part in c[1:]]) for c in self.constraints.get(table, [])]
        self._write(table, self.table(table).withColumnRenamed(old, new))
        return self._done()

    def _show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in sorted(self.tables)], "name string")

    def _describe(self, what: str, name: str) -> DataFrame:
        if what == "table":
            return self.spark.createDataFrame(self.table(name).dtypes, "column string, type string")
        df = self.graph.with_label(name) if what == "node" else self.edges.where(F.col("type") == name)
        own = [c for c in df.columns if c not in ("id", "labels", "src", "dst", "type", "directed")]
        used = df.agg(*[F.count(c).alias(c) for c in own]).first() if own else {}
        return self.spark.createDataFrame([(c, dict(df.dtypes)[c]) for c in own if used[c]], "column string, type string")

    # graph

    def _next(self, df: DataFrame) -> int:
        return (df.agg(F.max("id")).first()[0] or 0) + 1

    def _typed(self, base: dict[str, tuple[Any, str]], props: dict[str, Any]) -> DataFrame:
        kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
        every = base | {k: (v, kinds.get(type(v), "string")) for k, v in props.items()}
        return self.spark.createDataFrame([tuple(v for v, _ in every.values())], ", ".join(f"`{k}` {t}" for k, (_, t) in every.items()))

    def _node_create(self, label: str, props: dict) -> DataFrame:
        n = self._next(self.nodes)
        self._put_nodes(self._typed({"id": (n, "bigint"), "labels": ([label], "array<string>")}, props))
        return self.spark.createDataFrame([(n,)], "id long")

    def _node_get(self, id: Any) -> DataFrame:
        return self.graph.node(id)

    def _node_list(self, label: str | None, where: str | None, limit: int | None) -> DataFrame:
        df = self.graph.find_nodes(self._expr(where), label).orderBy("id")
        return df if limit is None else df.limit(limit)

    def _node_delete(self, id: Any) -> DataFrame:
        g = self.graph.delete_nodes(self.graph.node(id))
        self.nodes, self.edges = settle(g.nodes, "nodes"), settle(g.edges, "edges")
        return self._done(1)

    def _edge_create(self, src: Any, dst: Any, type_: str, props: dict) -> DataFrame:
        if self.nodes.where(F.col("id").isin(src, dst)).count() < len({src, dst}):
            raise CatalogError("an end of the edge does not exist")
        n = self._next(self.edges)
        new = self._typed({"id": (n, "bigint"), "src": (src, "bigint"), "dst": (dst, "bigint"), "type": (type_, "string"), "directed": (True, "boolean")}, props)
        self.edges = settle(self.edges.unionByName(new, allowMissingColumns=True), "edges")
        return self.spark.createDataFrame([(n,)], "id long")

    def _edge_get(self, id: Any) -> DataFrame:
        return self.graph.edge(id)

    def _edge_list(self, type_: str | None, where: str | None, limit: int | None) -> DataFrame:
        df = self.graph.find_edges(self._expr(where), type_).orderBy("id")
        return df if limit is None else df.limit(limit)

    def _edge_delete(self, id: Any) -> DataFrame:
        self.edges = settle(self.edges.where(F.col("id") != id), "edges")
        return self._done(1)

    def _pattern(self, clauses: list) -> DataFrame:
        return patterns.run(self, clauses)

    def _graph_pattern(self, verb: str, clauses: list) -> DataFrame:
        """Bindings of a pattern as ids, their number, or whether there is one."""
        named = dict(clauses)
        used = named.get("WHERE", "")
        bound = patterns.bindings(self.graph, named["MATCH"], used)
        if used:
            bound = bound.where(F.expr(patterns.sql_text(used)))
        if verb == "match":
            return bound.limit(int(named["LIMIT"])) if "LIMIT" in named else bound
        n = bound.count() if verb == "count" else int(not bound.isEmpty())
        return self.spark.createDataFrame([(n,)], "n long") if verb == "count" else self.spark.createDataFrame([(bool(n),)], "found boolean")

    def _neighbors(self, id: Any, direction: str, type_: str | None, similar: Any, limit: int | None) -> DataFrame:
        if similar is not None:
            return U.neighbours_by_similarity(self.embeddings, self.links, str(id), None if similar is True else similar, limit or 10)
        if isinstance(id, str):
            df = U.entity_neighbours(self.links, id, direction, type_).orderBy("key")
        else:
            df = self.graph.neighbours(id, direction, type_)
        return df if limit is None else df.limit(limit)

    def _path(self, how: str, from_: Any, to: Any, weight: str | None, hops: tuple[int, int], limit: int | None) -> DataFrame:
        g = self.graph
        if how == "weighted":
            return g.weighted_paths(from_, to, weight or "weight", most=limit or 1)
        if how == "all":
            return g.shortest_paths(from_, to, most=limit)
        if how == "variable":
            return g.simple_paths(from_, to, *hops, most=limit)
        return g.shortest_path(from_, to, limit)

    def _graph(self, algorithm: str, options: dict) -> DataFrame:
        g = self.graph
        unknown = set(options) - {"edge_type", "direction", "limit", "iterations", "tolerance", "damping", "sample", "weight", "resolution", "metric"}
        if unknown:
            raise CatalogError(f"unknown option {sorted(unknown)[0]}")
        if "edge_type" in options:
            g = Graph(g.nodes, g.edges.where(F.col("type") == options["edge_type"]))
        direction = str(options.get("direction", "")).lower()
        limit = options.get("limit")
        rounds = {"rounds": int(options["iterations"])} if "iterations" in options else {}
        tolerance = {"tolerance": float(options["tolerance"])} if "tolerance" in options else {}
        made = {
            "pagerank": lambda: A.pagerank(g, float(options.get("damping", 0.85)), direction=direction or "outgoing", **rounds, **tolerance),
            "betweenness": lambda: A.betweenness(g, direction or "both", options.get("sample")),
            "closeness": lambda: A.closeness(g, direction or "both", options.get("sample")),
            "eigenvector": lambda: A.eigenvector(g, **rounds, **tolerance),
            "louvain": lambda: A.louvain(g, options.get("weight"), float(options.get("resolution", 1.0))),
            "label_propagation": lambda: A.label_propagation(g, int(options.get("iterations", 10))),
            "components": lambda: A.connected_components(g), "triangles": lambda: A.triangle_counts(g), "kcore": lambda: A.core_numbers(g),
            "scc": lambda: A.strongly_connected(g), "mst": lambda: A.spanning_forest(g, options.get("weight")), "bridges": lambda: A.bridges(g),
            "articulation": lambda: A.articulation_points(g), "similarity": lambda: A.neighbour_similarity(g, options.get("metric", "jaccard")),
        }
        if algorithm not in made:
            raise CatalogError(f"unknown algorithm {algorithm}")
        out = made[algorithm]()
        if "score" in out.columns and "id" in out.columns:
            out = out.orderBy(F.col("score").desc(), "id")
        return out if limit is None else out.limit(int(limit))

    def _graph_index(self, verb: str, name: str) -> DataFrame:
        """Notes like those of table indexes: scans prune by Parquet statistics, nothing is laid out."""
        if verb == "show":
            return self.spark.createDataFrame([(x,) for x in self.graph_indexes], "name string")
        if verb == "drop":
            if name not in self.graph_indexes:
                raise CatalogError(f"no graph index {name}")
            self.graph_indexes = [x for x in self.graph_indexes if x != name]
        else:
            self.graph_indexes = [*self.graph_indexes, name]
        return self._done()

    def _aggregate(self, what: str, property: str, call: str, label: str | None, where: str | None) -> DataFrame:
        run = self.graph.node_aggregate if what == "node" else self.graph.edge_aggregate
        return run(property, [call], self._expr(where), label)

    # vectors

    def _collection(self, name: str | None) -> DataFrame:
        own = F.col("collection").isNull() if name is None else F.col("collection") == name
        return self.embeddings.where(own)

    def _embed_store(self, pairs: list, collection: str | None) -> DataFrame:
        dimension = self.collections.get(collection, (None, ""))[0]
        if dimension is not None and any(len(v) != dimension for _, v in pairs):
            raise CatalogError(f"vectors of {collection} have {dimension} dimensions")
        new = self.spark.createDataFrame([(k, [float(x) for x in v], collection) for k, v in pairs], EMBEDDINGS)
        kept = self.embeddings.join(new.select("key", "collection"), self.embeddings["key"].eqNullSafe(new["key"]) & self.embeddings["collection"].eqNullSafe(new["collection"]), "left_anti")
        self.embeddings = settle(kept.unionByName(new), "embeddings")
        return self._done(len(pairs))

    def _embed_get(self, key: str, collection: str | None) -> DataFrame:
        return self._collection(collection).where(F.col("key") == key)

    def _embed_delete(self, key: str, collection: str | None) -> DataFrame:
        gone = (F.col("key") == key) & F.col("collection").eqNullSafe(F.lit(collection))
        self.embeddings = settle(self.embeddings.where(~gone), "embeddings")
        return self._done(1)

    def _embed_clear(self, collection: str | None) -> DataFrame:
        n = self._collection(collection).count()
        own = F.col("collection").isNull() if collection is None else F.col("collection").eqNullSafe(F.lit(collection))
        self.embeddings = settle(self.embeddings.where(~own), "embeddings")
        return self._done(n)

    def _collection_create(self, name: str, dimension: int | None, metric: str) -> DataFrame:
        if name in self.collections:
            raise CatalogError(f"collection {name} exists")
        if {"dot": "dot_product"}.get(metric, metric) not in V.METRICS:
            raise CatalogError(f"unknown metric {metric}")
        self.collections[name] = (dimension, {"dot": "dot_product"}.get(metric, metric))
        return self._done()

    def _collection_drop(self, name: str) -> DataFrame:
        """The collection with its vectors."""
        if self.collections.pop(name, None) is None:
            raise CatalogError(f"no collection {name}")
        return self._embed_clear(name)

    def _show_collections(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *v) for k, v in sorted(self.collections.items())], "name string, dimension int, metric string")

    def _embed_build_index(self, collection: str | None = None) -> DataFrame:
        """Write the collection's vectors by list; SIMILAR reads only the lists it needs until the vectors change."""
        rows = self._collection(collection)
        index = S.build_index(rows, f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")
        self.vector_indexes[collection] = (self.embeddings, index)
        return self._done(rows.count())

    def _show_embeddings(self, limit: int | None) -> DataFrame:
        df = self.embeddings.select("key", "collection", F.size("embedding").alias("dimension")).orderBy("key")
        return df if limit is None else df.limit(limit)

    def _show_vector_index(self) -> DataFrame:
        return self.embeddings.groupBy("collection", F.size("embedding").alias("dimension")).agg(F.count(F.lit(1)).alias("vectors"))

    def _count_embeddings(self, collection: str | None) -> DataFrame:
        return self._collection(collection).agg(F.count(F.lit(1)).alias("n"))

    def _vector_of(self, query: Any, rows: DataFrame) -> list[float]:
        if isinstance(query, list):
            return query
        found = rows.where(F.col("key") == query).select("embedding").first()
        if found is None:
            raise CatalogError(f"no embedding for {query}")
        return list(found[0])

    def _similar(self, query: Any, connected_to: str | None, limit: int, metric: str, collection: str | None, where: str | None) -> DataFrame:
        rows = self._collection(collection)
        vector = self._vector_of(query, rows)
        if isinstance(query, str):
            rows = rows.where(F.col("key") != query)
        metric = {"dot": "dot_product"}.get(metric, metric) if metric else self.collections.get(collection, (None, "cosine"))[1]
        if connected_to is not None:
            return U.similar_connected(rows, self.links, vector, connected_to, limit, metric, self._expr(where)).select("key", "score")
        built = self.vector_indexes.get(collection)
        if built is not None and built[0] is self.embeddings and metric in ("cosine", "angular", "geodesic"):
            own = query if isinstance(query, str) else None
            return built[1].search(vector, limit, metric, self._expr(where), query_key=own).select("key", "score")
        return S.search(rows, vector, limit, metric, self._expr(where)).select("key", "score")

    # unified

    def _find(self, what: str, name: str | None, where: str | None, return_: list | None, limit: int | None, similar_to: Any, connected_to: str | None, from_: str | None = None, to: str | None = None) -> DataFrame:
        if similar_to is not None:
            return self._similar(similar_to, connected_to, limit or 10, "cosine", None, where)
        if connected_to is not None:
            return U.entity_neighbours(self.links, connected_to).orderBy("key").limit(limit or 100)
        if what == "path":
            return U.find_paths(self.graph, from_, to, name, limit or U.MOST_PATHS)
        if what == "rows":
            table = self.table(name)
            return U.find_rows(table, name, table.columns[0], self._expr(where), limit, return_)
        out = (U.find_nodes if what == "node" else U.find_edges)(self.graph, name, self._expr(where), limit)
        if return_:
            out = out.withColumn("data", F.map_filter("data", lambda k, _: k.isin(*return_)))
        return out

    def _entity_create(self, key: str, props: dict, embedding: list | None) -> DataFrame:
        kept = self.entities.where(F.col("key") != key)
        self.entities = settle(kept.unionByName(self._typed({"key": (key, "string")}, props), allowMissingColumns=True), "entities")
        if embedding is not None:
            self._embed_store([(key, embedding)], None)
        return self._done(1)

    def _entity_update(self, key: str, props: dict, embedding: list | None) -> DataFrame:
        known = [c for c in props if c in self.entities.columns]
        changed = R.update(self.entities, F.col("key") == key, {c: F.lit(props[c]) for c in known})
        for c in set(props) - set(known):
            changed = changed.withColumn(c, F.when(F.col("key") == key, F.lit(props[c])))
        self.entities = settle(changed, "entities")
        if embedding is not None:
            self._embed_store([(key, embedding)], None)
        return self._done(1)

    def _entity_get(self, key: str) -> DataFrame:
        return U.entity_view(self.entities.where(F.col("key") == key), self.links, self.embeddings)

    def _entity_delete(self, key: str) -> DataFrame:
        gone = self.spark.createDataFrame([(key,)], "key string")
        parts = U.delete_entities(gone, self.entities, self.links, self.embeddings)
        self.entities, self.links, self.embeddings = (settle(p, "entities") for p in parts)
        return self._done(1)

    def _entity_connect(self, src: str, dst: str, type_: str) -> DataFrame:
        self.links = settle(U.connect(self.links, self.spark.createDataFrame([(src, dst, type_, True)], LINKS)), "links")
        return self._done(1)

    # checkpoints

    def _versions(self) -> Checkpoints:
        if self.checkpoints is None:
            raise CatalogError("the engine has no folder for checkpoints")
        return self.checkpoints

    def _checkpoint(self, name: str | None) -> DataFrame:
        state = {f"table-{k}": v for k, v in self.tables.items()} | {"nodes": self.nodes, "edges": self.edges, "links": self.links, "embeddings": self.embeddings, "entities": self.entities}
        return self.spark.createDataFrame([(self._versions().create(state, name),)], "name string")

    def _rollback(self, name: str) -> DataFrame:
        state = self._versions().restore(name)
        for t in list(self.tables):
            if f"table-{t}" not in state:
                self.drop_table(t)
        for k, df in state.items():
            if m := re.fullmatch("table-(.*)", k):
                self.register(m[1], df)
            else:
                setattr(self, k, df)
        return self._done(len(state))

    def _checkpoints(self, limit: int | None) -> DataFrame:
        return self._versions().list(limit)

    # graph constraints and batches

    def _violations(self, g: Graph, rule: tuple) -> DataFrame:
        label, prop, kind, type_ = rule
        if prop not in g.nodes.columns:
            return (g.with_label(label) if label else g.nodes) if kind == "exists" else g.nodes.limit(0)
        return {"unique": lambda: g.violates_unique(prop, label), "exists": lambda: g.violates_exists(prop, label), "type": lambda: g.violates_type(prop, type_, label)}[kind]()

    def _put_nodes(self, rows: DataFrame) -> None:
        new = settle(self.nodes.unionByName(rows, allowMissingColumns=True), "nodes")
        for name, rule in self.graph_constraints.items():
            if not self._violations(Graph(new, self.edges), rule).isEmpty():
                raise CatalogError(f"graph constraint {name} is violated")
        self.nodes = new

    def _constraint_create(self, name: str, label: str | None, property: str, kind: str, type_: str | None) -> DataFrame:
        rule = (label, property, kind, type_)
        if not self._violations(self.graph, rule).isEmpty():
            raise CatalogError(f"graph constraint {name} is violated")
        self.graph_constraints[name] = rule
        return self._done()

    def _constraint_drop(self, name: str) -> DataFrame:
        if self.graph_constraints.pop(name, None) is None:
            raise CatalogError(f"no graph constraint {name}")
        return self._done()

    def _constraint_list(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *v) for k, v in self.graph_constraints.items()], "name string, label string, property string, kind string, type string")

    def _frame(self, base: dict[str, str], rows: list[tuple[dict, dict]]) -> DataFrame:
        """One frame of many rows of fixed columns and properties; a property's type is that of its values, mixed ones are text."""
        kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
        found: dict[str, set] = {}
        for _, props in rows:
            for k, v in props.items():
                if v is not None:
                    found.setdefault(k, set()).add(kinds.get(type(v), "string"))
        types = {k: next(iter(t)) if len(t) == 1 else "double" if t == {"bigint", "double"} else "string" for k, t in found.items()}
        cast = {"double": float, "string": str}
        values = [tuple(own[c] for c in base) + tuple(None if (v := props.get(k)) is None else cast.get(t, lambda x: x)(v) for k, t in types.items()) for own, props in rows]
        return self.spark.createDataFrame(values, ", ".join(f"`{k}` {t}" for k, t in (base | types).items()))

    def _batch_nodes(self, rows: list) -> DataFrame:
        n = self._next(self.nodes)
        if rows:
            self._put_nodes(self._frame({"id": "bigint", "labels": "array<string>"}, [({"id": n + k, "labels": [label]}, props) for k, (label, props) in enumerate(rows)]))
        return self._done(len(rows))

    def _batch_edges(self, rows: list) -> DataFrame:
        """Edges with a missing end are left out; the count tells how many were added."""
        n, before = self._next(self.edges), self.edges.count()
        if rows:
            own = [({"id": n + k, "src": a, "dst": b, "type": kind, "directed": True}, props) for k, (a, b, kind, props) in enumerate(rows)]
            made = self._frame({"id": "bigint", "src": "bigint", "dst": "bigint", "type": "string", "directed": "boolean"}, own)
            self.edges = settle(self.graph.add_edges(made).edges, "edges")
        return self._done(self.edges.count() - before)

    def _batch_update(self, rows: list) -> DataFrame:
        """Properties by node id; ids without a node are left out, and the count tells how many were changed."""
        if not rows:
            return self._done()
        new = self._frame({"_k": "bigint"}, [({"_k": int(i)}, props) for i, props in rows])
        given = self.spark.createDataFrame([(int(i), sorted(props)) for i, props in rows], "_i bigint, _given array<string>")
        props = [c for c in new.columns if c != "_k"]
        both = self.nodes.join(new.select("_k", *[F.col(c).alias(f"_new_{c}") for c in props]).join(given, F.col("_k") == F.col("_i")).drop("_i"), self.nodes["id"] == F.col("_k"), "left")
        for c in props:
            old = F.col(c) if c in self.nodes.columns else F.lit(None).cast(dict(new.dtypes)[c])
            both = both.withColumn(c, F.when(F.array_contains("_given", c), F.col(f"_new_{c}")).otherwise(old))
        both = settle(both, "updated")
        changed = both.where("_k is not null").count()
        self.nodes = self.nodes.limit(0)
        self._put_nodes(both.select(*[c for c in both.columns if not c.startswith("_")]))
        return self._done(changed)

    def _batch_delete(self, what: str, ids: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([(i,) for i in ids], "id long")
        before = getattr(self, what).count()
        g = self.graph.delete_nodes(rows) if what == "nodes" else Graph(self.nodes, self.edges.join(rows, "id", "left_anti"))
        self.nodes, self.edges = settle(g.nodes, "nodes"), settle(g.edges.select(*self.edges.columns), "edges")
        return self._done(before - getattr(self, what).count())

    # prompt cache

    def _cache_init(self) -> DataFrame:
        return self._done()

    def _cache_clear(self) -> DataFrame:
        n = self.cache.count()
        self.cache = self.spark.createDataFrame([], CACHE)
        return self._done(n)

    def _cache_put(self, prompt: str, response: str) -> DataFrame:
        return self._cache_semantic_put(prompt, response, None)

    def _cache_semantic_put(self, prompt: str, response: str, embedding: list | None) -> DataFrame:
        now = F.current_timestamp()
        row = self.spark.createDataFrame([(prompt, prompt, response, embedding)], "key string, prompt string, response string, embedding array<float>")
        row = row.withColumns({"created_at": now, "hits": F.lit(0).cast("long"), "last_hit": now, "cost": F.lit(0.0)})
        self.cache = settle(B.cache_put(self.cache, row, TTL_SECONDS, now), "cache")
        return self._done(1)

    def _cache_get(self, prompt: str) -> DataFrame:
        found = B.cache_live(self.cache, F.current_timestamp()).where(F.col("prompt") == prompt)
        hit = (F.col("prompt") == prompt)
        self.cache = settle(R.update(self.cache, hit, {"hits": F.col("hits") + 1, "last_hit": F.current_timestamp()}), "cache")
        return found.select("prompt", "response")

    def _cache_semantic_get(self, prompt: str, embedding: list, threshold: float = 0.9) -> DataFrame:
        return B.cache_get(self.cache, prompt, embedding, F.current_timestamp(), threshold).select("prompt", "response", "score", "layer")

    def _cache_evict(self, n: int) -> DataFrame:
        before = self.cache.count()
        self.cache = settle(B.cache_evict(self.cache, n, "hybrid", F.current_timestamp()), "cache")
        return self._done(before - self.cache.count())

    def _cache_stats(self) -> DataFrame:
        return self.cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))

    # blobs

    def _vault_set(self, key: str, value: str, known: bool = False) -> DataFrame:
        """Keep a value under a key, as it is (nothing is encrypted); ROTATE needs the key to be there and counts its versions up."""
        old = self.secrets.where(F.col("key") == key).first()
        if known and old is None:
            raise CatalogError(f"no secret {key}")
        row = self.spark.createDataFrame([(key, value, (old["version"] if old else 0) + 1)], SECRETS)
        self.secrets = settle(S.upsert(self.secrets, row), "secrets")
        return self._done(1)

    def _vault_get(self, key: str) -> DataFrame:
        return self.secrets.where(F.col("key") == key)

    def _vault_delete(self, key: str) -> DataFrame:
        n = self.secrets.where(F.col("key") == key).count()
        self.secrets = settle(self.secrets.where(F.col("key") != key), "secrets")
        self.grants = settle(self.grants.where(F.col("key") != key), "grants")
        return self._done(n)

    def _vault_list(self, pattern: str) -> DataFrame:
        return B.by_glob(self.secrets, "key", pattern).select("key", "version").orderBy("key")

    def _vault_grant(self, entity: str, key: str, level: str) -> DataFrame:
        if level not in ("read", "write", "admin"):
            raise CatalogError(f"unknown level {level}")
        row = self.spark.createDataFrame([(entity, key, level)], GRANTS)
        kept = self.grants.where(~((F.col("entity") == entity) & (F.col("key") == key)))
        self.grants = settle(kept.unionByName(row), "grants")
        return self._done(1)

    def _vault_revoke(self, entity: str, key: str) -> DataFrame:
        gone = (F.col("entity") == entity) & (F.col("key") == key)
        n = self.grants.where(gone).count()
        self.grants = settle(self.grants.where(~gone), "grants")
        return self._done(n)

    def _blob_init(self) -> DataFrame:
        return self._done()

    def _blob_put(self, name: str, data: str, content_type: str | None, tags: list, by: str | None, link: str | None) -> DataFrame:
        self.put_blob(name, data.encode(), content_type, tags, by, [link] if link else [])
        return self._done(1)

    def put_blob(self, name: str, data: bytes, content_type: str | None = None, tags: list | None = None, by: str | None = None, links: list | None = None) -> None:
        """Store bytes under a name, in chunks addressed by content; a chunk that is there isn't stored again."""
        file = self.spark.createDataFrame([(name, bytearray(data))], "id string, content binary")
        parts = settle(B.chunked(file, CHUNK_BYTES), "parts")
        hashes = [r["hash"] for r in parts.orderBy("seq").select("hash").collect()]
        new = parts.select("hash", "data", "size").dropDuplicates(["hash"]).join(self.chunks, "hash", "left_anti")
        self.chunks = settle(self.chunks.unionByName(new), "chunks")
        row = self.spark.createDataFrame([(name, content_type, by, tags or [], links or [], hashes, len(data))], ARTIFACTS)
        self.artifacts = settle(self.artifacts.where(F.col("id") != name).unionByName(row), "artifacts")

    def _blob_get(self, name: str) -> DataFrame:
        parts = self.artifacts.where(F.col("id") == name).select("id", F.posexplode("chunks").alias("seq", "hash")).join(self.chunks, "hash")
        return parts.select("id", "seq", "data").orderBy("seq")

    def _blob_info(self, name: str) -> DataFrame:
        return self.artifacts.where(F.col("id") == name)

    def _blob_delete(self, name: str) -> DataFrame:
        before = self.artifacts.count()
        self.artifacts = settle(self.artifacts.where(F.col("id") != name), "artifacts")
        return self._done(before - self.artifacts.count())

    def _blob_mark(self, verb: str, name: str, value: str) -> DataFrame:
        column = "links" if "link" in verb else "tags"
        new = F.array_remove(column, value) if verb.startswith("un") else F.array_union(column, F.array(F.lit(value)))
        self.artifacts = settle(R.update(self.artifacts, F.col("id") == name, {column: new}), "artifacts")
        return self._done(1)

    def _blob_verify(self, name: str) -> DataFrame:
        parts = self.artifacts.where(F.col("id") == name).select(F.explode("chunks").alias("hash")).join(self.chunks, "hash", "left")
        whole = F.coalesce(F.concat(F.lit("sha256:"), F.sha2("data", 256)) == F.col("hash"), F.lit(False))
        return parts.agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(~whole, 1)).alias("damaged"))

    def _blob_gc(self) -> DataFrame:
        before = self.chunks.count()
        self.chunks = settle(B.collect_garbage(self.artifacts, self.chunks), "chunks")
        return self._done(before - self.chunks.count())

    def _blob_repair(self) -> DataFrame:
        """Chunk references that are missing or damaged."""
        used = self.artifacts.select("id", F.explode("chunks").alias("hash"))
        bad = B.damaged_chunks(self.chunks).select("hash")
        return used.join(self.chunks.select("hash").join(bad, "hash", "left_anti"), "hash", "left_anti")

    def _blob_stats(self) -> DataFrame:
        used = self.artifacts.select("id", F.explode("chunks").alias("hash")).join(self.chunks.select("hash", "size"), "hash")
        return B.blob_stats(used)

    def _blobs(self, by: str, value: str) -> DataFrame:
        pick = {"link": B.linked_to, "tag": B.by_tag, "type": B.by_type}.get(by)
        found = pick(self.artifacts, value) if pick else B.by_glob(self.artifacts, "id", value)
        return found.select("id", "content_type", "size").orderBy("id")
