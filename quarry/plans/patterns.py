"""Pattern statements over the graph: MATCH, CREATE, MERGE, SET, DELETE and GRAPH PATTERN, run as joins and Spark SQL.

A binding is a row with a column per variable: a node or edge as a struct of its columns, a variable-length
step as the array of its nodes. WHERE, RETURN and ORDER BY are SQL over these columns, with SQL's rules for NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators.graph import BOTH, IN, OUT, EdgePattern, Graph, NodePattern, Pattern
from quarry.plans.parser import ParseError, Parser, Statement, tokenize
from quarry.shared import settle

if TYPE_CHECKING:
    from quarry.plans.engine import Engine

#: Hops of a step written * or *n.., where no upper bound is given.
DEFAULT_HOPS = 10
_CLAUSES = ("MATCH", "WHERE", "RETURN", "ORDER BY", "SKIP", "LIMIT", "ON CREATE SET", "ON MATCH SET", "SET", "CREATE", "MERGE", "DETACH DELETE", "DELETE")
_TEXT = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""
_PROPS = r"(?P<props>\{(?:[^{}'\"]|" + _TEXT + r")*\})?"
_NODE = re.compile(r"\s*\(\s*(?P<var>[A-Za-z_]\w*)?\s*(?P<labels>(?::\s*\w+\s*)*)" + _PROPS + r"\s*\)\s*")
_STEP = re.compile(
    r"\s*(?P<back><)?\s*-\s*(?:\[\s*(?P<var>[A-Za-z_]\w*)?\s*(?::\s*(?P<types>\w+(?:\s*\|\s*:?\s*\w+)*))?\s*(?P<many>\*\s*(?P<low>\d+)?\s*(?P<dots>\.\.)?\s*(?P<high>\d+)?)?\s*" + _PROPS + r"\s*\]\s*)?-\s*(?P<on>>)?\s*"
)
_AGGREGATE = re.compile(r"\b(count|sum|avg|min|max|collect|collect_list)\s*\(", re.I)


@dataclass(frozen=True)
class Node:
    var: str
    labels: tuple[str, ...]
    props: dict[str, Any]


@dataclass(frozen=True)
class Step:
    var: str | None
    types: tuple[str, ...]
    direction: str
    least: int
    most: int
    props: dict[str, Any]


def _clauses(text: str) -> list[tuple[str, str]]:
    """(clause, its text) in order; keywords count outside of brackets and quotes only."""
    depth, starts = 0, []
    tokens = tokenize(text)
    for i, (kind, word, at) in enumerate(tokens):
        depth += (word in "([{" and kind == "op") - (word in ")]}" and kind == "op")
        if depth or kind != "id" or (starts and at < starts[-1][2]):
            continue
        for name in _CLAUSES:
            n = len(name.split())
            if [t[1].upper() for t in tokens[i : i + n]] == name.split() and all(t[0] == "id" for t in tokens[i : i + n]):
                last = tokens[i + n - 1]
                starts.append((name, at, last[2] + len(last[1])))
                break
    ends = [s[1] for s in starts[1:]] + [len(text)]
    return [(name, text[begin:end].strip().rstrip(";").strip()) for (name, _, begin), end in zip(starts, ends, strict=True)]


def _props(text: str | None) -> dict[str, Any]:
    return Parser(text).properties() if text else {}


def _patterns(text: str) -> list[list]:
    """Comma-separated paths, each a list of Node, Step, Node, ..."""
    out, at, anonymous = [], 0, 0
    while at < len(text):
        path: list = []
        while True:
            m = _NODE.match(text, at)
            if not m:
                raise ParseError(f"expected a node at {text[at:at + 20]!r}")
            anonymous += 1
            path.append(Node(m["var"] or f"_a{anonymous}", tuple(re.findall(r"\w+", m["labels"])), _props(m["props"])))
            at = m.end()
            m = _STEP.match(text, at) if text[at : at + 1] in ("-", "<") else None
            if not m:
                break
            least, most = 1, 1
            if m["many"]:
                least = int(m["low"] or 1)
                most = int(m["high"]) if m["high"] else least if m["low"] and not m["dots"] else max(DEFAULT_HOPS, least)
            direction = IN if m["back"] and not m["on"] else OUT if m["on"] and not m["back"] else BOTH
            path.append(Step(m["var"], tuple(re.findall(r"\w+", m["types"] or "")), direction, least, most, _props(m["props"])))
            at = m.end()
        out.append(path)
        if at < len(text):
            if text[at] != ",":
                raise ParseError(f"unexpected {text[at:at + 20]!r}")
            at += 1
    return out


def parse_pattern(text: str) -> Statement:
    found = _clauses(text)
    if not found:
        raise ParseError("no pattern")
    return Statement("pattern", {"clauses": [(name, _patterns(body) if name in ("MATCH", "CREATE", "MERGE") else body) for name, body in found]})


def sql_text(text: str) -> str:
    """An expression of the pattern language as Spark SQL."""
    parts = re.split(f"({_TEXT})", text)
    parts = ["'" + p[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'") + "'" if p[:1] == '"' else p for p in parts]
    out = "".join(parts)
    quoted = r"('(?:[^'\\]|\\.|'')*')"
    for words, name in (("STARTS\\s+WITH", "startswith"), ("ENDS\\s+WITH", "endswith"), ("CONTAINS", "contains")):
        out = re.sub(rf"([\w.]+)\s+{words}\s+{quoted}", rf"{name}(\1, \2)", out, flags=re.I)
    out = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", out, flags=re.I)
    for name, column in (("id", "id"), ("labels", "labels"), ("type", "type")):
        out = re.sub(rf"\b{name}\s*\(\s*(\w+)\s*\)", rf"\1.{column}", out, flags=re.I)
    return re.sub(r"\bcollect\s*\(", "collect_list(", out, flags=re.I)


def _holds(props: dict[str, Any], columns: list[str]):
    cond = F.lit(True)
    for k, v in props.items():
        cond = cond & (F.col(k).eqNullSafe(F.lit(v)) if k in columns else F.lit(False))
    return cond


def bindings(g: Graph, paths: list[list], used: str) -> DataFrame:
    """One row for each way to bind the paths; variables that used doesn't name stay ids."""
    out, nodes, edges = None, set(), set()
    for path in paths:
        parts: list = []
        for p in path:
            if isinstance(p, Node):
                cond = _holds(p.props, g.nodes.columns)
                for label in p.labels[1:]:
                    cond = cond & F.array_contains("labels", label)
                parts.append(NodePattern(p.var, p.labels[0] if p.labels else None, cond))
                nodes.add(p.var)
            else:
                cond = _holds(p.props, g.edges.columns)
                cond = cond & F.col("type").isin(*p.types) if len(p.types) > 1 else cond
                parts.append(EdgePattern(p.var, p.types[0] if len(p.types) == 1 else None, p.direction, cond, p.least, p.most))
                if p.var and (p.least, p.most) == (1, 1):
                    edges.add(p.var)
        found = g.match(Pattern(parts[::2], parts[1::2]))
        shared = [] if out is None else [c for c in found.columns if c in out.columns]
        out = found if out is None else out.join(found, shared) if shared else R.join(out, found, how="cross")
    for var in sorted(nodes | edges):
        if re.search(rf"\b{var}\b", used):
            table = g.nodes if var in nodes else g.edges
            out = out.withColumnRenamed(var, "_k").join(table.select(F.col("id").alias("_k"), F.struct("*").alias(var)), "_k").drop("_k")
    return out.drop(*[c for c in out.columns if c.startswith("_a")])


def _returned(bound: DataFrame, clauses: dict[str, str]) -> DataFrame:
    items = sql_text(clauses["RETURN"])
    distinct = bool(re.match(r"DISTINCT\b", items, re.I))
    items = re.sub(r"^DISTINCT\b\s*", "", items, flags=re.I)
    if re.fullmatch(r"[A-Za-z_]\w*", items) and items in bound.columns and dict(bound.dtypes)[items].startswith("struct"):
        bound, items = bound.select("*", f"{items}.*"), f"{items}.*"
    name = "_bindings"
    text = f"SELECT {'DISTINCT ' if distinct else ''}{items} FROM {{{name}}}"
    if _AGGREGATE.search(items):
        text += " GROUP BY ALL"
    if "ORDER BY" in clauses:
        text += " ORDER BY " + sql_text(clauses["ORDER BY"])
    if "LIMIT" in clauses:
        text += f" LIMIT {int(clauses['LIMIT'])}"
    if "SKIP" in clauses:
        text += f" OFFSET {int(clauses['SKIP'])}"
    return bound.sparkSession.sql(text, **{name: bound})


def run(e: Engine, clauses: list[tuple[str, Any]]) -> DataFrame:
    """Result of a statement: RETURN's rows, (id) of what CREATE and MERGE made or matched, or the number of rows changed."""
    named = dict(clauses)
    used = " ".join(body for _, body in clauses if isinstance(body, str))
    if "MERGE" in named:
        return _merge(e, named, used)
    bound = None
    if "MATCH" in named:
        made = named.get("CREATE", [])
        used += " " + " ".join(p.var for path in made for p in path[::2])
        bound = bindings(e.graph, [p for name, body in clauses if name == "MATCH" for p in body], used)
        if "WHERE" in named:
            bound = bound.where(F.expr(sql_text(named["WHERE"])))
    if "CREATE" in named:
        return _create(e, named["CREATE"], bound)
    if bound is None:
        raise ParseError("nothing is matched")
    for verb in ("DETACH DELETE", "DELETE"):
        if verb in named:
            return _delete(e, bound, [v.strip() for v in named[verb].split(",")])
    if "SET" in named:
        return e._done(_set(e, bound, named["SET"]))
    if "RETURN" not in named:
        raise ParseError("RETURN, SET, CREATE or DELETE expected")
    return _returned(bound, named)


def _set(e: Engine, bound: DataFrame, text: str) -> int:
    """Give properties of bound nodes and edges values worked out in each binding, the largest where several bind one; how many changed."""
    bound, n = settle(bound, "bound"), 0
    for var, prop, value in re.findall(r"(\w+)\.(\w+)\s*=\s*((?:[^,'\"(]|" + _TEXT + r"|\([^)]*\))+)", text):
        table = "edges" if "src" in bound.schema[var].dataType.fieldNames() else "nodes"
        rows = getattr(e, table)
        new = bound.groupBy(F.col(f"{var}.id").alias("_k")).agg(F.max(F.expr(sql_text(value.strip()))).alias("_v"))
        kind = dict(rows.dtypes).get(prop, new.schema["_v"].dataType.simpleString())
        old = F.col(prop) if prop in rows.columns else F.lit(None)
        both = rows.join(new, rows["id"] == new["_k"], "left")
        changed = settle(both.withColumn(prop, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(old).cast(kind)).drop("_v"), table)
        n = max(n, changed.where("_k is not null").count())
        setattr(e, table, changed.drop("_k"))
    return n


def _delete(e: Engine, bound: DataFrame, variables: list[str]) -> DataFrame:
    """Bound edges go, and bound nodes with all their edges; the number of both."""
    bound, before = settle(bound, "bound"), e.nodes.count() + e.edges.count()
    for var in variables:
        ids = bound.select(F.col(f"{var}.id").alias("id")).distinct()
        if "src" in bound.schema[var].dataType.fieldNames():
            g = Graph(e.nodes, e.edges.join(ids, "id", "left_anti").select(*e.edges.columns))
        else:
            g = e.graph.delete_nodes(ids)
        e.nodes, e.edges = settle(g.nodes, "nodes"), settle(g.edges.select(*e.edges.columns), "edges")
    return e._done(before - e.nodes.count() - e.edges.count())


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _n from 0 up without gaps: places within partitions behind the sizes of the partitions before."""
    rows = settle(rows.withColumn("_m", F.monotonically_increasing_id()), "bound").withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_size")).select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(sizes), "_p").withColumn("_n", F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_base")


def _create(e: Engine, paths: list[list], bound: DataFrame | None) -> DataFrame:
    """Nodes and edges of the paths, once for every binding (or once); (id) of the new nodes, then of the new edges, each in order."""
    known = set() if bound is None else set(bound.columns)
    rows = _numbered(e.spark.range(1).drop("id") if bound is None else bound)
    fresh = list({p.var: p for path in paths for p in path[::2] if p.var not in known}.values())
    fresh = [max((p for path in paths for p in path[::2] if p.var == f.var), key=lambda p: len(p.labels) + len(p.props)) for f in fresh]
    first_node, first_edge = e._next(e.nodes), e._next(e.edges)
    at = {p.var: F.lit(first_node) + F.col("_n") * len(fresh) + k for k, p in enumerate(fresh)}
    ids = lambda var: at[var] if var in at else F.col(f"{var}.id")
    nodes = [rows.select(at[p.var].alias("id"), F.array(*[F.lit(x) for x in p.labels]).cast("array<string>").alias("labels"), *[F.lit(v).alias(k) for k, v in p.props.items()]) for p in fresh]
    steps = [(a, s, b) for path in paths for a, s, b in zip(path[::2], path[1::2], path[2::2], strict=False)]
    edges = []
    for k, (a, s, b) in enumerate(steps):
        if len(s.types) != 1 or s.direction == BOTH or (s.least, s.most) != (1, 1):
            raise ParseError("a new edge needs one type and a direction")
        a, b = (b, a) if s.direction == IN else (a, b)
        edges.append(rows.select((F.lit(first_edge) + F.col("_n") * len(steps) + k).alias("id"), ids(a.var).alias("src"), ids(b.var).alias("dst"), F.lit(s.types[0]).alias("type"), F.lit(True).alias("directed"), *[F.lit(v).alias(x) for x, v in s.props.items()]))
    made = []
    for new, put in ((nodes, e._put_nodes), (edges, None)):
        whole = None
        for n in new:
            whole = n if whole is None else whole.unionByName(n, allowMissingColumns=True)
        if whole is not None:
            whole = settle(whole, "made")
            made.append(whole.select(F.col("id").cast("long").alias("id")).orderBy("id"))  # files are read back in any order
            if put:
                put(whole)
            else:
                e.edges = settle(e.edges.unionByName(whole, allowMissingColumns=True), "edges")
    return made[0].unionByName(made[1]) if len(made) == 2 else made[0] if made else e.spark.createDataFrame([], "id long")


def _merge(e: Engine, named: dict[str, Any], used: str) -> DataFrame:
    """The nodes that bind the path, changed by ON MATCH SET; where none does, the path is made and changed by ON CREATE SET."""
    paths = named["MERGE"]
    variables = [p.var for path in paths for p in path[::2]]
    bound = settle(bindings(e.graph, [[replace(p) for p in path] for path in paths], used + " " + " ".join(variables)), "bound")
    text = named.get("ON MATCH SET")
    if bound.isEmpty():
        made = settle(_create(e, paths, None), "ids")
        text = named.get("ON CREATE SET")
        if text:
            new = made.withColumnRenamed("id", "_made")
            now = bindings(e.graph, paths, used + " " + " ".join(variables))
            for v in [v for v in variables if v in now.columns]:
                now = now.join(new, F.col(f"{v}.id") == F.col("_made"), "left_semi")
            _set(e, now, text)
        return made
    if text:
        _set(e, bound, text)
    out = None
    for v in [v for v in variables if v in bound.columns]:
        ids = bound.select(F.col(f"{v}.id").alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return (out if out is not None else e.spark.createDataFrame([], "id long")).distinct()
