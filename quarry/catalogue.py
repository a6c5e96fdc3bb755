"""Registered queries of the engine over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import encoding, geo, text
from quarry.functions import vectors as V
from quarry.operators import conditions as C
from quarry.operators import graph_algorithms as A
from quarry.operators import relational as R
from quarry.operators import partitioning, services, unified
from quarry.operators import vector_search as S
from quarry.operators.graph import BOTH, IN, OUT, EdgePattern, Graph, NodePattern, Pattern
from quarry.plans.engine import Engine
from quarry.shared import shared_dir
from quarry.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL where it can be expressed."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# relational

_SEGMENTS = """SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_totalprice > 100000 GROUP BY c_mktsegment HAVING COUNT(*) > 10 ORDER BY c_mktsegment"""


@query("select c_mktsegment, n, round(total, 2) as total from (" + _SEGMENTS + ")")
def rel_join_group_having(spark, d):
    e = Engine(spark)
    for t in ("customer", "orders"):
        e.register(t, table(spark, d, t))
    return rounded(e.execute(_SEGMENTS), "total", digits=2)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity >= 45 and l_discount < 0.03) or l_returnflag = 'R' and l_quantity <= 2")
def rel_filter_and_or(spark, d):
    cond = (C.ge("l_quantity", 45) & C.lt("l_discount", 0.03)) | (C.eq("l_returnflag", "R") & C.le("l_quantity", 2))
    return R.select(table(spark, d, "lineitem"), cond, ["l_orderkey", "l_linenumber", "l_quantity", "no_such_column"])


@query("select id, optional is not distinct from null as is_null, optional is distinct from 10 as not_ten, coalesce(optional > 50, false) as big from (select i as id, case when i % 3 = 0 then null else i * 10 end as optional from range(20) t(i))")
def rel_null_safe_filter(spark, d):
    df = spark.range(20).withColumn("optional", F.when(F.col("id") % 3 != 0, F.col("id") * 10))
    k = C.compile_condition
    return df.select("id", k(C.eq("optional", None)).alias("is_null"), k(C.ne("optional", 10)).alias("not_ten"), k(C.gt("optional", 50)).alias("big"))


_LIKE = """SELECT p_partkey, p_size FROM part WHERE p_name LIKE '%a%' AND p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 AND p_brand IS NOT NULL AND p_type NOT LIKE 'X%'"""


@query(_LIKE)
def rel_like_in_between(spark, d):
    e = Engine(spark)
    e.register("part", table(spark, d, "part"))
    return e.execute(_LIKE)


_CASE = """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS class,
CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS filled, CAST(o_totalprice AS BIGINT) % 7 + o_orderkey * 2 AS m FROM orders"""


@query(_CASE.replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"))
def rel_case_cast(spark, d):
    e = Engine(spark)
    e.register("orders", table(spark, d, "orders"))
    return e.execute(_CASE)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 10")
def rel_projection_topn_offset(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.page(df, [F.col("o_totalprice").desc(), "o_orderkey"], 10, 25)[0]


@query("select o_orderkey, o_custkey from orders where o_orderkey > 100 order by o_orderkey limit 50")
def rel_keyset_page(spark, d):
    return R.after_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


def _join(how: str, sql_how: str, extra: str = ""):
    name = f"rel_join_{how}"

    def run(spark, d):
        a = table(spark, d, "customer").select("c_custkey", "c_nationkey")
        b = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("o_nation"))
        out = R.join(a, b, [("c_custkey", "o_custkey"), ("c_nationkey", "o_nation")], how)  # orders of another nation stay unmatched
        return out.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in out.columns])

    run.__name__ = name
    columns = ", ".join(f"coalesce({c}, -1) as {c}" for c in ("c_custkey", "c_nationkey", "o_orderkey", "o_custkey", "o_nation"))
    sql = f"select {columns} from customer {sql_how} join (select *, (o_orderkey % 25)::int as o_nation from orders) on c_custkey is not distinct from o_custkey and c_nationkey is not distinct from o_nation"
    return query(sql)(run)


for _how, _sql in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "full")):
    _join(_how, _sql)


@query("select n_name, r_name from nation cross join region")
def rel_join_cross(spark, d):
    return R.join(table(spark, d, "nation"), table(spark, d, "region"), how="cross").select("n_name", "r_name")


@query("select regionkey, n_name, r_name from (select n_regionkey as regionkey, n_name from nation) natural join (select r_regionkey as regionkey, r_name from region)")
def rel_join_natural(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("regionkey"), "n_name")
    return R.join(n, table(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"), how="natural").select("regionkey", "n_name", "r_name")


_EXISTS = "SELECT c_custkey FROM customer WHERE {} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)"


@query(_EXISTS.format(""))
def rel_semi_exists(spark, d):
    e = Engine(spark)
    e.register("customer", table(spark, d, "customer"))
    e.register("orders", table(spark, d, "orders"))
    return e.execute(_EXISTS.format(""))


@query(_EXISTS.format("NOT"))
def rel_anti_not_exists(spark, d):
    e = Engine(spark)
    e.register("customer", table(spark, d, "customer"))
    e.register("orders", table(spark, d, "orders"))
    return e.execute(_EXISTS.format("NOT"))


_SCALAR = "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier)"


@query(_SCALAR)
def rel_scalar_subquery(spark, d):
    e = Engine(spark)
    e.register("supplier", table(spark, d, "supplier"))
    return e.execute(_SCALAR)


_DERIVED = "SELECT t.k, COUNT(DISTINCT t.p) AS parts FROM (SELECT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_tax >= 0.04) t GROUP BY t.k"


@query(_DERIVED)
def rel_derived_distinct(spark, d):
    e = Engine(spark)
    e.register("lineitem", table(spark, d, "lineitem"))
    return e.execute(_DERIVED)


@query("select l_returnflag, l_linestatus, count(*) as count_all, round(sum(l_quantity), 2) as sum_l_quantity, round(avg(l_discount), 6) as avg_l_discount, min(l_tax) as min_l_tax, max(l_extendedprice) as max_l_extendedprice from lineitem where l_quantity > 5 group by all having count(*) > 10")
def rel_group_having(spark, d):
    calls = [("count_all", None), ("sum", "l_quantity"), ("avg", "l_discount"), ("min", "l_tax"), ("max", "l_extendedprice")]
    out = R.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], calls, C.gt("l_quantity", 5), C.gt("count_all", 10), ordered=False)
    return rounded(rounded(out, "sum_l_quantity", digits=2), "avg_l_discount")


@query("select 7 as count_all, 0 as count_x, 0.0::double as sum_x, true as no_avg, true as no_min, true as no_max")
def rel_sum_empty_zero(spark, d):
    df = spark.range(7).select(F.lit(None).cast("long").alias("x"))
    out = R.aggregate(df, [("count_all", None), ("count", "x"), ("sum", "x"), ("avg", "x"), ("min", "x"), ("max", "x")])
    return out.select("count_all", "count_x", "sum_x", *[F.col(f"{c}_x").isNull().alias(f"no_{c}") for c in ("avg", "min", "max")])


@query("select o_orderkey, o_custkey, o_orderstatus from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as r from orders) where r = 1")
def rel_distinct_first_row(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.distinct_first(df, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1")
def rel_constraint_unique(spark, d):
    return R.violates_unique(table(spark, d, "orders"), ["o_custkey"])


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def rel_constraint_foreign_key(spark, d):
    parents = table(spark, d, "customer").where("c_nationkey < 20")
    return R.violates_foreign_key(table(spark, d, "orders"), parents, [("o_custkey", "c_custkey")]).select("o_orderkey")


@query("select p_partkey, case when p_size > 40 then 40 else p_size end as p_size, case when p_size > 40 then 'capped' else p_brand end as p_brand from part")
def rel_copy_on_write_update(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return R.update(df, C.gt("p_size", 40), {"p_size": F.lit(40), "p_brand": F.lit("capped")})


@query("select p_partkey from part where not (p_size < 10 or p_retailprice > 1800)")
def rel_copy_on_write_delete(spark, d):
    return R.delete(table(spark, d, "part"), C.lt("p_size", 10) | C.gt("p_retailprice", 1800.0)).select("p_partkey")


@query("select n_nationkey as k from nation union all select r_regionkey from region")
def rel_union(spark, d):
    return R.union(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@query("(select s_nationkey as k from supplier intersect select c_nationkey from customer) except select r_regionkey from region")
def rel_intersect_except(spark, d):
    a, b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return R.except_(R.intersect(a, b), table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


# graph: suppliers that both delivered large lines of one order

_EDGES = "select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_suppkey < b.l_suppkey and a.l_quantity >= {q} and b.l_quantity >= {q}"
_E = f"e as ({_EDGES.format(q=49)}), u as (select src, dst from e union select dst, src from e), deg as (select src as id, count(*) as d from u group by src)"


def supplier_graph(spark: SparkSession, d: str, q: int = 49, directed: bool = False) -> Graph:
    line = table(spark, d, "lineitem").where(F.col("l_quantity") >= q)
    a, b = line.select("l_orderkey", F.col("l_suppkey").alias("src")), line.select("l_orderkey", F.col("l_suppkey").alias("dst"))
    edges = a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()
    edges = edges.select((F.col("src") * 1_000_000 + F.col("dst")).alias("id"), "src", "dst", F.lit("with").alias("type"), F.lit(directed).alias("directed"), ((F.col("src") + F.col("dst")) % 7 + 1).cast("double").alias("weight"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("supplier"), F.concat(F.lit("n"), "s_nationkey")).alias("labels"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    return Graph(nodes, edges)


@query(f"with {_E} select id, d as degree from deg")
def graph_degree(spark, d):
    return supplier_graph(spark, d).degrees(BOTH)


@query(f"with {_E} select dst as id, count(*) as degree from e group by dst")
def graph_in_degree(spark, d):
    return supplier_graph(spark, d, directed=True).degrees(IN)


@query(f"with {_E}, s as (select min(src) as s from e) select distinct dst as id from u, s where src = s")
def graph_neighbors(spark, d):
    g = supplier_graph(spark, d)
    start = g.edges.agg(F.min("src")).first()[0]
    return g.neighbours(start).select("id")


@query("select sum(s_acctbal) is not null as has_sum, count(s_acctbal) as count_balance, round(avg(s_acctbal), 6) as avg_balance, min(s_acctbal) as min_balance, max(s_acctbal) as max_balance from supplier where s_nationkey = 7")
def graph_property_agg(spark, d):
    out = supplier_graph(spark, d).node_aggregate("balance", ["sum", "count", "avg", "min", "max"], label="n7")
    return rounded(out.select(F.col("sum_balance").isNotNull().alias("has_sum"), "count_balance", "avg_balance", "min_balance", "max_balance"), "avg_balance")


@query(f"with {_E} select count(*) as count_weight, round(sum((src + dst) % 7 + 1), 6)::double as sum_weight from e where (src + dst) % 7 + 1 > 2")
def graph_edge_agg(spark, d):
    return supplier_graph(spark, d).edge_aggregate("weight", ["count", "sum"], C.gt("weight", 2.0), "with")


@query("select label, count(*) as n from (select unnest(['supplier', 'n' || s_nationkey]) as label from supplier) group by label")
def graph_labels(spark, d):
    return supplier_graph(spark, d).labels()


@query(f"with {_E} select a.src as a, a.dst as b, b.dst as c from u a join u b on a.dst = b.src")
def graph_two_hop_pattern(spark, d):
    g = supplier_graph(spark, d)
    return g.match(Pattern([NodePattern("a"), NodePattern("b"), NodePattern("c")], [EdgePattern(), EdgePattern()]), None)


@query(f"with {_E} select a.src as a, b.dst as b, [a.src, a.dst, b.dst] as p from u a join u b on a.dst = b.src where a.src <> b.dst union all select src, dst, [src, dst] from u")
def graph_variable_length(spark, d):
    g = supplier_graph(spark, d)
    return g.match(Pattern([NodePattern("a"), NodePattern("b")], [EdgePattern("p", least=1, most=2)]), None)


_BFS = f"""with recursive {_E}, s as (select min(src) as s from e),
r as (select s as id, 0 as depth from s union select u.dst, depth + 1 from r join u on u.src = r.id where depth < 4)
select id, min(depth) as depth from r group by id"""


@query(_BFS)
def graph_bfs_distance(spark, d):
    g = supplier_graph(spark, d)
    start = g.edges.agg(F.min("src")).first()[0]
    return g.distances([start], BOTH, 4).select("id", "depth")


def _weighted_sql(rounds: int) -> str:
    parts = [_E, "w as materialized (select src, dst, ((src + dst) % 7 + 1)::double as w from u)", "d0 as materialized (select min(src) as id, 0.0::double as distance from e)"]
    for k in range(rounds):
        parts.append(f"d{k + 1} as materialized (select id, min(distance) as distance from (select * from d{k} union all select w.dst, d{k}.distance + w.w from d{k} join w on w.src = d{k}.id) group by id)")
    return "with " + ", ".join(parts) + f" select id, distance from d{rounds}"


@query(_weighted_sql(40))
def graph_weighted_distance(spark, d):
    g = supplier_graph(spark, d)
    start = g.edges.agg(F.min("src")).first()[0]
    return g.weighted_distances(start).select("id", "distance")


def _pagerank_sql(rounds: int) -> str:
    parts = [_E, "n as (select count(*) as n from supplier)", "p0 as (select s_suppkey as id, 1.0 / n as score from supplier, n)"]
    for k in range(rounds):
        parts.append(
            f"p{k + 1} as (select p.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + lost / n) as score from p{k} p cross join n cross join (select coalesce(sum(score), 0) as lost from p{k} where id not in (select id from deg)) "
            f"left join (select u.dst as id, sum(q.score / deg.d) as got from u join p{k} q on q.id = u.src join deg on deg.id = u.src group by u.dst) g on g.id = p.id)"
        )
    return "with " + ", ".join(parts) + f" select id, round(score, 8) as score from p{rounds}"


@query(_pagerank_sql(8))
def graph_pagerank(spark, d):
    return rounded(A.pagerank(supplier_graph(spark, d), tolerance=0, rounds=8), "score", digits=8)


@query(f"""with recursive {_E}, r as (select s_suppkey as id, s_suppkey as root from supplier union select u.dst, r.root from r join u on u.src = r.id)
select id, min(root) as component from r group by id""")
def graph_components(spark, d):
    return A.connected_components(supplier_graph(spark, d))


_TRI = "t as (select x.src as a, x.dst as b, y.dst as c from e x join e y on x.dst = y.src join e z on z.src = x.src and z.dst = y.dst)"


@query(f"with e as ({_EDGES.format(q=47)}), {_TRI} select a, b, c from t")
def graph_triangles(spark, d):
    return A.triangles(supplier_graph(spark, d, 47))


@query(f"""with e as ({_EDGES.format(q=47)}), {_TRI}, u as (select src, dst from e union select dst, src from e), deg as (select src as id, count(*) as d from u group by src),
k as (select id, count(*) as n from (select unnest([a, b, c]) as id from t) group by id)
select s_suppkey as id, coalesce(n, 0) as triangles, round(case when d > 1 then coalesce(n, 0) / (d * (d - 1) / 2) else 0 end, 6) as coefficient from supplier left join k on k.id = s_suppkey left join deg on deg.id = s_suppkey""")
def graph_clustering(spark, d):
    return rounded(A.clustering(supplier_graph(spark, d, 47)), "coefficient")


def _similarity(metric: str, sql: str):
    name = f"graph_{metric}"

    def run(spark, d):
        return rounded(A.neighbour_similarity(supplier_graph(spark, d), metric), "score")

    run.__name__ = name
    query(
        f"with {_E} select x.dst as a, y.dst as b, round({sql}, 6)::double as score from u x join u y on x.src = y.src and x.dst < y.dst join deg h on h.id = x.src "
        f"join deg da on da.id = x.dst join deg db on db.id = y.dst group by x.dst, y.dst, da.d, db.d having {sql} > 0"
    )(run)


for _m, _s in (
    ("jaccard", "count(*) / (da.d + db.d - count(*))"), ("cosine", "count(*) / sqrt(da.d * db.d)"), ("common", "count(*)"),
    ("adamic_adar", "coalesce(sum(case when h.d > 1 then 1 / ln(h.d) end), 0)"), ("resource_allocation", "sum(1 / h.d)"), ("preferential_attachment", "(da.d * db.d)"),
):
    _similarity(_m, _s)


@query(f"""with recursive {_E}, r as (select id as source, id, 0 as depth from deg union select r.source, u.dst, depth + 1 from r join u on u.src = r.id where depth < 3),
m as (select source, id, min(depth) as depth from r group by all)
select source as id, count(*) as reached, round(sum(case when depth > 0 then 1 / depth else 0 end), 6) as harmonic from m group by source""")
def graph_harmonic_within_3(spark, d):
    g = supplier_graph(spark, d)
    out = g.distances(g.degrees().select("id"), BOTH, 3).groupBy(F.col("source").alias("id"))
    return rounded(out.agg(F.count(F.lit(1)).alias("reached"), F.sum(F.when(F.col("depth") > 0, 1 / F.col("depth")).otherwise(0.0)).alias("harmonic")), "harmonic")


#: Distances between all suppliers, by breadth first up to 24 steps; more than the graph's diameter.
_FAR = """r as (select s_suppkey as source, s_suppkey as id, 0 as depth from supplier union select r.source, u.dst, depth + 1 from r join u on u.src = r.id where depth < 24),
far as materialized (select source, id, min(depth) as depth from r group by all)"""


@query(f"""with recursive {_E}, {_FAR}, n as (select count(*) as n from supplier)
select source as id, round(coalesce(sum(case when depth > 0 then 1 / depth end), 0) / greatest(1, max(n) - 1), 8) as score from far, n group by source""")
def graph_closeness(spark, d):
    return rounded(A.closeness(supplier_graph(spark, d)), "score", digits=8)


def _betweenness_sql(levels: int) -> str:
    parts = [_E, _FAR, "s0 as materialized (select source, id, 1.0::double as n from far where depth = 0)"]
    for k in range(1, levels + 1):
        parts.append(f"s{k} as materialized (select p.source, u.dst as id, sum(p.n) as n from s{k - 1} p join u on u.src = p.id join far f on f.source = p.source and f.id = u.dst and f.depth = {k} group by all)")
    parts.append("sigma as materialized (select f.source, f.id, f.depth, n from far f join (" + " union all ".join(f"select * from s{k}" for k in range(levels + 1)) + ") s on s.source = f.source and s.id = f.id)")
    # paths from s to t through v: those from s to v times those from v to t, where the distances add up
    parts.append("b as (select sv.id, sum(sv.n * vt.n / st.n) as twice from sigma sv join sigma vt on vt.source = sv.id and sv.depth > 0 and vt.depth > 0 join sigma st on st.source = sv.source and st.id = vt.id and st.depth = sv.depth + vt.depth group by sv.id)")
    return "with recursive " + ", ".join(parts) + " select s_suppkey as id, round(coalesce(twice / 2, 0), 6) as score from supplier left join b on b.id = s_suppkey"


@query(_betweenness_sql(24))
def graph_betweenness(spark, d):
    return rounded(A.betweenness(supplier_graph(spark, d)), "score")


def _eigenvector_sql(rounds: int) -> str:
    parts = [_E, "v0 as (select s_suppkey as id, 1.0::double / count(*) over () as score from supplier)"]
    for k in range(rounds):
        parts.append(f"g{k} as materialized (select v.id, coalesce(g.got, 0) as raw from v{k} v left join (select u.dst as id, sum(q.score) as got from u join v{k} q on q.id = u.src group by u.dst) g on g.id = v.id)")
        parts.append(f"v{k + 1} as materialized (select id, raw / (select sqrt(sum(raw * raw)) from g{k}) as score from g{k})")
    return "with " + ", ".join(parts) + f" select id, round(score, 8) as score from v{rounds}"


@query(_eigenvector_sql(40))
def graph_eigenvector(spark, d):
    return rounded(A.eigenvector(supplier_graph(spark, d), tolerance=0, rounds=40), "score", digits=8)


@query()
def graph_label_propagation(spark, d):
    return A.label_propagation(supplier_graph(spark, d), 6)


@query()
def graph_louvain(spark, d):
    return A.louvain(supplier_graph(spark, d), "weight")


def _cores_sql(rounds: int) -> str:
    """Core numbers are where h-indices of the neighbours' numbers settle, from the degrees down."""
    parts = [_E, "c0 as (select s_suppkey as id, coalesce(d, 0) as core from supplier left join deg on deg.id = s_suppkey)"]
    for k in range(rounds):
        ranked = f"select u.src as id, least(q.core, row_number() over (partition by u.src order by q.core desc)) as h from u join c{k} q on q.id = u.dst"
        parts.append(f"c{k + 1} as materialized (select c.id, coalesce(max(h), 0) as core from c{k} c left join ({ranked}) r on r.id = c.id group by c.id)")
    return "with " + ", ".join(parts) + f" select id, core::int as core from c{rounds}"


@query(_cores_sql(20))
def graph_core_numbers(spark, d):
    return A.core_numbers(supplier_graph(spark, d))


@query()
def graph_spanning_forest(spark, d):
    return A.spanning_forest(supplier_graph(spark, d))


def _around(spark, d) -> Graph:
    """The directed supplier graph with every third link turned round, so that it has cycles."""
    g = supplier_graph(spark, d, directed=True)
    back = (F.col("src") + F.col("dst")) % 3 == 0
    turned = g.edges.withColumns({"src": F.when(back, F.col("dst")).otherwise(F.col("src")), "dst": F.when(back, F.col("src")).otherwise(F.col("dst"))})
    return Graph(g.nodes, turned)


@query(f"""with recursive {_E}, a as (select case when (src + dst) % 3 = 0 then dst else src end as src, case when (src + dst) % 3 = 0 then src else dst end as dst from e),
r as (select s_suppkey as source, s_suppkey as id from supplier union select r.source, a.dst from r join a on a.src = r.id)
select x.source as id, min(x.id) as component from r x join r y on y.source = x.id and y.id = x.source group by x.source""")
def graph_strongly_connected(spark, d):
    return A.strongly_connected(_around(spark, d))


@query(f"""with recursive {_E}, w as (select src, dst, (src + dst) % 7 + 1 as w from e), cut as (select unnest(range(0, 8)) as c),
r as (select c, s_suppkey as id, s_suppkey as root from supplier, cut union select r.c, u.dst, r.root from r join u on u.src = r.id where (u.src + u.dst) % 7 + 1 <= r.c),
parts as (select c, count(distinct root) as n from (select c, id, min(root) as root from r group by all) group by c)
select (select count(*) from supplier) - (select n from parts where c = 7) as links, sum(a.c * (b.n - a.n))::double as total, (select n from parts where c = 7) as trees
from parts a join parts b on b.c = a.c - 1""")
def graph_spanning_forest_total(spark, d):
    g = supplier_graph(spark, d)
    forest = A.spanning_forest(g).agg(F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    return forest.withColumn("trees", F.lit(g.nodes.count()).cast("long") - F.col("links"))


@query(f"""with recursive {_E}, r as (select v.s_suppkey as cut, s.s_suppkey as id, s.s_suppkey as root from supplier v, supplier s where v.s_suppkey <> s.s_suppkey
  union select r.cut, u.dst, r.root from r join u on u.src = r.id where u.dst <> r.cut),
whole as (select s_suppkey as id, s_suppkey as root from supplier union select u.dst, w.root from whole w join u on u.src = w.id),
n as (select count(distinct root) as n from (select id, min(root) as root from whole group by id)),
c as (select cut, count(distinct root) as parts from (select cut, id, min(root) as root from r group by all) group by cut)
select cut as id from c, n where parts > n""")
def graph_articulation(spark, d):
    return A.biconnected(supplier_graph(spark, d)).where("kind = 'articulation'").select(F.col("a").alias("id"))


@query()
def graph_biconnected(spark, d):
    return A.biconnected(supplier_graph(spark, d))


# pattern statements over the supplier graph


def _pattern_engine(spark, d) -> Engine:
    e = Engine(spark)
    g = supplier_graph(spark, d)
    e.nodes, e.edges = g.nodes, g.edges
    return e


_S = "join supplier {0} on {0}.s_suppkey"


def _pattern_query(name: str, statement: str, sql: str):
    def run(spark, d):
        return _pattern_engine(spark, d).execute(statement)

    run.__name__ = name
    query(f"with {_E} {sql}")(run)


_pattern_query(
    "pattern_where", "MATCH (a:supplier)-[r:with]-(b:supplier) WHERE a.balance > 0 AND (b.s_nationkey = a.s_nationkey OR r.weight >= 6) RETURN a.id AS a, b.id AS b, r.weight AS weight",
    f"select u.src as a, u.dst as b, ((u.src + u.dst) % 7 + 1)::double as weight from u {_S.format('a')} = u.src {_S.format('b')} = u.dst where a.s_acctbal > 0 and (a.s_nationkey = b.s_nationkey or (u.src + u.dst) % 7 + 1 >= 6)",
)
_pattern_query(
    "pattern_grouped", "MATCH (a)-[:with]-(b) RETURN b.s_nationkey AS nation, count(*) AS n, max(a.balance) AS best",
    f"select b.s_nationkey as nation, count(*) as n, max(a.s_acctbal) as best from u {_S.format('a')} = u.src {_S.format('b')} = u.dst group by 1",
)
_pattern_query("pattern_ordered", "MATCH (a)-[:with]-(b) RETURN a.id AS id, count(*) AS n ORDER BY n DESC, id SKIP 3 LIMIT 10", "select id, d as n from deg order by d desc, id limit 10 offset 3")
_pattern_query(
    "pattern_distinct", "MATCH (a {s_nationkey: 7})-[:with]-(b)-[:with]->(c) RETURN DISTINCT c.id AS id",
    f"select distinct y.dst as id from u x {_S.format('a')} = x.src join u y on y.src = x.dst where a.s_nationkey = 7",
)
_pattern_query(
    "pattern_two_paths", "MATCH (a)-[:with]-(b), (b)-[:with]-(c:n7) WHERE a.id < c.id AND NOT a.s_nationkey IN [7, 8] RETURN a.id AS a, c.id AS c, count(*) AS n",
    f"select x.src as a, y.dst as c, count(*) as n from u x join u y on y.src = x.dst {_S.format('a')} = x.src {_S.format('c')} = y.dst where c.s_nationkey = 7 and a.s_nationkey not in (7, 8) and x.src < y.dst group by all",
)
_pattern_query("pattern_variable", "MATCH (a:n7)-[:with*1..2]-(b) RETURN DISTINCT a.id AS a, b.id AS b", f"select distinct src as a, dst as b from (select src, dst from u union select x.src, y.dst from u x join u y on y.src = x.dst where x.src <> y.dst) p {_S.format('a')} = p.src where a.s_nationkey = 7")
_pattern_query("pattern_count", "GRAPH PATTERN COUNT (a)-[:with]-(b)-[:with]-(c)", "select count(*) as n from u x join u y on y.src = x.dst")


@query("select s_suppkey as id, case when s_nationkey = 7 and s_acctbal > 0 then s_acctbal * 2 end as flag, s_acctbal as balance from supplier")
def pattern_set(spark, d):
    e = _pattern_engine(spark, d)
    e.execute("MATCH (a:n7) WHERE a.balance > 0 SET a.flag = a.balance * 2")
    return e.nodes.select("id", "flag", "balance")


@query(f"with {_E}, gone as (select s_suppkey as id from supplier where s_nationkey = 7) select src, dst from e where src not in (select id from gone) and dst not in (select id from gone)")
def pattern_delete(spark, d):
    e = _pattern_engine(spark, d)
    e.execute("MATCH (a:n7) DETACH DELETE a")
    return e.edges.select("src", "dst")


# vectors: the query is the vector of row 1

_Q = "(select embedding from embeddings where vec_id = 1)"


def _vec(spark, d):
    rows = table(spark, d, "embeddings")
    q = list(rows.where("vec_id = 1").first()["embedding"])
    return rows, q


def _vector_query(name: str, metric: str, sql: str):
    def run(spark, d):
        rows, q = _vec(spark, d)
        return rounded(S.search(rows, q, 20, metric, key="vec_id").select("vec_id", "score"), "score")

    run.__name__ = name
    query(f"select vec_id, round({sql}, 6) as score from (select vec_id, embedding::double[] as v, {_Q}::double[] as q from embeddings) order by {sql} desc, vec_id limit 20")(run)


_COS = "list_cosine_similarity(v, q)"
_JAC = "(len(list_filter(list_transform(range(len(v)), lambda i: v[i + 1] <> 0 and q[i + 1] <> 0), lambda x: x)) / len(list_filter(list_transform(range(len(v)), lambda i: v[i + 1] <> 0 or q[i + 1] <> 0), lambda x: x)))"
_DIST = "list_distance(v, q)"
_MAN = "list_sum(list_transform(range(len(v)), lambda i: abs(v[i + 1] - q[i + 1])))"
for _n, _metric, _s in (
    ("vec_topk_cosine", "cosine", _COS), ("vec_topk_dot", "dot_product", "list_inner_product(v, q)"), ("vec_topk_euclidean", "euclidean", f"1 / (1 + {_DIST})"),
    ("vec_angular", "angular", f"(1 - acos(least(1, greatest(-1, {_COS}))) / pi())"), ("vec_manhattan", "manhattan", f"1 / (1 + {_MAN})"), ("vec_jaccard", "jaccard", _JAC),
    ("vec_weighted_jaccard", "weighted_jaccard", "(list_sum(list_transform(range(len(v)), lambda i: least(abs(v[i + 1]), abs(q[i + 1])))) / list_sum(list_transform(range(len(v)), lambda i: greatest(abs(v[i + 1]), abs(q[i + 1])))))"),
    ("vec_composite", "composite", f"(0.5 * ({_COS} + 1) / 2 + 0.3 * {_JAC} + 0.2 / (1 + {_DIST}))"),
):
    _vector_query(_n, _metric, _s)


@query(f"select vec_id, round({_COS}, 6) as score from (select vec_id, label, embedding::double[] as v, {_Q}::double[] as q from embeddings) where label in (2, 3) and label <> 3 order by {_COS} desc, vec_id limit 10")
def vec_topk_filtered(spark, d):
    rows, q = _vec(spark, d)
    return rounded(S.search(rows, q, 10, "cosine", C.is_in("label", [2, 3]) & C.ne("label", 3), key="vec_id").select("vec_id", "score"), "score")


@query(f"select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by {_COS} desc, vec_id) as rank from (select label, vec_id, embedding::double[] as v, {_Q}::double[] as q from embeddings)) where rank <= 3")
def vec_topk_per_label(spark, d):
    rows, q = _vec(spark, d)
    return S.top_per_group(rows, q, 3, "label", key="vec_id").select("label", "vec_id", "rank")


@query(f"select count(*) as n from embeddings where label in (1, 2)")
def vec_count_filtered(spark, d):
    return S.count_matching(table(spark, d, "embeddings"), C.is_in("label", [1, 2]))


@query("select vec_id, len(list_filter(embedding, lambda x: x = 0)) / len(embedding) as sparsity, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vec_sparsity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.sparsity(F.col("embedding")).alias("sparsity"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35")
def vec_near_duplicates(spark, d):
    return rounded(S.near_pairs(table(spark, d, "embeddings"), 0.35, key="vec_id"), "score")


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def vec_sparse_round_trip(spark, d):
    sparse = V.to_sparse(F.col("embedding"))
    rows = table(spark, d, "embeddings").withColumn("s", sparse).withColumn("back", V.to_dense(V.sparse_subtract(V.sparse_scale(F.col("s"), 3.0), V.sparse_add(F.col("s"), F.col("s")))))
    return rows.select("vec_id", F.round(V.total(F.col("back")), 5).alias("total"))


@query("""with q as (select vec_id, embedding::double[] as v, list_min(embedding::double[]) as low, (list_max(embedding::double[]) - list_min(embedding::double[])) / 255 as scale from embeddings),
b as (select vec_id, v, list_transform(v, lambda x: case when scale = 0 then low else low + round((x - low) / scale) * scale end) as back from q)
select vec_id, round(list_cosine_similarity(v, back), 3) as kept, list_sum(list_transform(v[2:64], lambda x, i: case when x > 0 then 1::bigint << (63 - i)::int else 0 end))::bigint + case when v[1] > 0 then -9223372036854775808 else 0 end as code from b""")
def vec_quantized(spark, d):
    rows = table(spark, d, "embeddings")
    back = V.dequantize_u8(V.quantize_u8(F.col("embedding")))
    return rows.select("vec_id", F.round(V.cosine(F.col("embedding"), back), 3).alias("kept"), V.binary_code(F.col("embedding")).alias("code"))


@query()
def vec_inverted_file(spark, d):
    rows, q = _vec(spark, d)
    return S.inverted_file(rows, 8, key="vec_id").search(q, 10, nprobe=4).select("vec_id", "score")


@query()
def vec_product_quantizer(spark, d):
    rows, q = _vec(spark, d)
    pq = S.ProductQuantizer.train(rows, 4, 8)
    coded = pq.encode(rows)
    return coded.withColumn("distance", pq.distance(q, F.col("codes"))).orderBy("distance", "vec_id").limit(10).select("vec_id", "distance")


# text and geo


@query(r"select doc_id from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents) where list_has_all(w, ['the', 'and', 'in'])")
def text_search_and(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.has_all(text.tokens(F.col("text")), ["the", "and", "in"])).select("doc_id")


@query(r"select doc_id from (select doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') as w from documents) where len(list_filter(w, lambda x: starts_with(x, 'thing'))) > 0")
def text_search_prefix(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.has_prefix(text.tokens(F.col("text")), "thing")).select("doc_id")


@query(r"select doc_id from (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from documents) where len(list_filter(w, lambda x: x <> '' and levenshtein(x, 'ander') <= 1)) > 0")
def text_search_fuzzy(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.has_near(text.tokens(F.col("text")), "ander", 1)).select("doc_id")


@query("select doc_id, ceil(strlen(text) / 4)::bigint as estimate, 'sha256:' || sha256(text) as hash from documents")
def text_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("estimate"), text.content_hash(F.col("text")).alias("hash"))


_POINT = "select c_custkey as id, ((c_custkey * 37) % 180 - 90)::double as lat, ((c_custkey * 73) % 360 - 180)::double as lon from customer"
_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * power(sin(radians(lon - 20) / 2), 2))))"


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 37) % 180 - 90).cast("double").alias("lat"), ((k * 73) % 360 - 180).cast("double").alias("lon"))


@query(f"select id, round({_HAV}, 4) as distance_km from ({_POINT}) where {_HAV} <= 1500")
def geo_radius(spark, d):
    return rounded(geo.within_radius(_points(spark, d), "lat", "lon", (10.0, 20.0), 1500).select("id", "distance_km"), "distance_km", digits=4)


@query(f"select id from ({_POINT}) where lat between -10 and 30 and lon between 0 and 45")
def geo_box(spark, d):
    return _points(spark, d).where(geo.in_box(F.col("lat"), F.col("lon"), -10, 0, 30, 45)).select("id")


@query(f"select id, round({_HAV}, 4) as distance_km from ({_POINT}) order by {_HAV}, id limit 15")
def geo_nearest(spark, d):
    return rounded(geo.nearest(_points(spark, d), "lat", "lon", (10.0, 20.0), 15, "id").select("id", "distance_km"), "distance_km", digits=4)


# unified: entities are the vectors, each linked to (7 i + 3) mod n

_LINKS = "n as (select count(*) as n from embeddings), l as (select vec_id as a, (vec_id * 7 + 3) % n as b from embeddings, n), near as (select b as id from l where a = 1 union select a from l where b = 1 union select b from l where a in (select b from l where a = 1))"


def _entities(spark, d):
    rows = table(spark, d, "embeddings")
    n = rows.count()
    links = rows.select(F.col("vec_id").alias("src_key"), ((F.col("vec_id") * 7 + 3) % n).alias("dst_key"), F.lit("next").alias("type"), F.lit(True).alias("directed"))
    hop = links.join(links.where("src_key = 1").select(F.col("dst_key").alias("_m")), F.col("src_key") == F.col("_m")).select(F.lit(1).cast("long").alias("src_key"), "dst_key", "type", "directed")
    return rows.select(F.col("vec_id").alias("key"), "embedding", "label"), links.unionByName(hop)


@query(f"with {_LINKS} select vec_id as key, round({_COS}, 6) as score from (select vec_id, embedding::double[] as v, {_Q}::double[] as q from embeddings where vec_id in (select id from near)) order by {_COS} desc, key limit 5")
def uni_similar_connected(spark, d):
    rows, links = _entities(spark, d)
    q = list(rows.where("key = 1").first()["embedding"])
    return rounded(unified.similar_connected(rows, links, q, 1, 5).select("key", "score"), "score")


@query(f"with {_LINKS} select vec_id as key, round({_COS}, 6) as score from (select vec_id, embedding::double[] as v, {_Q}::double[] as q from embeddings where vec_id in (select id from near) and vec_id <> 1) order by {_COS} desc, key limit 5")
def uni_neighbors_by_similarity(spark, d):
    rows, links = _entities(spark, d)
    return rounded(unified.neighbours_by_similarity(rows, links, 1, None, 5).select("key", "score"), "score")


@query("select 'relational:nation' as source, n_nationkey::varchar as id, n_name as name from nation where n_regionkey = 2")
def uni_find_rows(spark, d):
    found = unified.find_rows(table(spark, d, "nation"), "nation", "n_nationkey", C.eq("n_regionkey", 2))
    return found.select("source", "id", F.col("data")["n_name"].alias("name"))


@query("select 'graph' as source, s_suppkey::varchar as id, s_nationkey::varchar as nation from supplier where s_nationkey = 7 and s_acctbal > 0")
def uni_find_nodes(spark, d):
    found = unified.find_nodes(supplier_graph(spark, d), "n7", C.gt("balance", 0.0))
    return found.select("source", "id", F.col("data")["s_nationkey"].alias("nation"))


# services, snapshots, encodings


@query("""select user_id, event_type, date_trunc('day', ts) as bucket, count(*) as n from events group by all""")
def svc_access_buckets(spark, d):
    return services.access_buckets(table(spark, d, "events"), "1 day", "ts", "user_id", "event_type")


@query("""with c as (select doc_id, unnest(range(0, greatest(1, ceil(strlen(text) / 4096)::bigint))) as seq, encode(text) as b from documents),
k as (select doc_id, sha256(b[(seq * 4096 + 1):(seq * 4096 + 4096)]) as h, octet_length(b[(seq * 4096 + 1):(seq * 4096 + 4096)]) as size from c)
select count(distinct doc_id) as artifacts, count(*) as chunks, sum(size)::bigint as bytes, count(distinct h) as stored_chunks from k""")
def svc_blob_dedup(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"))
    return services.blob_stats(services.chunked(files, 4096)).select("artifacts", "chunks", "bytes", "stored_chunks")


@query(f"""with c as (select vec_id as key, 'p' || vec_id % 50 as prompt, label, embedding::double[] as v from embeddings where vec_id % 10 = 0),
r as (select vec_id as request, 'p' || vec_id % 60 as prompt, label, embedding::double[] as v from embeddings where vec_id % 10 = 5),
e as (select request, c.key from r join (select prompt, min(key) as key from c group by prompt) c using (prompt)),
s as (select r.request, arg_max(c.key, (list_cosine_similarity(r.v, c.v), c.key)) as key from r join c on c.label = r.label where r.request not in (select request from e) and list_cosine_similarity(r.v, c.v) >= 0.1 group by r.request)
select r.request, coalesce(e.key, s.key) as key, case when e.key is not null then 'exact' when s.key is not null then 'semantic' else 'miss' end as layer from r left join e using (request) left join s using (request)""")
def svc_cache_layers(spark, d):
    rows = table(spark, d, "embeddings")
    named = lambda part, n, key: rows.where(part).select(F.col("vec_id").alias(key), F.concat(F.lit("p"), F.col("vec_id") % n).alias("prompt"), F.col("label").alias("model"), "embedding")
    cached = named("vec_id % 10 = 0", 50, "key").dropDuplicates(["key"])
    first = cached.groupBy("prompt").agg(F.min("key").alias("key"))
    entries = cached.join(first.withColumnRenamed("key", "_first"), "prompt").withColumn("prompt", F.when(F.col("key") == F.col("_first"), F.col("prompt"))).drop("_first")
    return services.cache_get_all(entries, named("vec_id % 10 = 5", 60, "request"), 0.1)


def _versions(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_name", F.round("s_acctbal", 2).alias("bal"))
    new = old.where("key % 10 <> 3").withColumn("bal", F.when(F.col("key") % 4 == 0, F.lit(0.0)).otherwise(F.col("bal")))
    return old, new.unionByName(spark.createDataFrame([(10_000_001, "new", 5.0)], "key long, s_name string, bal double"))


@query("""with o as (select s_suppkey as key, s_name, round(s_acctbal, 2) as bal from supplier), n as (select key, s_name, case when key % 4 = 0 then 0.0 else bal end as bal from o where key % 10 <> 3 union all select 10000001, 'new', 5.0)
select coalesce(n.key, o.key) as key, case when n.key is null then 'removed' when o.key is null then 'added' else 'changed' end as was, n.bal as bal from o full join n on o.key = n.key where n.key is null or o.key is null or o.bal <> n.bal""")
def svc_snapshot_diff(spark, d):
    return store.diff(*_versions(spark, d)).select("key", "was", "bal")


@query("""with o as (select s_suppkey as key, s_name, round(s_acctbal, 2) as bal from supplier)
select key, s_name, case when key % 4 = 0 then 0.0 else bal end as bal from o where key % 10 <> 3 union all select 10000001, 'new', 5.0""")
def svc_snapshot_delta(spark, d):
    old, new = _versions(spark, d)
    return store.apply_delta(old, store.diff(old, new))


@query("""select o_custkey, run, o_orderstatus, count(*) as run_length, min(o_orderkey) as run_start from (
select *, (sum(new) over (partition by o_custkey order by o_orderkey) - 1)::bigint as run from (
select *, case when lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) = o_orderstatus then 0 else 1 end as new from orders)) group by all""")
def svc_run_lengths(spark, d):
    return encoding.run_lengths(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@query("select o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderkey), 0) as delta from orders")
def svc_delta_encode(spark, d):
    return encoding.delta_encode(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("select before, after, count(*) as n from (select lag(event_type) over (partition by user_id order by event_id) as before, event_type as after from events) where before is not null group by all")
def svc_code_transitions(spark, d):
    return services.code_transitions(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("select event_id, ts from events where ts >= timestamp '2024-01-20 00:00:00' and event_type like 'p%e'")
def svc_audit_since(spark, d):
    since = services.audit_since(table(spark, d, "events"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return services.by_glob(since, "event_type", "p*e").select("event_id", "ts")


@query("select e.user_id, e.event_id from (select user_id, max(event_id) as event_id from events group by user_id) e")
def svc_last_write_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id")
    return S.upsert(rows.limit(0), rows, "user_id", "event_id")


@query()
def svc_heat_diffusion(spark, d):
    g = supplier_graph(spark, d)
    start = g.edges.agg(F.min("src").alias("id")).withColumn("value", F.lit(1.0))
    return services.diffusion(g, start, degree=5)


@query("select o_custkey, sum(greatest(1, ceil(log2(o_orderkey + 1) / 7)))::bigint as bytes, true as same from orders group by o_custkey")
def enc_varint_round_trip(spark, d):
    ids = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    coded = ids.withColumn("code", encoding.varint(F.col("ids")))
    return coded.select("o_custkey", F.octet_length("code").cast("long").alias("bytes"), (encoding.unvarint(F.col("code")) == F.col("ids")).alias("same"))


@query()
def enc_tensor_train(spark, d):
    rows = table(spark, d, "embeddings").withColumn("t", encoding.tt_compressed(F.col("embedding"), (4, 4, 4), 4))
    return rows.select("vec_id", "t.kept", F.round(V.cosine(F.col("embedding"), F.col("t.approx")), 4).alias("similarity"))


@query(f"with {_E}, p as (select s_suppkey as id, s_suppkey % 4 as shard from supplier) select count(*) as edges, count(case when a.shard <> b.shard then 1 end) as cut, count(case when a.shard <> b.shard then 1 end) / count(*) as share from e join p a on a.id = e.src join p b on b.id = e.dst")
def dis_edge_cut(spark, d):
    g = supplier_graph(spark, d)
    return partitioning.edge_cut(g.edges, partitioning.shard_of(g.nodes, "modular", 4, "id"))


@query("""with s as (select case when l_suppkey < 20 then 0 when l_suppkey < 60 then 1 else 2 end as shard, count(*) as n from lineitem group by 1)
select sum(n)::bigint as rows, max(n) as largest, sum(n) / 3 as mean, max(n) / (sum(n) / 3) as skew from s""")
def dis_range_skew(spark, d):
    sharded = partitioning.shard_of(table(spark, d, "lineitem"), "range", 3, "l_suppkey", [20, 60])
    return partitioning.skew(sharded, 3)


@query("select token, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as token from documents) where strlen(token) >= 2 and token not in ('a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'is', 'it') group by token having count(distinct doc_id) >= 20")
def text_token_index(spark, d):
    docs = table(spark, d, "documents")
    return text.token_index(docs, "doc_id", "text", 2, text.STOP_WORDS).groupBy("token").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 20")


@query(f"""with recursive {_E}, s as (select min(src) as s from e),
r as (select s as id, 0 as depth from s union select u.dst, depth + 1 from r join u on u.src = r.id where depth < 3),
m as (select id, min(depth) as depth from r group by id), goal as (select min(id) as g from m where depth = 3),
p as (select s as id, [s] as path, 0 as depth from s union all select u.dst, list_append(path, u.dst), p.depth + 1 from p join u on u.src = p.id join m on m.id = u.dst where m.depth = p.depth + 1 and p.depth < 3)
select path from p, goal where id = g and depth = 3""")
def graph_all_shortest_paths(spark, d):
    g = supplier_graph(spark, d)
    start = g.edges.agg(F.min("src")).first()[0]
    goal = g.distances([start], BOTH, 3).where("depth = 3").agg(F.min("id")).first()[0]
    return g.shortest_paths(start, goal, BOTH)


@query("""with n as (select count(*) as n from embeddings), l as (select vec_id as a, (vec_id * 7 + 3) % n as b from embeddings, n), u as (select a, b from l union select b, a from l)
select vec_id as key, label, list_sort(list(distinct u.b)) as neighbours, round(embedding[1]::double, 5) as first_value from embeddings join u on u.a = vec_id group by vec_id, label, embedding""")
def uni_entity_view(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "key")
    n = rows.count()
    links = rows.select(F.col("key").alias("src_key"), ((F.col("key") * 7 + 3) % n).alias("dst_key"))
    view = unified.entity_view(rows.select("key", "label"), links, rows)
    return view.select("key", "label", "neighbours", F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value"))


_PAIR = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"""with p as (select a.vec_id as x, b.vec_id as y, {_PAIR} as s from embeddings a join embeddings b on a.vec_id <> b.vec_id),
m as (select x, arg_max(y, s) as y, max(s) as s from p group by x) select distinct least(x, y) as a, greatest(x, y) as b, round(s, 6) as score from m where s >= 0.3""")
def svc_nearest_other(spark, d):
    return rounded(services.nearest_other(table(spark, d, "embeddings"), 0.3, "vec_id"), "score")


@query("""with r as (
  select vec_id as id, list_transform(embedding::double[], lambda x: case when abs(x) < 0.15 then 0.0::double else x end) as v,
    list_distinct(case when vec_id % 2 = 0 then [vec_id % 5] else [vec_id % 5, vec_id % 7] end) as k from embeddings),
d as (select * from r union all select id + 1000000, v, k from r where id % 10 = 0 union all select id + 2000000, list_transform(v, lambda x: -x), k from r where id % 10 = 0),
m as (select id, v, k, list_transform(v, lambda x: case when x <> 0 then 1.0::double else 0.0::double end) as u from d),
p as (
  select coalesce(list_cosine_similarity(a.v, b.v), 0) as c, list_inner_product(a.u, b.u) as com, list_sum(a.u) + list_sum(b.u) as total,
    len(list_intersect(a.k, b.k)) as shared, len(a.k) as na, len(b.k) as nb from m a join m b on a.id < b.id),
q as (select *, case when total = com then 1 else com / (total - com) end as j, shared = na and shared = nb as same from p)
select case when c >= 0.99 and same then 'Identical' when c <= -0.95 and same then 'Opposite' when abs(c) < 0.1 and j < 0.5 then 'Orthogonal'
  when c >= 0.7 or j >= 0.5 then 'Conflicting' when shared > 0 then 'Ambiguous' else 'LowConflict' end as class, count(*) as n from q group by 1""")
def svc_conflict_classes(spark, d):
    near = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 0.15, F.lit(0.0)).otherwise(x))
    part = F.when(F.col("vec_id") % 2 == 0, F.array(F.col("vec_id") % 5)).otherwise(F.array(F.col("vec_id") % 5, F.col("vec_id") % 7))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), near.alias("v"), part.alias("keys"))
    # a copy of each tenth delta with its keys, and its opposite: identical and opposite pairs
    tenth = rows.where("id % 10 = 0")
    copies = tenth.withColumn("id", F.col("id") + 1_000_000).unionByName(tenth.select((F.col("id") + 2_000_000).alias("id"), F.transform("v", lambda x: -x).alias("v"), "keys"))
    return services.conflict_counts(rows.unionByName(copies))


# versions, pages, logs, stored index


@query("select n_nationkey, n_name from nation where n_regionkey <> 2")
def rel_transaction(spark, d):
    e = Engine(spark)
    e.register("nation_t", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    e.execute("BEGIN")
    e.execute("UPDATE nation_t SET n_name = 'gone' WHERE n_regionkey = 1")
    e.execute("ROLLBACK")
    e.execute("BEGIN")
    e.execute("DELETE FROM nation_t WHERE n_regionkey = 2")
    e.execute("COMMIT")
    return e.execute("SELECT n_nationkey, n_name FROM nation_t")


@query("select s_suppkey as id, s_acctbal as balance, (select count(*) from supplier where s_acctbal > 0) as total from supplier where s_acctbal > 0 order by s_suppkey limit 20 offset 30")
def graph_nodes_page(spark, d):
    rows, _, total = supplier_graph(spark, d).nodes_page(30, 20, C.gt("balance", 0.0), "supplier", total=True)
    return rows.select("id", "balance", F.lit(total).cast("long").alias("total"))


@query("select user_id::varchar as key, arg_max(value, event_id)::varchar as value from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def svc_log_replay(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return store.replay_log(log)


@query(f"select vec_id, round({_COS}, 6) as score from (select vec_id, embedding::double[] as v, {_Q}::double[] as q from embeddings) order by {_COS} desc, vec_id limit 20")
def vec_stored_index(spark, d):
    rows, q = _vec(spark, d)
    index = S.build_index(rows, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", key="vec_id")
    return rounded(index.search(q, 20, n_probe=len(index.centroids)).select("vec_id", "score"), "score")  # all lists: the exact result
