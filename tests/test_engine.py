import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import services, unified
from quarry.operators.graph import Graph
from quarry.plans.engine import CatalogError, Engine
from quarry.plans.parser import ParseError, Parser, parse, parse_all
from quarry.sources import store
from tests.conftest import rows


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "versions"))
    e.execute("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(10) NOT NULL, age INT DEFAULT 1)")
    e.execute("INSERT INTO users VALUES (1, 'Alice', 25), (2, 'Bob', 35), (3, 'Carol', 28)")
    return e


def test_precedence_is_made_explicit():
    assert Parser("a OR b AND NOT c = 1 + 2 * 3").expression() == "(`a` OR (`b` AND (NOT (`c` = (1 + (2 * 3))))))"
    assert Parser("a | b & c << 2 >= 1").expression() == "((`a` | (`b` & shiftleft(`c`, 2))) >= 1)"
    assert Parser("x NOT IN (1, 2) AND y IS NOT NULL").expression() == "((`x` NOT IN (1, 2)) AND (`y` IS NOT NULL))"
    assert Parser("CASE a WHEN 1 THEN 'o''k' END").expression() == "(CASE `a` WHEN 1 THEN 'o\\'k' END)"


def test_statements():
    assert parse("SIMILAR user:1 LIMIT 3 EUCLIDEAN").args["metric"] == "euclidean"
    assert parse("SIMILAR [1, 0] METRIC cosine IN docs TOP 2").args["collection"] == "docs"
    assert parse("PATH SHORTEST 1 -> 2 LIMIT 4").args == {"how": "shortest", "from": 1, "to": 2, "weight": None, "hops": (1, 5), "limit": 4}
    assert parse("ENTITY CONNECT a:1 -> b:2 : likes").args == {"src": "a:1", "dst": "b:2", "type": "likes"}
    assert [s.kind for s in parse_all("SHOW TABLES; SELECT ';' AS x; -- end\n")] == ["show_tables", "sql"]
    with pytest.raises(ParseError):
        parse("FROBNICATE 1")
    with pytest.raises(ParseError):
        parse("SHOW TABLES now")


def test_tables(engine):
    engine.execute("INSERT INTO users (id, name) VALUES (4, 'Da''ve')")
    assert rows(engine.execute("UPDATE users SET age = age + 1 WHERE name LIKE 'A%' OR age > 30")) == [(2,)]
    assert rows(engine.execute("SELECT id, age FROM users")) == [(1, 26), (2, 36), (3, 28), (4, 1)]
    engine.execute("DELETE FROM users WHERE id = 3")
    assert rows(engine.execute("SELECT COUNT(*) FROM users")) == [(3,)]
    with pytest.raises(CatalogError):
        engine.execute("INSERT INTO users VALUES (1, 'again', 2)")
    with pytest.raises(CatalogError):
        engine.execute("INSERT INTO users VALUES (8, NULL, 2)")
    with pytest.raises(CatalogError):
        engine.execute("CREATE TABLE users (id INT)")
    engine.execute("ALTER TABLE users ADD COLUMN email TEXT")
    engine.execute("ALTER TABLE users RENAME COLUMN email TO mail")
    assert rows(engine.execute("DESCRIBE users"))[2] == ("mail", "string")
    with pytest.raises(CatalogError):
        engine.execute("ALTER TABLE users DROP COLUMN id")


def test_foreign_keys_cascade(engine):
    engine.execute("CREATE TABLE posts (id INT, author INT REFERENCES users (id) ON DELETE CASCADE)")
    engine.execute("INSERT INTO posts VALUES (1, 1), (2, 2), (3, NULL)")
    with pytest.raises(CatalogError):
        engine.execute("INSERT INTO posts VALUES (4, 99)")
    engine.execute("DELETE FROM users WHERE id = 1")
    assert rows(engine.execute("SELECT id FROM posts")) == [(2,), (3,)]


def test_checkpoints(engine):
    engine.execute("CHECKPOINT one")
    engine.execute("DELETE FROM users WHERE id > 0")
    engine.execute("ROLLBACK TO one")
    assert rows(engine.execute("SELECT COUNT(*) FROM users")) == [(3,)]
    assert [r["name"] for r in engine.execute("CHECKPOINTS LIMIT 1").collect()] == ["one"]


def test_graph_and_vectors(engine):
    for s in ("NODE CREATE person { name: 'Alice', age: 30 }", "NODE CREATE person name='Bob', age=40", "NODE CREATE team { title: 'x' }", "EDGE CREATE 1 -> 2 : knows { weight: 2.5 }", "EDGE CREATE 2 -> 3 : member"):
        engine.execute(s)
    assert [r["id"] for r in engine.execute("NEIGHBORS 2 BOTH").collect()] == [1, 3]
    assert rows(engine.execute("PATH WEIGHTED 1 TO 3")) == [([1, 2, 3], 3.5)]
    assert rows(engine.execute("AGGREGATE NODE PROPERTY age AVG BY LABEL person")) == [(35.0,)]
    assert rows(engine.execute("FIND PATH person -> team")) == [(1, 3, [1, 2, 3]), (2, 3, [2, 3])]
    assert len(rows(engine.execute("GRAPH PAGERANK ITERATIONS 3 LIMIT 2"))) == 2
    for s in ("ENTITY CREATE a { name: 'A' } EMBEDDING [1, 0]", "EMBED BATCH (b, [0.9, 0.1]) (c, [0, 1])", "ENTITY CONNECT a -> c : likes"):
        engine.execute(s)
    assert [r["key"] for r in engine.execute("SIMILAR a LIMIT 2").collect()] == ["b", "c"]
    assert [r["key"] for r in engine.execute("SIMILAR [1, 0] CONNECTED TO a LIMIT 2").collect()] == ["c"]
    assert engine.execute("ENTITY GET a").first()["neighbours"] == ["c"]
    engine.execute("ENTITY DELETE c")
    assert rows(engine.execute("COUNT EMBEDDINGS")) == [(2,)]


def test_graph_constraints_and_batches(engine):
    engine.execute("BATCH CREATE NODES [person { name: 'A', age: 1 }, person { name: 'B' }, team { name: 'T' }]")
    assert rows(engine.execute("BATCH CREATE EDGES [1 -> 2 : knows, 2 -> 3 : member { weight: 2.0 }, 2 -> 77 : lost]")) == [(2,)]
    engine.execute("CONSTRAINT CREATE one ON PROPERTY name UNIQUE")
    with pytest.raises(CatalogError):
        engine.execute("NODE CREATE person { name: 'A' }")
    with pytest.raises(CatalogError):
        engine.execute("CONSTRAINT CREATE two ON PROPERTY age EXISTS")
    assert engine.execute("CONSTRAINT LIST").count() == 1
    engine.execute("CONSTRAINT DROP one")
    engine.execute("NODE CREATE person { name: 'A' }")
    assert rows(engine.execute("BATCH DELETE NODES [1, 2]")) == [(2,)]
    assert engine.execute("EDGE LIST").count() == 0


def test_cache_statements(engine):
    engine.execute("CACHE PUT 'hello' 'world'")
    engine.execute("CACHE SEMANTIC PUT 'hi' 'there' [1, 0]")
    assert rows(engine.execute("CACHE GET 'hello'")) == [("hello", "world")]
    found = engine.execute("CACHE SEMANTIC GET 'greetings' [0.9, 0.1] THRESHOLD 0.8").first()
    assert (found["response"], found["layer"]) == ("there", "semantic")
    assert rows(engine.execute("CACHE STATS")) == [(2, 1)]
    assert rows(engine.execute("CACHE EVICT 1")) == [(1,)]
    assert engine.execute("CACHE CLEAR").first()[0] == 1


def test_blob_statements(engine):
    engine.execute("BLOB PUT notes 'some text' TYPE 'text/plain' TAG draft BY ann LINK user:1")
    engine.execute("BLOB PUT copy 'some text'")
    assert bytes(engine.execute("BLOB GET notes").first()["data"]) == b"some text"
    assert engine.execute("BLOB STATS").first()["stored_chunks"] == 1
    assert [r["id"] for r in engine.execute("BLOBS FOR user:1").collect()] == ["notes"]
    engine.execute("BLOB TAG copy draft")
    assert [r["id"] for r in engine.execute("BLOBS BY TAG draft").collect()] == ["copy", "notes"]
    assert [r["id"] for r in engine.execute("BLOBS 'no*'").collect()] == ["notes"]
    assert rows(engine.execute("BLOB VERIFY notes")) == [(1, 0)]
    engine.execute("BLOB DELETE notes")
    assert rows(engine.execute("BLOB GC")) == [(0,)]
    engine.execute("BLOB DELETE copy")
    assert rows(engine.execute("BLOB GC")) == [(1,)]


def test_deltas(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "key long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "key long, v string")
    delta = store.diff(old, new)
    assert rows(delta.select("key", "was")) == [(2, "changed"), (3, "removed"), (4, "added")]
    assert rows(store.apply_delta(old, delta)) == rows(new)
    more = spark.createDataFrame([(2, "delete", None)], "key long, op string, v string")
    merged = store.merge_deltas([delta.select("key", "op", "v"), more])
    assert rows(store.apply_delta(old, merged)) == [(1, "a"), (4, "d")]
    assert rows(store.fields_changed(old, new))[0] == (2, "v", "b", "B")


def test_snapshots(spark, tmp_path):
    df = spark.range(5).select(F.concat(F.lit("user:"), F.col("id").cast("string")).alias("key"), "id")
    store.save_snapshot(df, str(tmp_path / "a"))
    store.save_snapshot(df, str(tmp_path / "b"))
    store.merge_snapshots(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    back = store.load_snapshot(spark, str(tmp_path / "c"))
    assert back.count() == 10 and store.count_prefix(back, "user:1") == 2


def test_blobs(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 10)), ("b", bytearray(b"x" * 8 + b"yy")), ("c", bytearray())], "id string, content binary")
    chunks = services.chunked(files, 4)
    r = services.blob_stats(chunks).first()
    assert (r["artifacts"], r["chunks"], r["bytes"], r["stored_chunks"]) == (3, 7, 20, 4)
    assert services.damaged_chunks(chunks).count() == 0


def test_access_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    edges = spark.createDataFrame([(1, 2, "MEMBER", 0), (2, 3, "MEMBER", 0), (3, 4, "VAULT_ACCESS", 2), (1, 4, "VAULT_ACCESS", 1), (2, 5, "VAULT_ACCESS", 3)], "src long, dst long, type string, permission int")
    g = Graph(nodes, edges)
    assert rows(services.permissions(g, 1)) == [(4, 2), (5, 3)]
    assert rows(services.single_points(g)) == [(5, 2)]


def test_heat_is_kept(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    ring = spark.createDataFrame([(i, (i + 1) % 4) for i in range(4)], "src long, dst long")
    out = dict(rows(services.diffusion(Graph(nodes, ring), spark.createDataFrame([(0, 1.0)], "id long, value double"))))
    assert sum(out.values()) == pytest.approx(1, abs=1e-6) and out[0] > out[1] > out[2]


def test_unified_items(spark):
    df = spark.createDataFrame([(1, None, bytearray(b"ab"))], "id long, name string, raw binary")
    assert unified.find_rows(df, "t", "id").first()["data"] == {"id": "1", "name": "null", "raw": "<2 bytes>"}


def test_streamed_buckets(spark, tmp_path):
    from quarry.streaming.access import access_counts

    log = spark.createDataFrame([("e", "s", f"2024-01-01 0{h}:10:00") for h in (0, 0, 1, 5)], "entity string, secret string, ts string")
    log.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("entity string, secret string, ts timestamp").parquet(str(tmp_path / "log"))
    q = access_counts(stream).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("buckets").collect()) == [1, 2]


def test_created_ids_come_in_order(spark):
    long = "".join(chr(97 + i * i % 23 + i % 3) for i in range(9000))  # the larger file is read first
    made = Engine(spark).execute(f"CREATE (a:p {{n: 'A'}}), (b:p {{n: '{long}'}}), (a)-[:x]->(b), (b)-[:x {{n: '{long}'}}]->(a)")
    assert [r["id"] for r in made.collect()] == [1, 2, 1, 2]


def test_pattern_statements(spark):
    e = Engine(spark)
    one = lambda text: [tuple(r) for r in e.execute(text).collect()]
    assert one("CREATE (a:person {name: 'Ann', age: 30})-[:knows {since: 2020}]->(b:person {name: 'Bob', age: 40}), (b)<-[:knows]-(c:person {name: \"O'Neil\"})") == [(1,), (2,), (3,), (1,), (2,)]
    assert one("MATCH (a:person)-[:knows]->(b) RETURN a.name AS x, b.name AS y ORDER BY x") == [("Ann", "Bob"), ("O'Neil", "Bob")]
    assert one("MATCH (a)<-[r:knows]-(b {name: 'Ann'}) RETURN r.since, type(r), id(a)") == [(2020, "knows", 2)]
    assert one("MATCH (a:person) WHERE a.name STARTS WITH 'O' OR a.age > 35 RETURN a.name AS n ORDER BY n DESC SKIP 1 LIMIT 1") == [("Bob",)]
    assert one("MATCH (a)-[]-(b) RETURN a.name AS n, count(*) AS c ORDER BY n") == [("Ann", 1), ("Bob", 2), ("O'Neil", 1)]
    assert one("MATCH (a {name: 'Ann'})-[p:knows*1..2]-(b) RETURN b.name AS n, size(p) AS k ORDER BY k") == [("Bob", 2), ("O'Neil", 3)]
    assert one("MATCH (a:person) RETURN a ORDER BY a.id")[0][0] == 1
    assert one("MATCH (a {name: 'Ann'}), (c {name: \"O'Neil\"}) CREATE (a)-[:likes]->(c)") == [(3,)]
    assert one("GRAPH PATTERN COUNT (a)-[:likes]->(b)") == [(1,)] and one("GRAPH PATTERN EXISTS (a)-[:hates]->(b)") == [(False,)]
    assert one("MATCH (a)-[:likes]->(b) SET a.age = a.age + 1, b.age = 9") == [(1,)]
    assert one("MATCH (a:person) RETURN a.name AS n, a.age AS y ORDER BY n") == [("Ann", 31), ("Bob", 40), ("O'Neil", 9)]
    assert one("MERGE (a:person {name: 'Ann'}) ON CREATE SET a.age = 1 ON MATCH SET a.age = 50") == [(1,)]
    assert len(one("MERGE (a:city {name: 'Ulm'}) ON CREATE SET a.age = 1 ON MATCH SET a.age = 50")) == 1
    assert one("MATCH (a:city) RETURN a.name, a.age") == [("Ulm", 1)] and one("MATCH (a {name: 'Ann'}) RETURN a.age") == [(50,)]
    assert one("MATCH (a)-[r:likes]->(b) DELETE r") == [(1,)]
    assert one("MATCH (a:person {name: 'Bob'}) DETACH DELETE a") == [(3,)]
    assert one("MATCH (a)-[r]-(b) RETURN count(*)") == [(0,)]
    with pytest.raises(ParseError):
        e.execute("MATCH (a:person RETURN a")


def test_transactions_go_back_to_their_beginning(engine):
    one = lambda text: [tuple(r) for r in engine.execute(text).collect()]
    engine.execute("NODE CREATE city { name: 'Ulm' }")
    engine.execute("BEGIN TRANSACTION")
    engine.execute("INSERT INTO users VALUES (4, 'Dora', 50)")
    engine.execute("CREATE TABLE other (id INT)")
    engine.execute("MATCH (a:city) SET a.name = 'Bonn'")
    assert one("SELECT count(*) FROM users") == [(4,)]
    with pytest.raises(CatalogError):
        engine.execute("BEGIN")
    engine.execute("ROLLBACK")
    assert one("SELECT count(*) FROM users") == [(3,)] and one("SHOW TABLES") == [("users",)]
    assert one("MATCH (a:city) RETURN a.name") == [("Ulm",)]
    engine.execute("BEGIN")
    engine.execute("DELETE FROM users WHERE id = 1")
    engine.execute("COMMIT")
    assert one("SELECT count(*) FROM users") == [(2,)]
    with pytest.raises(CatalogError):
        engine.execute("ROLLBACK")


def test_collections_and_their_index(spark):
    import numpy as np

    e = Engine(spark)
    e.execute("EMBED COLLECTION CREATE docs DIMENSION 3 METRIC cosine")
    with pytest.raises(CatalogError):
        e.execute("EMBED STORE a [1, 2] INTO docs")
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 3)).round(3)
    e.execute("EMBED BATCH " + ", ".join(f"(k{i}, [{a}, {b}, {c}])" for i, (a, b, c) in enumerate(v.tolist())) + " INTO docs")
    exact = [tuple(x) for x in e.execute("SIMILAR k7 INTO docs LIMIT 10").collect()]
    e.execute("EMBED BUILD INDEX INTO docs")
    index = e.vector_indexes["docs"][1]
    assert index.recall >= 0.95 and 1 <= index.n_probe <= len(index.centroids)
    found = [tuple(x) for x in e.execute("SIMILAR k7 INTO docs LIMIT 10").collect()]
    assert len(set(exact) & set(found)) >= 9 and "k7" not in dict(found)
    assert [tuple(x) for x in index.search(v[3].tolist(), 5, n_probe=len(index.centroids)).select("key").collect()][0] == ("k3",)
    e.execute("EMBED DELETE k1 INTO docs")  # the index no longer holds
    assert dict(map(tuple, e.execute("SIMILAR k7 INTO docs LIMIT 10").collect())).keys() <= {f"k{i}" for i in range(300)} - {"k1", "k7"}
    assert [tuple(x) for x in e.execute("SHOW COLLECTIONS").collect()] == [("docs", 3, "cosine")]
    e.execute("EMBED COLLECTION DROP docs")
    assert e.execute("COUNT EMBEDDINGS INTO docs").first()[0] == 0


def test_vault_batches_columns_and_pages(engine):
    one = lambda text: [tuple(r) for r in engine.execute(text).collect()]
    engine.execute("VAULT SET api:key 'abc'")
    engine.execute("VAULT ROTATE api:key 'def'")
    engine.execute("VAULT GRANT user:1 ON api:key write")
    assert one("VAULT GET api:key") == [("api:key", "def", 2)] and one("VAULT LIST 'api*'") == [("api:key", 2)]
    assert [tuple(r) for r in engine.grants.collect()] == [("user:1", "api:key", "write")]
    assert one("VAULT REVOKE user:1 ON api:key") == [(1,)] and one("VAULT DELETE api:key") == [(1,)]
    with pytest.raises(CatalogError):
        engine.execute("VAULT ROTATE api:key 'x'")
    engine.execute("BATCH CREATE NODES [city { name: 'Ulm', size: 1 }, city { name: 'Bonn', size: 2.5 }, town { name: 'Au' }]")
    assert one("BATCH UPDATE NODES [1 { size: 9 }, 3 { name: 'Aue', old: true }, 8 { size: 1 }]") == [(2,)]
    assert one("MATCH (a) RETURN a.name AS n, a.size, a.old ORDER BY n") == [("Aue", None, True), ("Bonn", 2.5, None), ("Ulm", 9.0, None)]
    page, more, total = engine.graph.nodes_page(1, 1, label="city", total=True)
    assert [r["name"] for r in page.collect()] == ["Bonn"] and not more and total == 2
    with pytest.raises(CatalogError):
        engine.execute("ALTER TABLE users ADD COLUMN town TEXT NOT NULL")
    engine.execute("ALTER TABLE users ADD COLUMN town TEXT NOT NULL DEFAULT 'Ulm'")
    engine.execute("INSERT INTO users (id, name) VALUES (9, 'Eve')")
    assert one("SELECT town, count(*) FROM users GROUP BY town") == [("Ulm", 4)]
    assert engine.cached("what", lambda p: p + "!") == "what!" == engine.cached("what", lambda p: "other")
    assert engine.to_pandas("SELECT id FROM users WHERE id = 9").id.tolist() == [9]


def test_log_replay(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame([(1, "put", "a", "1"), (2, "put", "b", "2")], store.LOG), path)
    store.append_log(spark.createDataFrame([(3, "delete", "a", None), (4, "put", "c", "3")], store.LOG), path)
    base = spark.createDataFrame([("a", "0"), ("z", "9")], "key string, value string")
    assert rows(store.replay_log(spark.read.parquet(path), base)) == [("b", "2"), ("c", "3"), ("z", "9")]
    assert rows(store.replay_log(spark.read.parquet(path), upto=2)) == [("a", "1"), ("b", "2")]


def test_conflict_classes(spark):
    data = [(1, [1.0, 0.0, 0.0], ["k"]), (2, [1.0, 0.0, 0.0], ["k"]), (3, [-1.0, 0.0, 0.0], ["k"]), (4, [0.0, 1.0, 0.0], ["m"]), (5, [0.9, 0.1, 0.0], ["n"]), (6, [0.2, 0.0, 1.0, ][:3], ["k"])]
    found = {(r["a"], r["b"]): r["class"] for r in services.delta_conflicts(spark.createDataFrame(data, "id int, v array<double>, keys array<string>")).collect()}
    assert found[1, 2] == "Identical" and found[1, 3] == "Opposite" and found[1, 4] == "Orthogonal" and found[1, 5] == "Conflicting"
    assert found[1, 6] == "Conflicting"  # the same positions, although the angle is wide
    spread = [(1, [1.0, 0.0, 1.0, 0.0, 0.0], ["k"]), (2, [1.0, 2.0, 0.0, 1.0, 0.0], ["k"]), (3, [1.0, 2.0, 0.0, 1.0, 0.0], ["q"])]
    df = spark.createDataFrame(spread, "id int, v array<double>, keys array<string>")
    found = {(r["a"], r["b"]): r["class"] for r in services.delta_conflicts(df).collect()}
    assert found == {(1, 2): "Ambiguous", (1, 3): "LowConflict", (2, 3): "Conflicting"}
    assert rows(services.conflict_counts(df)) == [("Ambiguous", 1), ("Conflicting", 1), ("LowConflict", 1)]
    assert rows(services.delta_conflicts(df, merge_overlap=True))[0][2] == "LowConflict"


def test_many_inserts_are_checked_and_written_together(engine, monkeypatch):
    monkeypatch.setattr("quarry.plans.engine.MOST_PARTS", 2)
    for k in range(4, 9):
        engine.execute(f"INSERT INTO users VALUES ({k}, 'N{k}', {k})")
    assert engine.execute("SELECT count(*), max(id) FROM users").first()[:] == (8, 8) and engine.parts["users"] < 3
    for bad in ("(8, 'again', 1)", "(20, NULL, 1)", "(30, 'a', 1), (30, 'b', 2)"):
        with pytest.raises(CatalogError):
            engine.execute(f"INSERT INTO users VALUES {bad}")
    assert engine.execute("SELECT count(*) FROM users").first()[0] == 8


def test_cache_look_ups_of_one_model_are_dealt_to_tasks(spark, monkeypatch):
    from quarry.functions import vectors as V
    from quarry.operators import vector_search as S

    r = np.random.default_rng(3)
    v = r.normal(size=(40, 4)).round(1)
    v[30:] = v[:10]  # equal vectors: the largest key counts
    v[5] = 0
    model = lambda k: None if k % 17 == 16 else "n" if k % 9 == 8 else "m"
    cache = spark.createDataFrame([(k, f"c{k}", model(k), x.tolist() if k % 13 else None) for k, x in enumerate(v)] + [(100, "c100", "m", [1.0])], "key long, prompt string, model string, embedding array<double>")
    asked = [(k, "c3" if k == 7 else "none", model(k), (x + 0.01).tolist()) for k, x in enumerate(v)] + [(50, "none", "m", [2.0])]
    requests = spark.createDataFrame(asked, "request long, prompt string, model string, embedding array<double>")
    a, b = requests.where("prompt <> 'c3'"), cache.withColumnRenamed("embedding", "e").drop("prompt")
    pairs = a.join(b, "model").where(F.size("embedding") == F.size("e")).withColumn("s", V.cosine(F.col("embedding"), F.col("e"))).where("s >= 0.5").groupBy("request").agg(F.max_by("key", F.struct("s", "key")))
    want = dict(rows(pairs))
    for size in (4096, 7):
        monkeypatch.setattr(S, "MATCH_ROWS", size)
        out = services.cache_get_all(cache, requests, 0.5)
        found = {row["request"]: (row["key"], row["layer"]) for row in out.collect()}
        assert found == {k: (3, "exact") if k == 7 else (want[k], "semantic") if k in want else (None, "miss") for k, *_ in asked}
    assert "FlatMapCoGroups" in out._jdf.queryExecution().optimizedPlan().toString()  # no pair of rows is joined
