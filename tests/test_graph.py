import pytest
from pyspark.sql import functions as F

from quarry.operators import conditions as C
from quarry.operators import graph_algorithms as A
from quarry.operators.graph import EdgePattern, Graph, NegativeWeightError, NodePattern, Pattern
from tests.conftest import rows

LINKS = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5), (5, 6)]


@pytest.fixture(scope="module")
def g(spark):
    """Two triangles that share node 3, a tail to 6, and node 9 alone."""
    nodes = spark.createDataFrame([(i, ["p", "odd"] if i % 2 else ["p"], float(i)) for i in (1, 2, 3, 4, 5, 6, 9)], "id long, labels array<string>, age double")
    edges = [(k, a, b, "t", False, float(a + b)) for k, (a, b) in enumerate(LINKS)]
    return Graph(nodes, spark.createDataFrame(edges, "id long, src long, dst long, type string, directed boolean, weight double"))


def test_labels_and_properties(g):
    assert g.with_all_labels(["p", "odd"]).count() == 4
    assert g.with_any_label(["odd", "x"]).count() == 4
    assert rows(g.labels()) == [("odd", 4), ("p", 7)]
    assert g.find_nodes(C.ge("age", 5.0), "odd").count() == 2
    assert rows(g.node_aggregate("age", ["sum", "count"], C.gt("age", 100.0))) == [(None, 0)]


def test_changes(g):
    assert g.delete_nodes(g.node(3)).edges.count() == 3
    assert g.add_label(C.eq("id", 2), "odd").with_label("odd").count() == 5
    assert g.remove_label(C.TRUE, "odd").with_label("odd").count() == 0


def test_neighbours_and_degrees(g):
    assert [r["id"] for r in g.neighbours(3).collect()] == [1, 2, 4, 5]
    assert dict(rows(g.degrees())) == {1: 2, 2: 2, 3: 4, 4: 2, 5: 3, 6: 1}


def test_traversal_and_paths(g):
    assert rows(g.distances([1]).select("id", "depth")) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)]
    assert [r["id"] for r in g.traverse(1, max_depth=3, node_where=C.gt("age", 4.5)).collect()] == [1, 5, 6]
    assert rows(g.shortest_path(1, 6)) == [([1, 3, 5, 6],)]
    assert g.shortest_path(1, 9).count() == 0
    assert rows(g.weighted_paths(1, 6)) == [([1, 3, 5, 6], 23.0)]
    assert rows(g.simple_paths(1, 5, 1, 3)) == [([1, 2, 3, 5],), ([1, 3, 4, 5],), ([1, 3, 5],)]
    assert A.a_star(g, 1, 6) == ([1, 3, 5, 6], 23.0)


def test_negative_weights_are_refused(g):
    bad = Graph(g.nodes, g.edges.withColumn("weight", F.lit(-1.0)))
    with pytest.raises(NegativeWeightError):
        bad.weighted_distances(1)


def test_patterns(g):
    two = Pattern([NodePattern("a"), NodePattern("b"), NodePattern("a")], [EdgePattern("e"), EdgePattern("f")])
    assert g.count_matches(two) == 14
    var = Pattern([NodePattern("a", where=C.eq("id", 1)), NodePattern("b")], [EdgePattern("p", least=1, most=2)])
    assert g.count_matches(var) == 6
    assert not g.has_match(Pattern([NodePattern("a"), NodePattern("b")], [EdgePattern(type="none")]))


def test_ranks_add_up(g):
    ranks = dict(rows(A.pagerank(g, rounds=15)))
    assert sum(ranks.values()) == pytest.approx(1)
    assert max(ranks, key=ranks.get) == 3


def test_centrality(g):
    assert dict(rows(A.betweenness(g))) == {1: 0, 2: 0, 3: 6, 4: 0, 5: 4, 6: 0, 9: 0}
    assert dict(rows(A.closeness(g)))[3] == pytest.approx(4.5 / 6)


def test_components_cores_triangles(g):
    assert dict(rows(A.connected_components(g))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 9}
    assert dict(rows(A.core_numbers(g))) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1, 9: 0}
    assert rows(A.triangles(g)) == [(1, 2, 3), (3, 4, 5)]
    assert A.transitivity(g) == pytest.approx(0.5)


def test_spanning_forest(g):
    forest = rows(A.spanning_forest(g))
    assert len(forest) == 5 and sum(w for *_, w in forest) == 33


def test_cut_nodes_and_bridges(g):
    parts = A.biconnected(g).cache()
    assert sorted(r["a"] for r in parts.where("kind = 'articulation'").collect()) == [3, 5]
    assert [(r["a"], r["b"]) for r in parts.where("kind = 'bridge'").collect()] == [(5, 6)]


def test_strong_components(spark, g):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    d = Graph(g.nodes, edges)
    assert dict(rows(A.strongly_connected(d)))[2] == 1
    assert rows(A.condensation(d)) == [(1, 4)]


def test_communities_stay_within_components(g):
    part = dict(rows(A.connected_components(g)))
    for found in (A.louvain(g), A.label_propagation(g, 4)):
        own = dict(rows(found))
        assert set(own) == set(part)
        assert all(part[own[k]] == part[k] for k in own)


def test_neighbour_similarity(g):
    scores = {(a, b): s for a, b, s in rows(A.neighbour_similarity(g, "common"))}
    assert scores[1, 2] == 1 and (1, 6) not in scores


def test_registered_centralities_take_all_sources(spark):
    from quarry import catalogue as Q

    d = "/root/testdata/sf0.01"
    g = Q.supplier_graph(spark, d)
    closeness, between = dict(rows(Q.QUERIES["graph_closeness"](spark, d))), dict(rows(Q.QUERIES["graph_betweenness"](spark, d)))
    assert set(closeness) == set(between) == {r["id"] for r in g.nodes.select("id").collect()}
    assert between == pytest.approx(dict(rows(A.betweenness(g))))


def _walked_graph(spark):
    """Three rings of 40 with chords, apart from each other, a pair and a node alone."""
    links = [(c * 100 + i, c * 100 + j) for c in range(3) for i in range(40) for j in {(i + 1) % 40, (i * 7 + 3) % 40} if i != j] + [(900, 901)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for link in links for x in link} | {999})], "id long")
    return Graph(nodes, spark.createDataFrame([(a, b, False) for a, b in links], "src long, dst long, directed boolean"))


def test_walks_from_all_nodes_store_no_pairs(spark, monkeypatch):
    from quarry.operators import graph as graph_module

    g, stored, settle = _walked_graph(spark), [], A.settle

    def counted(df, *name):
        out = settle(df, *name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(A, "settle", counted)
    monkeypatch.setattr(graph_module, "settle", counted)
    n_steps = 2 * A._links(g).count()
    for walk in (A.betweenness, A.closeness):
        assert walk(g).count() == g.nodes.count()
        assert max(stored) <= n_steps  # pairs are 40 * 40 a ring
        stored.clear()


def test_walks_are_the_same_dealt_to_tasks_and_by_rounds(spark, monkeypatch):
    g = _walked_graph(spark)
    whole = {walk: dict(rows(walk(g))) for walk in (A.betweenness, A.closeness)}
    pairs = {}
    for s, i, d in g.distances(g.nodes.select("id")).collect():
        pairs[s] = pairs.get(s, 0) + (1 / d if d else 0)
    assert whole[A.closeness] == pytest.approx({k: v / (g.nodes.count() - 1) for k, v in pairs.items()})
    for name, value in (("TASK_STEPS", 1000), ("MOST_KERNEL_EDGES", 50)):
        monkeypatch.setattr(A, name, value)
        for walk, want in whole.items():
            assert dict(rows(walk(g))) == pytest.approx(want)
