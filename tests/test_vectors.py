import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import encoding as E
from quarry.functions import geo, text
from quarry.functions import vectors as V
from quarry.operators import conditions as C
from quarry.operators import services
from quarry.operators import vector_search as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def items(spark):
    data = [(i, [float(np.sin(i * 8 + j)) for j in range(8)], i % 3) for i in range(40)]
    data += [(100, [0.0] * 8, 0), (101, [1.0] * 3, None)]
    return spark.createDataFrame(data, "key long, embedding array<float>, kind int")


@pytest.mark.parametrize("metric", V.METRICS)
def test_search_matches_numpy(items, metric):
    q = [float(np.sin(16 + j)) for j in range(8)]
    found = S.search(items, q, 5, metric).collect()
    assert len(found) == 5
    if metric in ("cosine", "dot_product", "euclidean", "manhattan"):
        m = {r["key"]: np.array(r["embedding"], float) for r in items.where("key < 101").collect()}
        f = {"cosine": lambda v: v @ q / (np.linalg.norm(v) * np.linalg.norm(q) or 1), "dot_product": lambda v: v @ q, "euclidean": lambda v: 1 / (1 + np.linalg.norm(v - q)), "manhattan": lambda v: 1 / (1 + np.abs(v - q).sum())}[metric]
        best = sorted(m, key=lambda k: (-f(m[k]), k))[:5]
        assert [r["key"] for r in found] == best
        assert [r["score"] for r in found] == pytest.approx([f(m[k]) for k in best], abs=1e-6)


def test_zero_queries_filters_and_thresholds(items):
    assert S.search(items, [0.0] * 8, 5).count() == 0
    assert S.search(items, [0.0] * 8, 5, "euclidean").count() == 5
    assert {r["kind"] for r in S.search(items, [1.0] * 8, 9, where=C.eq("kind", 1)).collect()} == {1}
    assert all(r["score"] >= 0.2 for r in S.search(items, [1.0] * 8, 50, threshold=0.2).collect())
    assert 2 not in [r["key"] for r in S.search_by_key(items, 2, 5).collect()]


def test_inverted_file_over_all_lists_is_exact(items):
    rows8 = items.where("key < 100")
    q = [1.0, 0.5] * 4
    index = S.inverted_file(rows8, 4)
    assert [r["key"] for r in index.search(q, 6, nprobe=4).collect()] == [r["key"] for r in S.search(rows8, q, 6).collect()]


def test_sparse_round_trip(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, -1.0],)], "v array<double>")
    s = V.to_sparse(F.col("v"))
    r = df.select(V.to_dense(s).alias("d"), V.sparse_dot(s, s).alias("dot"), V.to_dense(V.sparse_subtract(s, s)).alias("zero"), V.sparsity(F.col("v")).alias("sp")).first()
    assert (r["d"], r["dot"], r["zero"], r["sp"]) == ([0.0, 2.0, 0.0, -1.0], 5.0, [0.0] * 4, 0.5)


def test_quantisation_stays_close(items):
    back = V.dequantize_u8(V.quantize_u8(F.col("embedding")))
    assert items.where("key < 100").select(F.min(V.cosine(F.col("embedding"), back))).first()[0] > 0.999


def test_upsert_takes_the_last(spark, items):
    new = spark.createDataFrame([(1, [9.0], 1, 1), (1, [8.0], 1, 2)], "key long, embedding array<float>, kind int, seq int")
    out = S.upsert(items.withColumn("seq", F.lit(0)), new, order="seq")
    assert out.where("key = 1").first()["embedding"] == [8.0]


def test_tokens_and_search(spark):
    df = spark.createDataFrame([(1, "The Quick-brown fox"), (2, "Köln, quack!"), (3, None)], "id long, t string")
    words = text.tokens(F.col("t"), 3)
    assert [r[0] for r in df.where(text.has_all(words, ["QUICK", "fox"])).select("id").collect()] == [1]
    assert sorted(r[0] for r in df.where(text.has_prefix(words, "qu")).select("id").collect()) == [1, 2]
    assert sorted(r[0] for r in df.where(text.has_near(words, "quick", 2)).select("id").collect()) == [1, 2]


def test_haversine(spark):
    df = spark.createDataFrame([(1, 52.52, 13.405), (2, 48.8566, 2.3522)], "id long, lat double, lon double")
    near = geo.within_radius(df, "lat", "lon", (52.52, 13.405), 880).collect()
    assert [r["id"] for r in near] == [1, 2] and near[1]["distance_km"] == pytest.approx(877.5, abs=1)


def test_encodings(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabbba")], "g int, at int, v string")
    runs = E.run_lengths(df, ["g"], "at", "v")
    assert rows(runs.select("run", "v", "run_length")) == [(0, "a", 2), (1, "b", 3), (2, "a", 1)]
    assert E.run_expand(runs).count() == 6
    nums = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 9, 9, 300])], "g int, at int, n long")
    d = E.delta_encode(nums, ["g"], "at", "n")
    assert [r["delta"] for r in d.orderBy("at").collect()] == [5, 4, 0, 291]
    assert [r["value"] for r in E.delta_decode(d, ["g"], "at").orderBy("at").collect()] == [5, 9, 9, 300]
    a = spark.createDataFrame([([0, 127, 128, 1 << 40],)], "a array<long>").withColumn("b", E.varint(F.col("a")))
    assert a.select(E.unvarint(F.col("b"))).first()[0] == [0, 127, 128, 1 << 40]


def test_tensor_train():
    v = np.sin(np.arange(64.0))
    cores = E.tt_cores(v, (4, 4, 4), 8)
    assert np.allclose(E.tt_vector(cores), v)
    assert E.tt_dot(cores, cores) == pytest.approx(v @ v)
    assert E.tt_cosine(cores, cores) == pytest.approx(1)


def test_pairs_of_all_rows_block_by_block(spark, monkeypatch):
    r = np.random.default_rng(6)
    v = r.normal(size=(120, 6)).round(3)
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, embedding array<double>")
    n = np.linalg.norm(v, axis=1)
    n[7] = 1
    cos = (v @ v.T) / n[:, None] / n[None, :]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if cos[i, j] >= 0.8}
    for size in (2048, 17):
        monkeypatch.setattr(S, "BLOCK_ROWS", size)
        found = S.near_pairs(df, 0.8).collect()
        assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
        assert all(abs(r["score"] - cos[r["a"], r["b"]]) < 1e-9 for r in found)
        np.fill_diagonal(cos, -2)
        best = cos.argmax(1)
        pairs = {(min(i, b), max(i, b)) for i, b in enumerate(best.tolist()) if cos[i, b] >= 0.5}
        assert {(r["a"], r["b"]) for r in services.nearest_other(df, 0.5).collect()} == pairs
        np.fill_diagonal(cos, 1)
    near = {(r["a"], r["b"]) for r in S.near_pairs(df, 0.8, approximate=True).collect()}
    assert near <= want and len(near) >= 0.9 * len(want)


def test_product_codes_are_the_nearest(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(40, 4))
    pq = S.ProductQuantizer(r.normal(size=(2, 5, 2)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, embedding array<double>")
    for row in pq.encode(df).collect():
        parts = np.asarray(row["embedding"]).reshape(2, 2)
        assert row["codes"] == [int(((pq.books[p] - parts[p]) ** 2).sum(1).argmin()) for p in range(2)]


def test_nearest_other_lists_a_pair_once(spark, monkeypatch):
    # the products of blocks of different sizes differ in the last bit by direction
    exact, calls = S.cosines, []

    def uneven(left, right):
        calls.append(0)
        return exact(left, right) + (len(calls) % 2) * 1e-16 * 4

    monkeypatch.setattr(services, "cosines", uneven)
    monkeypatch.setattr(services, "each_block_pair", _both_blocks_here)
    df = spark.createDataFrame([(1, [1.0, 0.5]), (2, [1.0, 0.4])], "key long, embedding array<double>")
    assert [(r["a"], r["b"]) for r in services.nearest_other(df, 0.5).collect()] == [(1, 2)]


def _both_blocks_here(rows, run, schema):
    """each_block_pair with a block for each of two rows, on the driver."""
    pdf = rows.toPandas()
    return rows.sparkSession.createDataFrame(run(pdf[:1], pdf[1:], False), schema)


def test_sparse_operations_of_many_rows(spark):
    r = np.random.default_rng(9)
    a, b = (np.where(r.random((300, 40)) < 0.3, r.normal(size=(300, 40)).round(2), 0) for _ in range(2))
    b[:5] = a[:5]
    a[7] = 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(300, [], []), (301, None, [1.0])], "key long, a array<double>, b array<double>")
    s, t = V.to_sparse(F.col("a")), V.to_sparse(F.col("b"))
    want = {"add": a + b, "sub": a - b, "scale": a * 3.0, "mean": (a * 1.0 + b * 3.0) / 4.0, "prune": np.where(np.abs(a) >= 0.5, a, 0)}
    found = {"add": V.sparse_add(s, t), "sub": V.sparse_subtract(s, t), "scale": V.sparse_scale(s, 3.0), "mean": V.sparse_weighted(s, t, 1.0, 3.0), "prune": V.sparse_prune(s, 0.5)}
    out = df.select("key", V.sparse_dot(s, t).alias("dot"), *[c.alias(n) for n, c in found.items()], *[V.to_dense(c).alias(f"{n}_d") for n, c in found.items()]).orderBy("key").collect()
    for n, w in want.items():
        assert all(row[f"{n}_d"] == v.tolist() for row, v in zip(out, w, strict=False))
        assert all(row[n]["pos"] == np.flatnonzero(v).tolist() and row[n]["dim"] == 40 for row, v in zip(out, w, strict=False))
        assert out[300][f"{n}_d"] == [] and out[301][f"{n}_d"] is None
    assert [row["dot"] for row in out[:300]] == pytest.approx((a * b).sum(1).tolist()) and out[300]["dot"] == 0 and out[301]["dot"] is None


def test_chained_sparse_operations_are_not_repeated(spark):
    df = spark.createDataFrame([([0.0, 2.0],)], "v array<double>").withColumn("s", V.to_sparse(F.col("v")))
    back = df.select(V.to_dense(V.sparse_subtract(V.sparse_scale(F.col("s"), 3.0), V.sparse_add(F.col("s"), F.col("s")))).alias("v"))
    assert back.first()["v"] == [0.0, 2.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "map_zip_with" not in plan and len(plan) < 20_000


def test_rows_are_sent_to_few_tasks_and_every_pair_is_classed(spark):
    r = np.random.default_rng(10)
    v = r.normal(size=(230, 5)).round(1)
    v[r.random(v.shape) < 0.5] = 0
    v[100:120], v[120:140] = v[:20], -v[:20]
    keys = [None if i % 50 == 49 else sorted({i % 3, i % 4} if i % 20 else {1}) for i in range(230)]
    df = spark.createDataFrame([(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, keys, strict=True))], "id long, v array<double>, keys array<long>")
    n = np.linalg.norm(v, axis=1)
    want = {}
    for i in range(230):
        for j in range(i + 1, 230):
            c = v[i] @ v[j] / (n[i] * n[j]) if n[i] * n[j] else 0.0
            both, either = np.count_nonzero((v[i] != 0) & (v[j] != 0)), np.count_nonzero((v[i] != 0) | (v[j] != 0))
            alike, a, b = not either or both / either >= 0.5, set(keys[i] or ()), set(keys[j] or ())
            rules = [c >= 0.99 and a == b, c <= -0.95 and a == b, abs(c) < 0.1 and not alike, c >= 0.7 or alike, bool(a & b), True]
            want[i, j] = services.CLASSES[rules.index(True)]
    assert {(r["a"], r["b"]): r["class"] for r in services.delta_conflicts(df).collect()} == want
    counts = {c: list(want.values()).count(c) for c in set(want.values())}
    assert {r["class"]: r["n"] for r in services.conflict_counts(df).collect()} == counts and len(counts) == 6
    # cut into parts of 7 rows, but no row is sent to 33 tasks
    pairs = S.each_block_pair(df.select("id"), lambda x, y, same: pd.DataFrame({"n": [len(x) * (len(x) - 1) // 2 if same else len(x) * len(y)]}), "n long", 7)
    assert pairs.agg(F.sum("n")).first()[0] == 230 * 229 // 2
    assert f", {S.TASK_BLOCKS}) as int) AS _b" in pairs._jdf.queryExecution().optimizedPlan().toString()
