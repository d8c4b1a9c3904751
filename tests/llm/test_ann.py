import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import ann
from ashlar.llm.queries import op7_nearest_neighbours


def exact(vectors, asked, k):
    out = {}
    for q, x in asked:
        near = {}
        for v, y in vectors:
            if v != q:
                s = float((np.array(y) * np.array(x)).sum() / (math.sqrt((np.array(x) ** 2).sum()) * math.sqrt((np.array(y) ** 2).sum())))
                near[v] = max(near.get(v, -9), s)
        out[q] = sorted(near.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_small_tables_are_exact_and_odd_vectors_take_no_part(spark):
    random.seed(1)
    vectors = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)] + [(3, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0])]
    odd = [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (305, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(v, x, 0) for v, x in vectors + odd], "vec_id long, embedding array<double>, rank int").repartition(3)
    asked = [(v, x) for v, x in vectors if v % 10 == 0]
    got = ann.search(df, df.where("vec_id % 10 = 0")).collect()
    want = exact(vectors, asked, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    for q in want:
        assert [v for v, _ in found[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=1e-12)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.search(df.limit(0), df).collect() == [] == ann.search(df, df.limit(0)).collect()


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_against_brute_force(spark, clusters, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 24))
    if clusters:
        x = 0.3 * x + rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 6000)]
    x[100:400] = x[100]
    monkeypatch.setattr(ann, "CHUNK_ROWS", 500)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id % 50 = 0"), sample=3000).groupBy("query_id").agg(F.collect_list("vec_id").alias("near")).collect()
    u = ann._unit(x)
    hits = 0
    for r in got:
        near = u @ u[r.query_id]
        near[r.query_id] = -9
        edge = np.sort(near)[-5]
        hits += sum(near[v] >= edge - 1e-12 for v in r.near)
    assert len(got) == 120 and hits >= 0.9 * 5 * 120


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(3)
    graph = ann.neighbours(ann._unit(rng.normal(size=(1000, 8)) + rng.normal(size=(10, 8))[np.arange(1000) % 10] * 4), 8)
    label = ann.partition_graph(graph, 5)
    size = np.bincount(label, minlength=5)
    assert size.max() <= 1.06 * 200 and (label[graph] == label[:, None]).mean() > 0.7


def test_query_recall(spark, sf_dir):
    got = op7_nearest_neighbours(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact([tuple(r) for r in rows], [tuple(r) for r in rows if r.vec_id % 50 == 0], 5)
    assert sum((r.vec_id in dict(want[r.query_id])) for r in got) >= 0.9 * sum(map(len, want.values()))


def test_queries_whose_parts_hold_too_little_look_everywhere(spark, monkeypatch):
    # ids repeat, so whole parts may hold one id only
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 8)) * 0.05 + np.eye(8)[i] for i in range(4)])
    ids = [int(i // 2000) if i % 2000 else 100 + i for i in range(8000)]
    df = spark.createDataFrame([(v, e.tolist()) for v, e in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.where("vec_id = 2100"), recall=0.01).collect()
    assert len(got) == 5 and len({r.vec_id for r in got}) == 5 and {r.vec_id for r in got} <= {0, 1, 2, 3, 100, 4100, 6100}


def test_recall_with_the_router_at_work(spark):
    """20,000 vectors with clusters, one of which holds a third, by the operator as the query calls it."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 64))
    label = np.where(rng.random(20_000) < 1 / 3, 0, rng.integers(0, 60, 20_000))
    x = (rng.normal(size=(20_000, 64)) * 0.6 + centre[label]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, df.where("vec_id % 50 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("near")).collect()
    u, hits = ann._unit(x.astype(np.float64)), 0
    for r in got:
        near = u @ u[r.query_id]
        near[r.query_id] = -9
        edge = np.sort(near)[-5]
        hits += sum(near[v] >= edge - 1e-12 for v in r.near)
    print("recall", hits / (5 * 400))
    assert len(got) == 400 and hits >= 0.9 * 5 * 400


def test_recall_where_not_all_parts_are_probed(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = op7_nearest_neighbours(spark, sf_dir).collect()
    assert all(r.n_probed < r.n_parts for r in got)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact([tuple(r) for r in rows], [tuple(r) for r in rows if r.vec_id % 50 == 0], 5)
    found = sum((r.vec_id in dict(want[r.query_id])) for r in got)
    print("recall", found / sum(map(len, want.values())), got[0].n_probed, "of", got[0].n_parts)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_clusters_take_few_parts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32)) * 0.2 + rng.normal(size=(64, 32))[np.arange(6000) % 64]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    r = ann.search(df, df.where("vec_id % 50 = 0")).first()
    assert r.n_parts == 32 and r.n_probed <= 8
