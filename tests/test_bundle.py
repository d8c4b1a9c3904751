import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.functions import bitvec as V
from ashlar.functions import project
from ashlar.operators import bundle


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 64, 1000])
def test_planes_count_and_compare(n):
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (n, V.WORDS * 64), dtype=np.uint8)
    x = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, V.WORDS)
    unpacked = lambda w: np.unpackbits(w.view(np.uint8), bitorder="little")
    total = lambda planes: sum((unpacked(p).astype(int) << k for k, p in enumerate(planes)), np.zeros(V.WORDS * 64, dtype=int))
    planes, sums = bundle.planes_of(x), bits.sum(axis=0, dtype=int)
    assert (total(planes) == sums).all() and len(planes) <= max(1, n).bit_length()
    cut = n // 3
    assert (total(bundle.added(bundle.planes_of(x[:cut]), bundle.planes_of(x[cut:]))) == sums).all()
    for most in (0, 1, n // 2, n, 3 * n + 1):
        assert (unpacked(bundle.over(planes, most)) == (sums > most)).all()


def test_one_group_over_many_tasks_and_many_small_ones(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 < 3, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), V.random_words(F.col("id")).alias("fp"))
    df = df.unionByName(spark.createDataFrame([("null", None), (None, None)], "g string, fp array<long>")).repartition(40)
    rows = df.where("fp IS NOT NULL").collect()
    got = {r.g: (r.n, r.fp) for r in bundle.majority(df, "g").collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r.fp)
    assert set(got) == set(groups)
    for g, vectors in groups.items():
        bits = np.unpackbits(np.array(vectors, dtype=np.int64).view(np.uint8), axis=1, bitorder="little")
        want = np.packbits(2 * bits.sum(axis=0, dtype=int) > len(vectors), bitorder="little").view(np.int64)
        assert got[g][0] == len(vectors) and (np.array(got[g][1]) == want).all()


def test_selection_of_any_numbers(spark):
    rng = np.random.default_rng(3)
    columns = [rng.normal(size=501), rng.integers(-3, 3, 501).astype(float), np.full(501, -0.0), np.where(rng.random(501) < 0.5, np.inf, -np.inf), rng.normal(size=501) * 1e-310, np.repeat(rng.normal(size=3) * 1e300, 167)]
    rows = np.stack(columns, axis=1)
    data = [([float(v) if v is not None else None for v in r],) for r in rows] + [(None,), ([None, 5.0, None],), ([],)]
    df = spark.createDataFrame(data, "e array<double>").repartition(5)
    ranks = lambda n: [0, (n - 1) // 2, n // 2, n - 1]
    got = project.order_statistics(df, "e", ranks)
    for d, c in enumerate(columns):
        c = np.sort(np.append(c, 5.0) if d == 1 else c)
        assert got[d] == [c[k] for k in ranks(len(c))]
    assert project.order_statistics(df.limit(0), "e", ranks) == {}


def test_binarized_at_medians(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<float>")
    got = {r.id: r.bits for r in project.binarized(df, "e").collect()}
    medians = np.median(x.astype(float), axis=0)
    assert all(got[i] == (x[i].astype(float) > medians).tolist() for i in range(300))
