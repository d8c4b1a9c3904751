import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ashlar.functions import bitvec as V
from ashlar.functions import truth
from ashlar.operators import bundle, search


def words(text):
    out = [int.from_bytes(hashlib.sha256(f"{text}:{i}".encode()).digest()[:8], "little") for i in range(157)]
    return [*out[:156], out[156] & 0xFFFF]


def number(text):
    return sum(w << (64 * i) for i, w in enumerate(words(text)))


def signed(ws):
    return [w - (1 << 64) if w >> 63 else w for w in ws]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_seeded_fingerprints(spark):
    r = one(spark, V.fp_seed(F.lit("a")).alias("a"), V.popcount(V.fp_seed(F.lit("a"))).alias("n"), V.to_hex(V.fp_seed(F.lit("a"))).alias("h"), V.hamming(V.fp_seed(F.lit("a")), V.fp_seed(F.lit("b"))).alias("d"))
    assert r.a == signed(words("a")) and r.n == 5077 and r.h.startswith("0ed32d3352f0cddd") and len(r.h) == 2500 and r.d == 5017
    assert one(spark, V.fp_seed(F.lit(None).cast("string")).alias("x")).x is None


def test_codecs(spark):
    v = V.fp_seed(F.lit("test"))
    r = one(spark, v.alias("v"), V.from_bytes(V.to_bytes(v)).alias("b"), V.from_hex(V.to_hex(v)).alias("h"), F.octet_length(V.to_bytes(v)).alias("n"), F.octet_length(V.fp_tile(F.lit("x"))).alias("tile"))
    assert r.v == r.b == r.h and r.n == r.tile == 1250
    with pytest.raises(Exception, match="1250"):
        one(spark, V.from_hex(F.lit("00ff")))


def test_algebra(spark):
    a, b, c = (V.fp_seed(F.lit(x)) for x in "abc")
    r = one(spark, V.popcount(V.xor(a, a)).alias("zero"), V.xor(V.xor(a, b), b).alias("back"), V.majority3(a, b, c).alias("m3"), V.bundle_array(F.array(a, b, c)).alias("m"), V.similarity(V.majority3(a, b, c), a).alias("s"), V.zero_words(a, a).alias("z"), V.bundle2(a, b).alias("and2"), V.index32(a).alias("i"))
    assert r.zero == 0 and r.back == signed(words("a")) and r.m3 == r.m and abs(r.s - 0.7425) < 1e-9 and r.z == 157
    assert r.and2 == signed([x & y for x, y in zip(words("a"), words("b"), strict=True)]) and r.i == words("a")[0] & 0xFFFFFFFF


def test_bits(spark):
    v = V.fp_seed(F.lit("a"))
    places = [0, 1, 63, 64, 127, 5000, 9999]
    r = one(spark, F.array(*[V.get_bit(v, F.lit(i)) for i in places]).alias("got"), V.get_bit(V.set_bit(v, F.lit(127)), F.lit(127)).alias("on"), V.get_bit(V.set_bit(v, F.lit(63), False), F.lit(63)).alias("off"))
    assert r.got == [bool(number("a") >> i & 1) for i in places] and r.on and not r.off


def test_regions_and_segments(spark):
    x, y = (b"".join(w.to_bytes(8, "little") for w in words(k))[:1250] for k in "ab")
    bits = lambda data, s, e: "".join(f"{v:08b}" for v in data)[s:e]
    spans = [(0, 10000), (3334, 6667), (5, 7), (16, 24)]
    r = one(spark, *[V.region_similarity(F.lit(x), F.lit(y), s, e).alias(f"r{i}") for i, (s, e) in enumerate(spans)], V.segment_score(F.lit(x), F.lit(y)).alias("score"))
    for i, (s, e) in enumerate(spans):
        assert abs(r[f"r{i}"] - (1 - sum(p != q for p, q in zip(bits(x, s, e), bits(y, s, e), strict=True)) / (e - s))) < 1e-9
    h = [sum((p ^ q).bit_count() for p, q in zip(x[31 * k : 31 * k + 31], y[31 * k : 31 * k + 31], strict=True)) for k in range(40)]
    mean = sum(h) / 40
    assert abs(r.score - (sum(h) / 1000 + sum((v - mean) ** 2 for v in h) / 40 / 100 + max(h) / 50)) < 1e-9


def test_bundles_of_groups_match_arrays(spark):
    random.seed(2)
    rows = [(g, f"{g}/{i}") for g in "xyz" for i in range(random.randint(1, 9))]
    df = spark.createDataFrame(rows, "g string, name string").withColumn("fp", V.fp_seed(F.col("name"))).repartition(3)
    whole = df.groupBy("g").agg(F.collect_list("fp").alias("v")).select("g", V.bundle_array(F.col("v")).alias("fp"))
    got = {r.g: r.fp for r in bundle.majority(df, "g").collect()}
    assert got == {r.g: r.fp for r in whole.collect()}
    x = {r.g: r.fp for r in bundle.xor_reduce(df, "g").collect()}
    for g in "xyz":
        n = 0
        for k, name in rows:
            n ^= number(name) if k == g else 0
        assert x[g] == signed([n >> 64 * i & (1 << 64) - 1 for i in range(157)])


def test_searches(spark, monkeypatch):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["other", "query", "a", "b", "query"])], "idx long, name string").withColumn("fp", V.fp_seed(F.col("name")))
    q = V.fp_seed(F.lit("query"))
    got = search.resonate(df, q, 0.5).collect()
    assert [(r.idx, round(r.similarity, 4)) for r in got][:4] == [(1, 1.0), (4, 1.0), (3, 0.5111), (0, 0.5021)]
    assert [r.idx for r in search.knn(df, q, 2).collect()] == [1, 4] and search.clean_up(df, q).first().idx == 1
    assert 1 not in [r.idx for r in search.find_similar(df, q, 5, exclude=1).collect()]
    assert [(r.n, r.first) for r in search.duplicates(df).collect()] == [(2, 1)]
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    joined = search.knn_join(df.withColumnRenamed("idx", "query_id"), df, 2).collect()
    assert sorted((r.query_id, r.idx) for r in joined if r["rank"] == 1) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 1)]
    two = df.select("idx", V.to_bytes(F.col("fp")).alias("fp_bytes"))
    assert search.two_stage(two, V.to_bytes(q), 100, 1).first().idx == 1


def test_truth(spark):
    r = one(spark, truth.revision(truth.truth(1, 0.95), truth.truth(1, 0.8)).alias("t"), truth.expectation(truth.truth(1, 0.9)).alias("e"), truth.revision(truth.truth(1, 0), truth.truth(0, 0)).alias("none"))
    assert (r.t.frequency, round(r.t.confidence, 5), round(r.e, 6)) == (1.0, 0.63636, 0.95) and tuple(r.none) == (0.5, 0.0)


def test_projection(spark):
    import numpy as np

    from ashlar.functions.project import fp_project

    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 1024)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, None), (6, [])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", fp_project(F.col("v")).alias("p")).collect()}
    plane = np.random.RandomState(42).randn(10000, 1024).astype(np.float32) / 32
    for i, v in enumerate(x):
        differ = np.unpackbits(np.frombuffer(got[i], np.uint8)) != (plane @ v > 0)
        assert len(got[i]) == 1250 and differ.sum() <= 2  # sums near zero may round to either side
    assert got[5] is None and got[6] is None


def test_projected_search_against_numpy(spark, sf_dir):
    import numpy as np

    from ashlar import queries

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32)
    plane = np.random.RandomState(42).randn(10_000, x.shape[1]).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))
    bits = (x @ plane.T > 0).astype(np.int32)
    same = bits @ bits.T + (1 - bits) @ (1 - bits).T
    near = sorted((-same[0, j], j) for j in range(len(x)))[:5]
    got = queries.QUERIES["project_embeddings_knn"](spark, sf_dir).collect()
    assert [r.idx for r in got] == [j for _, j in near] and all(abs(r.similarity + n / 10_000) < 1e-6 for r, (n, _) in zip(got, near, strict=True))
    df = spark.createDataFrame([(i, x[i % 40].tolist() if i < 80 else (x[i % 40] + 0.02 * x[(i + 1) % 40]).tolist()) for i in range(120)], "idx long, e array<float>")
    from ashlar.functions import project

    b = np.array([x[i % 40] if i < 80 else x[i % 40] + np.float32(0.02) * x[(i + 1) % 40] for i in range(120)], dtype=np.float32) @ plane.T > 0
    like = (b[:, None, :] == b[None, :, :]).sum(2)
    found = {(r.a, r.b): r.similarity for r in search.similar_pairs(df.select("idx", V.from_bytes(project.fp_project(F.col("e"))).alias("fp")), 0.9).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if like[i, j] >= 9000}
    copies = {(i, i + 40) for i in range(40)}  # a copy is linked to its first row only
    assert copies <= set(found) and all(min(p) >= 0 and like[p] >= 8999 for p in found)
    assert {(i % 40, j % 40) for i, j in want} == {(i % 40, j % 40) for i, j in found}


def test_state_vectors_against_numpy(spark):
    import numpy as np

    from ashlar.functions import project

    rows = spark.createDataFrame([(0.7, 0.2, "calm"), (-0.5, 0.0, ""), (0.0, -1.0, None)], "t double, s double, q string").select(project.encode_state(F.col("t"), F.col("s"), F.col("q")).alias("v"))
    got = rows.select("v", project.decode_state(F.col("v")).alias("b")).collect()
    time = np.random.RandomState(42).randn(3334) > 0
    assert (np.unpackbits(np.frombuffer(bytes(got[0].v), np.uint8))[:3334] == time).all() and (np.unpackbits(np.frombuffer(bytes(got[1].v), np.uint8))[:3334] == ~time).all()
    assert [r.b.tau and round(r.b.tau, 6) for r in got] == [1.0, -1.0, None] and [r.b.sigma and round(r.b.sigma, 6) for r in got] == [1.0, None, None] or got[2].b.sigma == 0.0


def test_large_query_tables_are_matched_in_blocks(spark, monkeypatch):
    from ashlar.functions import project

    df = project.seeded(spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("n"), "id").alias("name")), "name")
    one = search.knn_join(df.withColumnRenamed("idx", "query_id"), df, 4).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "CHUNK_ROWS", 11)
    assert sorted(search.knn_join(df.withColumnRenamed("idx", "query_id"), df, 4).collect()) == sorted(one) and len(one) == 240


def test_lists_and_functions(spark):
    def sample(a, b=1):
        return a + b

    text = V.callable_text(sample)
    assert text.startswith("sample::(a, b=1)::") and "return a + b" in text
    r = one(spark, V.hamming(V.encode_list(F.array(F.lit("a"), F.lit("b"))), V.encode_list(F.array(F.lit("b"), F.lit("a")))).alias("turned"), V.popcount(V.random_words(F.lit(5))).alias("n"), V.hamming(V.random_words(F.lit(5)), V.random_words(F.lit(6))).alias("far"))
    assert 4700 < r.turned < 5300 and 4700 < r.n < 5300 and 4700 < r.far < 5300


def test_projection_of_a_large_batch_takes_bounded_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from ashlar.functions import project

    x = np.random.default_rng(4).standard_normal((4000, 16)).astype(np.float32)
    want = np.packbits(x @ project.matrix(16).T > 0, axis=1)
    tracemalloc.start()
    (got,) = project._projected.func(iter([pd.Series(list(x))]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [bytes(w) for w in want] == list(got)
    assert peak < 80_000_000  # products of all rows at once take 160 MB


def test_correlation_of_bits_is_exact_at_its_ends():
    import numpy as np

    from ashlar.functions import project

    for base in project._bases()[:2]:
        bits = base.astype(np.uint8)
        assert project._correlation(bits, base) == 1.0 and project._correlation(1 - bits, base) == -1.0
        assert project._correlation(0 * bits, base) is None and project._correlation(0 * bits + 1, base) is None
        other = np.random.default_rng(1).integers(0, 2, len(base), dtype=np.uint8)
        assert abs(project._correlation(other, base) - np.corrcoef(other, base)[0, 1]) < 1e-12
