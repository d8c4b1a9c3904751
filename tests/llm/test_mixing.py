import hashlib
import math

from pyspark.sql import functions as F

from ashlar.llm import mixing


def test_poisson_inverts_the_distribution(spark):
    rows = [(u / 1000, lam) for u in range(0, 1000, 7) for lam in (0.0, 0.3, 1.0, 7.5, 120.0)]
    got = spark.createDataFrame(rows, "u double, lam double").select("u", "lam", mixing.poisson(F.col("u"), F.col("lam")).alias("k")).collect()
    for u, lam, k in got:
        term, total, want = math.exp(-lam), math.exp(-lam), 0
        while u >= total:
            want += 1
            term *= lam / want
            total += term
        assert k == want


def test_counts_reach_the_targets_and_ignore_the_partitioning(spark):
    rows = [(i, "s" + str(i % 3), f"text {i}", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    weights = spark.createDataFrame([("s0", 0.7), ("s1", 0.3)], "source string, weight double")
    mixed = mixing.mix_sources(df, weights=weights, size=5000)
    assert mixed.columns == ["doc_id", "source", "text", "copy", "copy_1", "rate", "mix_key"]
    n = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {"s0", "s1"} and abs(n["s0"] - 3500) < 6 * 3500**0.5 and abs(n["s1"] - 1500) < 6 * 1500**0.5
    again = mixing.mix_sources(df.repartition(7), weights=weights, size=5000)
    assert sorted(mixed.collect()) == sorted(again.collect())


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"s{i % 4}", None if i == 5 else f"t{i}") for i in range(200)], "doc_id long, source string, text string")
    plain = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == plain


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "a", "")], "doc_id long, source string, text string")
    rows = mixing.mix_sources(df).collect()
    assert sum(r.doc_id == 1 for r in rows) % 2 == 0
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_rates_of_any_size(spark):
    def inverse(u, lam):
        term = total = math.exp(-lam)
        k = 0
        while u >= total:
            k += 1
            term *= lam / k
            total += term
        return k

    def number(*parts):
        return int(hashlib.md5(":".join(map(str, (mixing.SEED, *parts))).encode()).hexdigest()[:13], 16) / 2**52

    rows = [(i, "common", f"text {i}") for i in range(300)] + [(1000 + i, "rare", f"rare {i}") for i in range(40)] + [(2000, None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("common", 3.0), ("rare", 600.0), (None, 25.0)], "source string, weight double")
    mixed = mixing.mix_sources(df, weights=weights, size=62800)
    got = {r.doc_id: r for r in mixed.groupBy("doc_id", "rate").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.countDistinct("mix_key").alias("keys")).collect()}
    rates = {"common": 1.0, "rare": 1500.0, None: 2500.0}
    for doc_id, source, text in rows:
        parts = max(1, math.ceil(rates[source] / mixing.PART_RATE))
        want = sum(inverse(number(doc_id, text, *[j] * (j > 1)), rates[source] / parts) for j in range(1, parts + 1))
        assert (doc_id in got) == (want > 0)
        if want:
            r = got[doc_id]
            assert (r.n, r.last, r.keys) == (want, want, want) and abs(r.rate - rates[source]) < 1e-9
    counts = [got[1000 + i].n for i in range(40)]
    mean = sum(counts) / 40
    assert abs(mean - 1500) < 5 * (1500 / 40) ** 0.5 and 0.4 < sum((n - mean) ** 2 for n in counts) / 39 / 1500 < 2.2
    assert abs(got[2000].n - 2500) < 5 * 50


def test_one_row_of_a_rare_source_beside_large_ones(spark):
    counts = spark.range(21).select(F.concat(F.lit("s"), "id").alias("source"))
    df = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("source") == "s20", 1).otherwise(2000))))
    weights = counts.withColumn("weight", F.when(F.col("source") == "s20", 936.0).otherwise(39064 / 20))
    got = {r.source: r.rate for r in mixing.source_rates(df, weights=weights, size=40000).collect()}
    assert abs(got["s20"] - 936) < 1e-6 and len(got) == 21


def test_names_that_clash(spark):
    names = ["own", "salt", "salted_as", "n", "copies", "__source", "__copies", "__salt", "rate", "copy", "mix_key"]
    df = spark.createDataFrame([(i, f"s{i % 2}", "t", *"abcdefghijk") for i in range(50)], ["doc_id", "source", "text", *names])
    got = mixing.mix_sources(df)
    assert got.columns == ["doc_id", "source", "text", *names, "copy_1", "rate_1", "mix_key_1"]
    assert {tuple(r)[2:14] for r in got.collect()} == {("t", *"abcdefghijk")}


def test_sql_counts_as_far_as_the_largest_rate(spark, tmp_path):
    import duckdb

    from ashlar.llm.oracles import OP3

    rows = [(i, "common", f"text {i}") for i in range(5000)] + [(9000, "rare", "alone"), (9001, None, "no source"), (9002, "common", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted((r.doc_id, str(r.source), str(r.text), r.copy, r.mix_key) for r in mixing.mix_sources(df).collect())
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = sorted((r[0], str(r[1]), str(r[2]), r[3], r[4]) for r in con.sql(f"SELECT doc_id, source, text, copy, mix_key FROM ({OP3})").fetchall())
    assert got == want and max(r[3] for r in got) > 60


def test_a_very_long_text(spark):
    long = "word " * 1_000_000
    df = spark.createDataFrame([(1, "a", long), (2, "a", "x"), (3, "b", None)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    rows = mixing.mix_sources(df, weights=weights, size=20).collect()
    assert {r.doc_id for r in rows} == {1, 2} and all(r.text == (long if r.doc_id == 1 else "x") and r.rate == 10.0 for r in rows)
