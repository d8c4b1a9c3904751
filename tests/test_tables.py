import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ashlar.functions import bitvec as V
from ashlar.operators import mining
from ashlar.plans import sqlfunctions
from ashlar.sources import pysource, tables


def test_upsert_leaves_untouched_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}") for i in range(400)], "id long, v string")
    table = tables.BucketedTable.create(rows, f"{tmp_path}/t", ["id"], 16)
    before = table.files()
    touched = table.upsert(spark.createDataFrame([(5, "new"), (1000, "added"), (None, "null key")], "id long, v string"))
    after = table.files()
    assert 1 <= len(touched) <= 3
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept == before & after and all(f.startswith("v=1/") for f in after - kept)
    want = {i: f"a{i}" for i in range(400)} | {5: "new", 1000: "added", None: "null key"}
    assert {r.id: r.v for r in table.read().collect()} == want
    table.upsert(spark.createDataFrame([(None, "again")], "id long, v string"))
    again = tables.BucketedTable(spark, f"{tmp_path}/t")
    assert {r.id: r.v for r in again.read().collect()} == want | {None: "again"} and again.version == 2
    assert table.upsert(rows.limit(0)) == [] and tables.BucketedTable(spark, f"{tmp_path}/t").read().count() == 402


def test_two_writers_and_a_write_that_broke_off(spark, tmp_path):
    rows = spark.createDataFrame([(i, i) for i in range(50)], "id long, v long")
    one = tables.BucketedTable.create(rows, f"{tmp_path}/t", ["id"], 4)
    two = tables.BucketedTable(spark, f"{tmp_path}/t")
    one.upsert(rows.where("id = 1").withColumn("v", F.lit(10).cast("long")))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        two.upsert(rows.where("id = 2").withColumn("v", F.lit(20).cast("long")))
    assert {r.id: r.v for r in tables.BucketedTable(spark, f"{tmp_path}/t").read().collect()} == {i: 10 if i == 1 else i for i in range(50)}


def test_lookup_opens_only_files_that_may_hold_the_key(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") * 3).alias("k"), F.col("id").alias("v")).repartition(5)
    tables.write_clustered(rows, f"{tmp_path}/c", "k", 10)
    found, files = tables.looked_up(spark, f"{tmp_path}/c", "k", [300])
    assert [(r.k, r.v) for r in found.collect()] == [(300, 100)] and len(files) == 1
    found, files = tables.looked_up(spark, f"{tmp_path}/c", "k", [3, 5997, 10**9])
    assert sorted(r.v for r in found.collect()) == [1, 1999] and len(files) == 2
    found, files = tables.looked_up(spark, f"{tmp_path}/c", "k", [-5])
    assert found.collect() == [] == files
    tables.write_clustered(rows.limit(0), f"{tmp_path}/e", "k", 3)
    assert tables.looked_up(spark, f"{tmp_path}/e", "k", [1])[0].collect() == []


def test_itemsets_against_every_subset(spark):
    rng = random.Random(2)
    baskets = [[x for x in "abcdefgh" if rng.random() < 0.4] * rng.choice([1, 2]) for _ in range(200)]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], "seq string, items array<string>").repartition(3)
    for least in (1, 12, 30):
        want = {}
        for size in (2, 3, 4):
            for c in combinations("abcdefgh", size):
                n = sum(set(c) <= set(b) for b in baskets)
                if n >= least:
                    want[c] = n
        assert {tuple(r["items"]): r["n"] for r in mining.frequent_itemsets(df, least).collect()} == want
    assert mining.frequent_itemsets(df.limit(0), 2).collect() == []


def test_sketches_of_all_columns(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.5, 2.5, 3.5]), "hot" if i % 3 == 0 else f"v{i}", None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, x double, `odd.name` string, none string").repartition(8)
    got = {r.column_name: r for r in mining.table_stats(df).collect()}
    assert {c: (r.n, r.nulls) for c, r in got.items()} == {c: (sum(x[i] is not None for x in rows), sum(x[i] is None for x in rows)) for i, c in enumerate(df.columns)}
    assert abs(got["id"].distinct_about - 30_000) < 4 * 1.04 / 2**7 * 30_000 and got["x"].distinct_about == 3
    assert all(abs(q - want) <= 30_000 / 10_000 + 1 for q, want in zip(got["id"].quartiles_about, (7500, 15_000, 22_500)))
    assert got["odd.name"].top_about[0].value == "hot" and abs(got["odd.name"].top_about[0].n - 10_000) < 100
    assert (got["id"].low, got["id"].high, got["none"].low) == ("0", "29999", None)
    assert [got[c].encoding for c in df.columns] == ["PLAIN", "DICTIONARY", "PLAIN", "PLAIN"]


def test_functions_in_sql(spark):
    sqlfunctions.register(spark)
    r = spark.sql("SELECT fp_seed('a') AS a, hamming(fp_seed('a'), fp_seed('b')) AS d, fp_similarity(fp_seed('a'), fp_seed('a')) AS s, fp_popcount(fp_xor(fp_seed('a'), fp_seed('b'))) AS p, fp_majority3(fp_seed('a'), fp_seed('a'), fp_seed('b')) AS m").first()
    assert r.a == V.seed_words("a") == r.m and r.d == r.p and r.s == 1.0


def test_code_graph_in_sql_equals_the_operator(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self, x):\n        if x:\n            return g(x)\n\n\ndef g(y):\n    return y\n"), ("b.py", "def broken(:\n"), ("c.py", None), ("d.py", "")], "path string, text string")
    sqlfunctions.register(spark)
    files.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT * FROM code_graph(TABLE(some_files) PARTITION BY path)").collect()
    want = pysource.parsed(files).drop("id").collect()
    key = lambda r: (r.path, r.seq)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [tuple(r) for r in sorted(want, key=key)]
