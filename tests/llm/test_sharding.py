import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ashlar.llm import sharding


def published(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.getrandbits(64) - 2**63 for _ in range(800)), *range(800)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 1000):
        got = {r.k: tuple(r.j) for r in df.select("k", sharding.jump(F.col("k"), n).alias("j")).collect()}
        assert all(got[k] == (published(k, n), published(k, n + 1)) for k in keys)


def test_keys_that_jump_more_often_than_most(spark, monkeypatch):
    monkeypatch.setattr(sharding.math, "ceil", lambda x: -1)  # a single draw for all: nearly every key goes the long way
    df = spark.range(500)
    got = {r.id: tuple(r.j) for r in df.select("id", sharding.jump(F.col("id"), 17).alias("j")).collect()}
    assert all(got[k] == (published(k, 17), published(k, 18)) for k in range(500))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20000).select("id", sharding.jump(F.col("id"), 40).alias("a"), sharding.jump(F.col("id"), 41)["shard"].alias("b"))
    rows = df.select("a.shard", "a.grown", "b").collect()
    assert all(r.grown == r.b and r.b in (r.shard, 40) for r in rows)
    assert abs(sum(r.b == 40 for r in rows) - 20000 / 41) < 5 * (20000 / 41) ** 0.5
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += 1
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * 500


ROWS = [(i, f"text {i}") for i in range(60)] + [(7, "text 7")] * 5 + [(None, None), (None, "x"), (3, ""), (3, None), (4, "é" * 50_000)]


def test_slots_nulls_repeats_and_long_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = sharding.assign(df, shards=4).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((k or -1, t or "") for k, t in ROWS)
    shards = defaultdict(list)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (published(r.doc_id or 0, 4), published(r.doc_id or 0, 5))
        shards[r.shard].append(r)
    for rows in shards.values():
        rows.sort(key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows]
        assert keys == sorted(keys)


def test_one_key_with_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(6)
    shards = defaultdict(list)
    for r in sharding.assign(df, shards=3).collect():
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_empty_and_names_that_clash(spark):
    names = ["size", "Shard", "slot", "law", "text_crc32", "grown_shard", "both", "at", "salt", "task", "first", "before", "n", "l", "r"]
    df = spark.createDataFrame([(i, "t", *names) for i in range(20)], ["doc_id", "text", *names])
    got = sharding.assign(df)
    assert got.columns == ["doc_id", "text", *names, "size_1", "text_crc32_1", "law_1", "shard_1", "slot_1", "grown_shard_1"]
    assert {tuple(r)[2 : 2 + len(names)] for r in got.collect()} == {tuple(names)}
    assert sharding.assign(df.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    sharding.write(sharding.assign(df, shards=5), f"{tmp_path}/s", file_rows=40)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert {(r.shard, r.slot): r.doc_id for r in back.collect()} == {(r.shard, r.slot): r.doc_id for r in sharding.assign(df, shards=5).collect()}
    folders = sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir())
    assert folders == [f"shard={i}" for i in range(5)]
