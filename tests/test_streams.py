import struct
import zlib

from pyspark.sql import functions as F

from ashlar.sources import catalog
from ashlar.streaming import packets


def test_header_layout_and_checksum(spark):
    h = packets.pack(packets.node_hash(F.lit("a")), packets.node_hash(F.lit("b")), F.lit(8), F.lit(5), F.lit(258), F.lit(70000))
    bad = F.concat(F.unhex(F.lit("00")), F.substring(h, 2, 79))
    r = spark.range(1).select(h.alias("h"), packets.unpack(h).alias("u"), packets.unpack(bad).alias("bad"), packets.unpack(F.substring(h, 1, 10)).alias("short")).first()
    data = bytes(r.h)
    assert len(data) == 80 and struct.unpack("<BBHI", data[64:72]) == (8, 5, 258, 70000) and struct.unpack("<I", data[72:76])[0] == zlib.crc32(data[:72])
    assert (r.u.ttl, r.u.priority, r.u.flags, r.u.sequence, r.u.error) == (8, 5, 258, 70000, None) and r.bad.error == "checksum" and r.short.error == "short"


def test_stream_equals_batch(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("l", "l")], "src string, dst string")
    schema = "id long, ttl int, sequence int, trace array<string>, target string"
    rows = [(1, 8, 0, [], "a"), (2, 1, 0, [], "a"), (3, 3, 0, [], "l"), (4, 8, 0, [], "c")]
    batch = spark.createDataFrame(rows, schema)
    results, dead = packets.run_batch(batch, edges)
    assert sorted((r.id, r.target, r.ttl, r.trace) for r in results.collect()) == [(1, "c", 6, ["a", "b"]), (1, "d", 6, ["a", "b"]), (4, "c", 8, [])]
    assert sorted((r.id, r.error) for r in dead.collect()) == [(2, "ttl expired"), (2, "ttl expired"), (3, "ttl expired")]
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    packets.worker(stream, edges, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "out/results"))
    assert sorted((r.id, r.target) for r in again.collect()) == sorted((r.id, r.target) for r in results.collect())


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev")).select("ts", F.col("event_type").alias("node_id"))
    q = packets.windowed_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_catalog(spark, tmp_path):
    (tmp_path / "src/app").mkdir(parents=True)
    (tmp_path / "src/app/model.rb").write_text("class A\nend\n")
    (tmp_path / "src/app/model_spec.rb").write_text("x")
    found = catalog.source_files(spark, str(tmp_path / "src"), ".rb", ("spec",)).collect()
    assert [r.text for r in found] == ["class A\nend\n"]
    v1 = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    catalog.save_version(v1, str(tmp_path / "t"), 1)
    catalog.save_version(catalog.upserted(v1, v1.where("id = 2").withColumn("x", F.lit("c")), ["id"]), str(tmp_path / "t"), 2)
    assert sorted(map(tuple, catalog.load_version(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, catalog.load_version(spark, str(tmp_path / "t"), 1).collect())) == [(1, "a"), (2, "b")]
    (tmp_path / "t/version=3").mkdir()  # a write that did not end
    (tmp_path / "t/version=3/part-0.parquet").write_bytes(b"unfinished")
    assert catalog.versions(spark, str(tmp_path / "t")) == [1, 2] and catalog.load_version(spark, str(tmp_path / "t")).count() == 2
    edges = spark.createDataFrame([("a", "b", "F"), ("a", "zz", "F")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert catalog.upserted_edges(edges.limit(0), edges, nodes).count() == 1
    assert [r.line for r in catalog.dot_lines(nodes, edges).orderBy("part", "line").collect()] == ["digraph {", '"a";', '"b";', '"a" -> "b";', '"a" -> "zz";', "}"]
    assert {r.lane for r in catalog.lanes(spark.range(20), F.col("id")).collect()} == set(range(8))


def test_worker_executes_and_logs(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a", "double"), ("b", "nobody"), ("c", "double")], "id string, fn_name string")
    schema = "id long, ttl int, sequence int, trace array<string>, target string, payload string"
    batch = spark.createDataFrame([(1, 8, 0, [], "a", "x"), (2, 8, 0, [], "gone", "y")], schema)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    double = {"double": lambda inputs: F.struct(F.concat(inputs["payload"], inputs["payload"]).alias("p"))}
    packets.worker(stream, edges, str(tmp_path / "out"), str(tmp_path / "ck"), nodes, double).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    nobody = '{"status":"no_executor","node":"b"}'
    assert {(r.target, r.result) for r in read("log").collect()} >= {("a", '{"p":"xx"}'), ("b", nobody)}
    end = read("results").first()
    assert (end.id, end.target, end.trace, end.ttl) == (1, "c", ["a", "b"], 6) and "no_executor" in end.payload
    assert [(r.id, r.error) for r in read("dead").collect()] == [(2, "unknown node")]
