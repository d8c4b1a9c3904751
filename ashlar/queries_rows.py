"""Registered queries of vector, search, log, catalog, rule, mining, execution and packet operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import bitvec as V
from .functions import project, rules, truth
from .operators import bundle, causal, graph, hamming, mining, search, trace
from .plans import execute, sqlfunctions
from .queries import BASKETS, FP, HAMMING, LOG, LOG_NODES, STEPS, baskets, log, log_nodes, places, query, t
from .sources import catalog, tables
from .streaming import packets


def _r(c: str):
    return F.round(c, 6).alias(c)


# ---- bit-vectors; HEX is a seeded vector's bytes, straight from its hashes

HEX = "(SELECT string_agg(CASE WHEN i = 156 THEN sha256({0} || ':' || i)[1:4] ELSE sha256({0} || ':' || i)[1:16] END, '' ORDER BY i) FROM range(157) AS r(i))"
BYTE = "('0x' || {0}[2 * ({1}) + 1:2 * ({1}) + 2])::int"


def nations(spark: SparkSession, sf_dir: str, column: str = "n_name") -> DataFrame:
    return t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", V.fp_seed(F.col(column)).alias("fp"))


@query(f"SELECT n_name, {HEX.format('n_name')} AS hex FROM nation")
def fp_hex(spark, sf_dir):
    return nations(spark, sf_dir).select("n_name", V.to_hex(F.col("fp")).alias("hex"))


@query(f"SELECT n_name, {HEX.format('n_name')} AS hex FROM nation")
def fp_codec_roundtrip(spark, sf_dir):
    back = V.from_bytes(V.to_bytes(V.from_hex(V.to_hex(F.col("fp")))))
    return nations(spark, sf_dir).select("n_name", V.to_hex(back).alias("hex"))


@query(f"SELECT p_partkey, sha256({HEX.format('p_name')}) AS digest FROM part")
def fp_bulk(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return project.seeded(rows, "p_name").select("p_partkey", F.sha2(V.to_hex(F.col("fp")), 256).alias("digest"))


@query(f"SELECT n_name, {HEX.format('(n_name' + " || '::' || n_regionkey || '::' || 'body')")} AS hex FROM nation")
def fp_of_definition(spark, sf_dir):
    made = V.fingerprint(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("body"))
    return t(spark, sf_dir, "nation").select("n_name", V.to_hex(made).alias("hex"))


@query(f"SELECT n_name, {HEX.format("('NATION::' || n_name || '::' || n_regionkey)")} AS hex FROM nation")
def fp_of_identity(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", V.to_hex(V.identity(F.lit("NATION"), F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("hex"))


@query(f"WITH roles(role) AS (VALUES ('ROLE_SCHEMA'), ('ROLE_LOGIC'), ('ROLE_CONTEXT'), ('ROLE_INPUT'), ('ROLE_OUTPUT'), ('ROLE_CONDITION')) SELECT role, {HEX.format('role')} AS hex FROM roles")
def role_vectors(spark, sf_dir):
    rows = spark.range(1)
    return rows.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), V.to_hex(V.role_vector(r)).alias("hex")) for r in V.ROLES])))


@query(f"""WITH v AS (SELECT n_name, {FP.format("n_name")} AS a, {FP.format("'ROLE_SCHEMA'")} AS r, {FP.format("'ARGENTINA'")} AS o FROM nation)
SELECT n_name, {HAMMING.format("list_transform(list_zip(a, r), lambda z: xor(z[1], z[2]))", "o")}::bigint AS bound_distance, {HAMMING.format("a", "o")}::bigint AS distance FROM v""")
def xor_bind_roundtrip(spark, sf_dir):
    """How far a bound vector lies from another one, and what unbinding (role extraction) gives back."""
    other = V.fp_seed(F.lit("ARGENTINA"))
    v = nations(spark, sf_dir).withColumn("bound", V.xor(F.col("fp"), V.role_vector("ROLE_SCHEMA")))
    return v.select("n_name", V.hamming(F.col("bound"), other).cast("long").alias("bound_distance"), V.hamming(V.state_of(F.col("bound"), "ROLE_SCHEMA"), other).cast("long").alias("distance"))


@query(f"""WITH v AS (SELECT n_name, {HEX.format('n_name')} AS h FROM nation), b AS (SELECT n_name, i, ({BYTE.format('h', 'i // 8')} >> (i % 8)) & 1 = 1 AS bit FROM v, (VALUES (0), (9), (63), (64), (5000), (9999)) AS x(i))
SELECT n_name, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i) AS bits, string_agg(CASE WHEN i = 64 THEN '1' WHEN i = 5000 THEN '0' WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i) AS set_bits FROM b GROUP BY n_name""")
def get_set_bits(spark, sf_dir):
    places_ = (0, 9, 63, 64, 5000, 9999)
    shown = lambda v: F.concat(*[V.get_bit(v, F.lit(i)).cast("int").cast("string") for i in places_])
    v = nations(spark, sf_dir).withColumn("changed", V.set_bit(V.set_bit(F.col("fp"), F.lit(64)), F.lit(5000), False))
    return v.select("n_name", shown(F.col("fp")).alias("bits"), shown(F.col("changed")).alias("set_bits"))


@query(f"WITH v AS (SELECT n_name, {HEX.format('n_name')} AS h FROM nation) SELECT n_name, ({BYTE.format('h', '0')} + {BYTE.format('h', '1')} * 256 + {BYTE.format('h', '2')} * 65536 + {BYTE.format('h', '3')}::bigint * 16777216)::bigint AS idx FROM v")
def index32(spark, sf_dir):
    return V.indexed(nations(spark, sf_dir), "fp", "n_name").select("n_name", "idx")


@query(f"WITH v AS (SELECT n_name, {HEX.format('n_name')} AS h FROM nation) SELECT n_name, h[1:2] || h[417:418] || h[833:834] || h[1249:1250] || h[1665:1666] || h[2081:2082] AS cam FROM v")
def positional_cam(spark, sf_dir):
    return nations(spark, sf_dir).select("n_name", V.positional_cam(V.to_bytes(F.col("fp"))).alias("cam"))


PAIR = f"v AS (SELECT n_name, {FP.format('n_name')} AS a, {FP.format('r_name')} AS b, {FP.format("'third'")} AS c FROM nation JOIN region ON n_regionkey = r_regionkey)"
_BITS = "list_sum(list_transform({0}, lambda x: bit_count(x)))::bigint"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return both.select("n_name", V.fp_seed(F.col("n_name")).alias("a"), V.fp_seed(F.col("r_name")).alias("b"), V.literal(V.seed_words("third")).alias("c"))


@query(f"""WITH {PAIR} SELECT n_name, {_BITS.format('list_transform(list_zip(a, b), lambda z: z[1] & z[2])')} AS two, {_BITS.format('list_transform(list_zip(a, b, c), lambda z: (z[1] & z[2]) | (z[1] & z[3]) | (z[2] & z[3]))')} AS three FROM v""")
def small_bundles(spark, sf_dir):
    return pairs(spark, sf_dir).select("n_name", V.popcount(V.bundle2(F.col("a"), F.col("b"))).cast("long").alias("two"), V.popcount(V.majority3(F.col("a"), F.col("b"), F.col("c"))).cast("long").alias("three"))


@query(f"""WITH v AS (SELECT n_name, {HEX.format('n_name')} AS x, {HEX.format('r_name')} AS y FROM nation JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT n_name, i, bit_count(xor({BYTE.format('x', 'i')}, {BYTE.format('y', 'i')}))::int AS k, bit_count(xor({BYTE.format('x', 'i')}, {BYTE.format('y', 'i')}) & CASE i WHEN 416 THEN 63 WHEN 832 THEN 248 ELSE 255 END)::int AS masked FROM v, range(1250) AS r(i)),
s AS (SELECT n_name, i // 31 AS seg, sum(k) AS k FROM d WHERE i < 1240 GROUP BY ALL)
SELECT n_name, (SELECT round(1 - sum(masked) / 3331.0::double, 6) FROM d WHERE d.n_name = s.n_name AND i BETWEEN 416 AND 832) AS region, round(sum(k) / 1000 + (sum(k * k) / 40 - (sum(k) / 40) ** 2) / 100 + max(k) / 50, 6) AS score FROM s GROUP BY n_name""")
def region_and_segments(spark, sf_dir):
    b = pairs(spark, sf_dir).select("n_name", V.to_bytes(F.col("a")).alias("a"), V.to_bytes(F.col("b")).alias("b"))
    return b.select("n_name", F.round(V.region_similarity(F.col("a"), F.col("b"), 3330, 6661), 6).alias("region"), F.round(V.segment_score(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""WITH v AS (SELECT n_name, {FP.format('n_name')} AS a FROM nation) SELECT n_name, (SELECT count(*) FROM range(157) AS r(i) WHERE a[i + 1] = CASE WHEN i % 3 = 0 THEN a[i + 1] ELSE ~a[i + 1] END)::bigint AS equal_words FROM v""")
def zero_words(spark, sf_dir):
    half = F.transform("fp", lambda w, i: F.when(i % 3 == 0, w).otherwise(F.bitwise_not(w)))
    return nations(spark, sf_dir).select("n_name", V.zero_words(F.col("fp"), half).cast("long").alias("equal_words"))


@query(f"""WITH v AS (SELECT n_name, {FP.format('n_name')} AS a, {FP.format("('k' || n_regionkey)")} AS k, {FP.format('n_regionkey::varchar')} AS w FROM nation) SELECT n_name, {HAMMING.format("list_transform(list_zip(k, w), lambda z: xor(z[1], z[2]))", "a")}::bigint AS distance, 0::bigint AS probed FROM v""")
def encoded_fields(spark, sf_dir):
    """A record of one field, its distance to another vector, and that probing it gives the field's value back."""
    n = nations(spark, sf_dir).withColumn("field", F.concat(F.lit("k"), "n_regionkey")).withColumn("record", V.encode_fields(F.create_map(F.col("field"), F.col("n_regionkey").cast("string"))))
    value = V.encode_number(F.col("n_regionkey"))
    return n.select("n_name", V.hamming(F.col("record"), F.col("fp")).cast("long").alias("distance"), V.hamming(V.probe(F.col("record"), F.col("field")), value).cast("long").alias("probed"))


@query(f"""WITH v AS (SELECT n_name, {FP.format('n_name')} AS a, {FP.format('r_name')} AS b FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT *, list_transform(list_zip(a, b), lambda z: xor(z[1], z[2])) AS edge FROM v)
SELECT n_name, {HAMMING.format('edge', 'a')}::bigint AS edge_distance, 0::bigint AS recovered FROM e""")
def edge_endpoints(spark, sf_dir):
    """An edge binds its ends; with one end it gives the other."""
    e = pairs(spark, sf_dir).withColumn("edge", V.xor(F.col("a"), F.col("b")))
    return e.select("n_name", V.hamming(F.col("edge"), F.col("a")).cast("long").alias("edge_distance"), V.hamming(V.xor(F.col("edge"), F.col("a")), F.col("b")).cast("long").alias("recovered"))


@query(f"""WITH c AS (SELECT l_linestatus, 'line ' || l_linenumber AS line, count(*) AS c FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', 'line ' || l_linenumber, count(*) FROM lineitem GROUP BY ALL),
v AS (SELECT l_linestatus AS part, c, {FP.format('line')} AS a FROM c), w AS (SELECT part, c, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM v),
b AS (SELECT part, i, j, sum(((w >> j) & 1)::bigint * c) AS k, sum(c) AS n FROM w, range(64) AS r(j) GROUP BY ALL)
SELECT part, any_value(n)::bigint AS n, sum((2 * k > n)::int)::bigint AS ones FROM b GROUP BY part""")
def bundle_lineitem(spark, sf_dir):
    """Majority over every row of lineitem by its line number's vector: one group of all rows, and one for each line status."""
    lines = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("line "), "l_linenumber").alias("line"), F.explode(F.array(F.lit("all"), "l_linestatus")).alias("part"))
    vectors = lines.select("line").distinct().withColumn("fp", V.fp_seed(F.col("line")))
    return bundle.majority(lines.join(vectors, "line"), "part").select("part", "n", V.popcount(F.col("fp")).cast("long").alias("ones"))


@query("SELECT vec_id, list_sum(list_transform(list_zip(embedding, m), lambda z: (z[1] > z[2])::int))::bigint AS ones FROM embeddings, (SELECT list(x ORDER BY d) AS m FROM (SELECT d, median(e::double) AS x FROM (SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d))")
def median_bits(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    b = project.binarized(e, "embedding")
    return b.select("vec_id", F.size(F.filter("bits", lambda x: x)).cast("long").alias("ones"))


@query("SELECT d::int AS d, quantile_disc(e, 0.25) AS low, median(e) AS middle, quantile_disc(e, 1.0) AS high FROM (SELECT unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY d")
def dimension_quantiles(spark, sf_dir):
    """Quartile, median and largest value of every dimension, selected exactly."""
    found = project.order_statistics(t(spark, sf_dir, "embeddings"), "embedding", lambda n: [max(0, -(-n // 4) - 1), (n - 1) // 2, n // 2, n - 1])
    return spark.createDataFrame([(d, a, (b + c) / 2, e) for d, (a, b, c, e) in found.items()], "d int, low double, middle double, high double")


@query()
def project_embeddings_knn(spark, sf_dir):
    """The five nearest projected vectors of the first one; tests hold it against NumPy."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), V.from_bytes(project.fp_project(F.col("embedding"))).alias("fp"))
    return search.resonate_item(e, "idx", 0, 0.0, 5).select("idx", _r("similarity"))


@query("SELECT vec_id::bigint AS a, 1000000 + vec_id::bigint AS b FROM embeddings WHERE vec_id % 10 = 0")
def alike_embeddings(spark, sf_dir):
    """Pairs of projected embeddings at least 0.9 similar, found by bands: every tenth one has a slightly changed copy, and no others come near."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: x + 0.01 * (i % 3 - 1))
    both = e.union(e.where("idx % 10 = 0").select(F.col("idx") + 1000000, moved))
    return search.similar_pairs(both.select("idx", V.from_bytes(project.fp_project(F.col("v"))).alias("fp")), 0.9).select("a", "b")


@query()
def state_roundtrip(spark, sf_dir):
    """State vectors of labels read back; tests hold it against NumPy."""
    rows = t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - 0.5).alias("tau"), (F.col("toxic") - 0.5).alias("sigma"), F.lit("calm").alias("q"))
    s = rows.withColumn("state", project.encode_state(F.col("tau"), F.col("sigma"), F.col("q"))).withColumn("back", project.decode_state(F.col("state")))
    return s.select("doc_id", F.round("back.tau", 6).alias("tau"), F.round("back.sigma", 6).alias("sigma"))


# ---- search


def part_index(spark: SparkSession, sf_dir: str, groups: bool = True) -> hamming.HammingIndex:
    """An index of the fingerprints of all parts' names, in the shared folder; a scan needs no ``groups``."""
    rows = project.seeded(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("idx"), "p_name"), "p_name")
    return hamming.HammingIndex.build(rows, f"{graph.shared_folder(spark)}/hamming-{uuid.uuid4().hex}", groups=groups)


#: The vector of part 7's name with its first 15 words turned over: 960 bits away.
_TURNED = f"WITH v AS (SELECT p_partkey::bigint AS idx, {FP.format('p_name')} AS a FROM part), q AS (SELECT list_transform(a, lambda x, i: CASE WHEN i <= 15 THEN xor(x, 18446744073709551615::ubigint) ELSE x END) AS q FROM v WHERE idx = 7), d AS (SELECT idx, {HAMMING.format('a', 'q')}::bigint AS distance FROM v, q) SELECT idx, distance FROM d WHERE distance <= 1000"


def turned(spark: SparkSession, sf_dir: str) -> list[int]:
    name = t(spark, sf_dir, "part").where("p_partkey = 7").first()["p_name"]
    return [~w if i < 15 else w for i, w in enumerate(V.seed_words(name))]


@query(_TURNED)
def indexed_search(spark, sf_dir):
    """Parts at least 0.9 similar, found by groups of bits; tests hold the share of rows that it reads under 5 %."""
    return part_index(spark, sf_dir).search(turned(spark, sf_dir), 0.9)[0]


@query(_TURNED)
def multi_resolution_search(spark, sf_dir):
    """The same by resolution: the first 2,304 bits of all vectors, then the whole of what they do not rule out."""
    return part_index(spark, sf_dir, groups=False).scan(turned(spark, sf_dir), 0.9)[0]


@query("""WITH e AS (SELECT vec_id::bigint AS idx, list_transform(embedding, lambda x: greatest(0, least(62, floor((x::double + 0.375) * (62 / 0.75::double))))::int) AS q FROM embeddings),
d AS (SELECT x.idx AS a, y.idx AS b, list_sum(list_transform(list_zip(x.q, y.q), lambda z: abs(z[1] - z[2])))::bigint AS distance FROM e x JOIN e y ON x.idx < y.idx)
SELECT a, b, round(1 - distance / 10000.0::double, 6) AS similarity FROM d WHERE distance <= 600""")
def similar_embeddings(spark, sf_dir):
    """All pairs of embeddings, as level codes, at least 0.94 similar."""
    codes = t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("idx"), V.thermometer(F.col("embedding"), -0.375, 0.375).alias("fp"))
    return hamming.similarity_join(codes, 0.94, cell_rows=256, every_copy=True)[0].select("a", "b", _r("similarity"))


SUP = f"v AS (SELECT s_suppkey::bigint AS idx, s_nationkey, s_name, {FP.format('s_name')} AS a FROM supplier)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("idx"), "s_nationkey", "s_name")
    return project.seeded(s, "s_name")


_NEAR = f"SELECT idx, {HAMMING.format('a', 'q')}::bigint AS distance FROM v, (SELECT a AS q FROM v WHERE idx = 3)"


@query(f"WITH {SUP} SELECT idx, round(1 - distance / 10000.0::double, 6) AS similarity FROM ({_NEAR}) WHERE idx <> 3 ORDER BY distance, idx LIMIT 5")
def find_similar(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    own = s.where("idx = 3").first()["fp"]
    return search.find_similar(s, own, 5, exclude=3).select("idx", _r("similarity"))


@query(f"WITH {SUP} SELECT idx, round(1 - distance / 10000.0::double, 6) AS similarity FROM ({_NEAR}) WHERE distance <= 5000 ORDER BY distance, idx LIMIT 4")
def resonate_by_name(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    name = s.where("idx = 3").first()["s_name"]
    return search.resonate_item(s, "s_name", name, 0.5, 4).select("idx", _r("similarity"))


@query(f"WITH {SUP} SELECT idx, round(1 - distance / 10000.0::double, 6) AS similarity FROM ({_NEAR}) WHERE distance <= 1000 ORDER BY idx LIMIT 1")
def first_alike(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    return search.first_alike(s, s.where("idx = 3").first()["fp"]).select("idx", "similarity")


@query(f"WITH {SUP} SELECT idx, distance FROM ({_NEAR}) WHERE idx IN (SELECT idx FROM v WHERE s_nationkey < 12) ORDER BY distance, idx LIMIT 3")
def knn_prefiltered(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    return search.knn(s.where("s_nationkey < 12"), s.where("idx = 3").first()["fp"], 3).select("idx", "distance")


@query(f"""WITH {SUP}, noisy AS (SELECT list_transform(a, lambda x, i: CASE WHEN i % 3 = 2 THEN xor(x, 18446462598732840960::ubigint) ELSE x END) AS q FROM v WHERE idx = 3)
SELECT idx, {HAMMING.format('a', 'q')}::bigint AS distance FROM v, noisy ORDER BY distance, idx LIMIT 1""")
def associative_lookup(spark, sf_dir):
    """A vector of which 16 bits of every third word are turned over still finds its own."""
    s = suppliers(spark, sf_dir)
    own = s.where("idx = 3").first()["fp"]
    noisy = [w ^ 0xFFFF if i % 3 == 1 else w for i, w in enumerate(own)]
    return search.clean_up(s, noisy, 30).select("idx", "distance")


@query(f"WITH {SUP}, d AS (SELECT idx, {HAMMING.format('a', 'q')}::bigint AS distance FROM v, (SELECT a AS q FROM v WHERE idx = 4)) SELECT idx, idx % 2 = 0 AS success, distance FROM (SELECT * FROM d ORDER BY distance, idx LIMIT 5) WHERE idx % 2 = 0 AND distance < 100")
def trace_replay(spark, sf_dir):
    s = suppliers(spark, sf_dir).withColumn("success", F.col("idx") % 2 == 0)
    return search.replayed(s, s.where("idx = 4").first()["fp"], 5, 100).select("idx", "success", "distance")


@query(f"WITH {SUP}, p AS (SELECT idx AS a, idx + 50 AS b FROM v) SELECT p.a, p.b, CASE WHEN y.a IS NULL THEN 0.0 ELSE round(1 - {HAMMING.format('x.a', 'y.a')} / 10000.0::double, 6) END AS similarity FROM p JOIN v x ON x.idx = p.a LEFT JOIN v y ON y.idx = p.b")
def pair_similarity(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    return search.pair_similarity(s.select(F.col("idx").alias("a"), (F.col("idx") + 50).alias("b")), s).select("a", "b", _r("similarity"))


@query(f"""WITH v AS (SELECT n_nationkey::bigint AS idx, {HEX.format('n_name')} AS x, {HEX.format("'INDIA'")} AS y FROM nation), d AS (SELECT idx, i, bit_count(xor({BYTE.format('x', 'i')}, {BYTE.format('y', 'i')}))::int AS k FROM v, range(1250) AS r(i)),
h AS (SELECT idx, sum(k) AS far FROM d GROUP BY 1), s AS (SELECT idx, i // 31 AS seg, sum(k) AS k FROM d WHERE i < 1240 GROUP BY ALL), z AS (SELECT idx, round(sum(k) / 1000 + (sum(k * k) / 40 - (sum(k) / 40) ** 2) / 100 + max(k) / 50, 6) AS score FROM s GROUP BY idx)
SELECT z.idx, far::bigint AS distance, score FROM z JOIN h ON z.idx = h.idx WHERE far < 5000 ORDER BY score, z.idx LIMIT 5""")
def two_stage_search(spark, sf_dir):
    n = nations(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("idx"), V.to_bytes(F.col("fp")).alias("fp_bytes"))
    return search.two_stage(n, V.to_bytes(V.fp_seed(F.lit("INDIA"))), 5000, 5).select("idx", "distance", _r("score"))


@query("SELECT text_key AS fp_key, n, first FROM (SELECT o_orderstatus AS text_key, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1) WHERE n > 1")
def duplicate_vectors(spark, sf_dir):
    """Groups of equal vectors; their keys are told by the text that made them."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_orderstatus")
    names = o.select("o_orderstatus").distinct()
    fps = graph.cut(project.seeded(names, "o_orderstatus"))  # or the condition that keys are not null would go below distinct(), where a vector is made for every order
    groups = search.duplicates(fps.join(o, "o_orderstatus"))
    keys = fps.select("o_orderstatus", F.sha2(F.concat_ws(",", F.transform("fp", lambda w: w.cast("string"))), 256).alias("fp_key"))
    return groups.join(keys, "fp_key").select(F.col("o_orderstatus").alias("fp_key"), "n", "first")


# ---- execution log


@query(f"WITH {LOG} SELECT execution_id, node_id, event_id FROM log WHERE NOT success ORDER BY ts DESC, execution_id, node_id LIMIT 1")
def last_failure_of_node(spark, sf_dir):
    return trace.last_failure(log(spark, sf_dir), "error").select("execution_id", "node_id", "event_id")


@query(f"WITH {LOG} SELECT event_id, (row_number() OVER (PARTITION BY execution_id ORDER BY ts, node_id) - 1)::int AS step FROM log")
def trace_steps(spark, sf_dir):
    return trace.steps(log(spark, sf_dir)).select("event_id", "step")


@query(f"WITH {LOG}, m AS (SELECT *, (node_id IS DISTINCT FROM lag(node_id) OVER w)::int AS new FROM log WINDOW w AS (PARTITION BY execution_id ORDER BY ts, node_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY execution_id ORDER BY ts, node_id) AS run FROM m) SELECT execution_id, node_id, run::int AS run, count(*) AS n FROM r GROUP BY ALL")
def run_lengths(spark, sf_dir):
    return trace.run_lengths(log(spark, sf_dir))


@query("SELECT event_type AS node_id, count(DISTINCT user_id) AS executions, round(avg(value), 6) AS avg_duration FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY 1")
def distinct_stats(spark, sf_dir):
    return trace.distinct_stats(log(spark, sf_dir)).select("node_id", "executions", _r("avg_duration"))


@query("SELECT user_id AS session_id, count(value) AS executions, round(sum(value), 6) AS total_ms, round(sum(value) / greatest(count(value), 1), 6) AS mean_ms FROM events GROUP BY 1")
def session_stats(spark, sf_dir):
    s = trace.session_stats(t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("value").alias("duration_ms")))
    return s.select("session_id", "executions", _r("total_ms"), _r("mean_ms"))


@query(f"""WITH {STEPS}, {LOG_NODES}, l AS (SELECT DISTINCT src, dst FROM edges), s AS (SELECT event_type AS id, count(*) AS n, avg(value) AS a, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT id AS node_id, 'fix_errors' AS action, round(1 + f / n::double, 6) AS speedup FROM s WHERE f / n::double > 0.1 UNION ALL SELECT id, 'cache', round(least(a / 0.1, 100), 6) FROM s WHERE id <> 'error' AND a > 10 UNION ALL SELECT id, 'add_index', 5.0 FROM s WHERE id = 'purchase' AND a > 50
UNION ALL SELECT DISTINCT x.dst, 'parallelize', 2.0 FROM l x JOIN l y ON x.src = y.src AND x.dst < y.dst JOIN nodes m ON m.id = x.dst AND m.pure AND NOT m.parallelizable JOIN nodes n ON n.id = y.dst AND n.pure
UNION ALL SELECT id, 'cache_result', 10.0 FROM s WHERE id <> 'error' AND n > 10 AND a > 5""")
def performance_report(spark, sf_dir):
    return trace.performance(log(spark, sf_dir), log_nodes(spark, sf_dir), trace.transitions(log(spark, sf_dir)), 100).select("node_id", "action", _r("speedup"))


# ---- catalog


def web_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes by segment; every customer depends on two others."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("node_type"), F.col("c_name").alias("name"))
    e = c.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 3 % 100 + 1, F.col("id") * 7 % 90 + 1)).alias("dst"), F.when(F.col("id") % 2 == 0, "DEPENDS").otherwise("CALLS").alias("edge_type"))
    return c, e


CUST = "c AS (SELECT c_custkey::bigint AS id, c_mktsegment AS node_type, c_name AS name FROM customer), e AS (SELECT id AS src, unnest([id * 3 % 100 + 1, id * 7 % 90 + 1]) AS dst, CASE WHEN id % 2 = 0 THEN 'DEPENDS' ELSE 'CALLS' END AS edge_type FROM c)"


@query(f"WITH {CUST} SELECT id, node_type, name FROM c WHERE id = 42")
def node_by_id(spark, sf_dir):
    return catalog.node_by_id(web_rows(spark, sf_dir)[0], 42)


@query(f"WITH {CUST} SELECT * FROM e WHERE src = 42")
def outgoing_edges(spark, sf_dir):
    return catalog.outgoing(web_rows(spark, sf_dir)[1], 42)


@query(f"WITH {CUST} SELECT 'needs' AS side, dst AS id FROM e WHERE src = 42 AND edge_type = 'DEPENDS' UNION ALL SELECT 'needed_by', src FROM e WHERE dst = 31 AND edge_type = 'DEPENDS'")
def dependencies_and_dependents(spark, sf_dir):
    edges = web_rows(spark, sf_dir)[1]
    return catalog.dependencies(edges, 42).select(F.lit("needs").alias("side"), "id").union(catalog.dependents(edges, 31).select(F.lit("needed_by"), "id"))


@query(f"WITH {CUST} SELECT id AS key FROM c WHERE node_type IN ('BUILDING', 'MACHINERY') UNION ALL SELECT src FROM e WHERE edge_type = 'CALLS'")
def of_type(spark, sf_dir):
    nodes, edges = web_rows(spark, sf_dir)
    return catalog.of_type(nodes, "BUILDING", "MACHINERY").select(F.col("id").alias("key")).union(catalog.of_type(edges, "CALLS").select("src"))


@query("SELECT min(p_partkey)::bigint AS id, p_name AS name FROM part WHERE p_name = (SELECT p_name FROM part ORDER BY p_partkey DESC LIMIT 1) GROUP BY 2")
def node_by_name(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    return catalog.by_name(p, p.orderBy(F.desc("id")).first()["name"])


@query("SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def children_by_name(spark, sf_dir):
    from .queries_graph import _named_places

    nodes, contains = _named_places(spark, sf_dir)
    return catalog.children_of(nodes, contains.withColumn("edge_type", F.lit("CONTAINS")), "ASIA")


@query("SELECT n_name AS src_name, r_name AS dst_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def break_targets(spark, sf_dir):
    from .queries_graph import _named_places

    nodes, contains = _named_places(spark, sf_dir)
    edges = contains.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src like 'n%'").withColumn("edge_type", F.lit("BREAKS_TO"))
    return catalog.ends_of(nodes, edges, "BREAKS_TO")


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 30 GROUP BY 1")
def range_count(spark, sf_dir):
    return catalog.counts_in_range(t(spark, sf_dir, "part"), "p_size", 10, 30)


@query("SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (x - 0.1::double) ** 2))) AS d FROM embeddings) WHERE d < 1.3")
def distance_within(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return catalog.distance_within(e, "embedding", [0.1] * 64, 1.3).select("vec_id", F.round("distance", 4).alias("distance"))


@query("SELECT c_custkey::bigint AS id, round(0.7 * c_acctbal + 0.3 * c_nationkey, 4) AS score FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 3 AND c_acctbal > 0 AND c_custkey % 2 = 1 ORDER BY 0.7 * c_acctbal + 0.3 * c_nationkey DESC, id LIMIT 10")
def composite_ranking(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("long"))
    conditions = [F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") > 3, F.col("c_acctbal") > 0, F.col("id") % 2 == 1]
    return catalog.ranked_within(c, conditions, {"c_acctbal": 0.7, "c_nationkey": 0.3}).select("id", F.round("score", 4).alias("score"))


@query("SELECT c_custkey::bigint AS id, round(c_acctbal::double, 6) AS score FROM customer WHERE c_acctbal > 5000")
def filter_and_order(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("value"))
    return rules.based_on(c, F.col("value")).select("id", _r("score"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def sql_node(spark, sf_dir):
    t(spark, sf_dir, "nation").createOrReplaceTempView("sql_node_nation")
    return catalog.sql_node(spark, "SELECT n_name FROM sql_node_nation WHERE n_regionkey = ? AND n_nationkey > ?", ["region", "above"], {"region": 2, "above": 8, "other": 1})


@query("SELECT 0 AS part, 'digraph {' AS line UNION ALL SELECT 1, '\"n' || n_nationkey || '\";' FROM nation UNION ALL SELECT 1, '\"r' || r_regionkey || '\";' FROM region UNION ALL SELECT 2, '\"n' || n_nationkey || '\" -> \"r' || n_regionkey || '\";' FROM nation UNION ALL SELECT 3, '}'")
def dot_graph(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    return catalog.dot_lines(nodes.where("id not like 's%'"), edges.where("src like 'n%'"))


@query("SELECT r_name || ' → ' || n_name AS path, '  ' || n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_print(spark, sf_dir):
    from .operators.graph import containment
    from .queries_graph import _named_places

    nodes, contains = _named_places(spark, sf_dir)
    return catalog.tree_lines(containment(nodes.where("id not like 's%'"), contains.where("dst like 'n%'")).where("depth = 1"))


@query("SELECT doc_id, lang IS NOT NULL AND lang <> '' AND source IS NOT NULL AND source <> '' AS good FROM documents")
def emitted_rows(spark, sf_dir):
    good, bad = catalog.emitted(t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"])
    return good.select("doc_id", F.lit(True).alias("good")).union(bad.select("doc_id", F.lit(False)))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_roundtrip(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = catalog.json_of(n, "n_nationkey").withColumnRenamed("n_nationkey", "key")
    schema = ", ".join(f"{name} {kind}" for name, kind in n.dtypes)
    return catalog.from_json(j, "json", schema).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey % 8 AS lane, count(*) AS n FROM customer GROUP BY 1")
def lane_sizes(spark, sf_dir):
    return catalog.lanes(t(spark, sf_dir, "customer"), F.col("c_custkey")).groupBy(F.col("lane").cast("long").alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, 'first' AS source FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal > 0")
def set_union(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return catalog.united(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("first").alias("source")), c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit("second").alias("source")))


def _two_sets(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.where("c_acctbal > 0").select("c_custkey"), c.where("c_mktsegment = 'BUILDING'").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_intersect(spark, sf_dir):
    return catalog.intersected(*_two_sets(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_difference(spark, sf_dir):
    return catalog.subtracted(*_two_sets(spark, sf_dir), "c_custkey")


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation WHERE ('n' || n_nationkey) LIKE 'n1%' AND n_regionkey < 3 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE ('n' || s_nationkey) LIKE 'n1%'")
def edges_within(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    return catalog.edges_within(edges, nodes.where("id not in ('r3', 'r4')"), "n1%")


@query("SELECT 's' || s_suppkey AS src, CASE WHEN s_suppkey % 3 = 0 AND s_nationkey <> 7 THEN 'changed' ELSE 'old' END AS type_of FROM supplier")
def upserted_edges(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    old = edges.where("src like 's%'").select("src", "dst", F.lit("LIES_IN").alias("type"), F.lit("old").alias("type_of"))
    new = old.where(F.substring("src", 2, 9).cast("long") % 3 == 0).withColumn("type_of", F.lit("changed"))
    return catalog.upserted_edges(old, new, nodes.where("id <> 'n7'")).select("src", "type_of")


# ---- rules


@query("""SELECT coalesce(bool_and(c_acctbal > -1000), true) AS every_one, bool_or(c_acctbal > 9900) AS some, NOT bool_or(c_nationkey > 30) AS no_one, count(*) FILTER (c_acctbal > 5000) AS n, (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 9000) AS first, EXISTS (SELECT 1 FROM customer WHERE c_custkey = 5 AND c_nationkey = 3) AS holds,
true AS every_of_none, false AS some_of_none FROM customer""")
def quantifiers(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    over = lambda x: F.col("c_acctbal") > x
    links = c.select(F.lit(3).alias("at"), F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"), F.lit("CONTAINS").alias("edge_type"), "c_acctbal", "c_nationkey", "c_custkey")
    return links.agg(
        rules.all_of(over(-1000)).alias("every_one"), rules.exists_of(over(9900)).alias("some"), rules.none_of(F.col("c_nationkey") > 30).alias("no_one"), rules.count_of(over(5000)).alias("n"),
        rules.first_of(F.col("c_custkey"), over(9000), F.col("c_custkey")).alias("first"), rules.contains(links, 3, 5).alias("holds"),
    ).crossJoin(c.where("c_custkey < 0").agg(rules.all_of(over(0)).alias("every_of_none"), rules.exists_of(over(0)).alias("some_of_none")))


@query("""SELECT p_partkey, CASE WHEN p_size > 3 THEN round(least(p_size / 6.0, 0.9), 6) ELSE 0.0 END AS orchestration, p_size > 3 AS found FROM part""")
def intent_confidence(spark, sf_dir):
    found = rules.intents(F.lit("plain"), F.lit("none"), F.col("p_size"))
    own = F.filter(found, lambda x: x["intent"] == "orchestration")
    return t(spark, sf_dir, "part").select("p_partkey", F.round(F.coalesce(F.get(own, F.lit(0))["confidence"], F.lit(0.0)), 6).alias("orchestration"), rules.has_intent(found, "orchestration", 0.6).alias("found"))


@query("SELECT doc_id, round(0.8 * (quality - 0.5) + 0.5, 6)::double AS expected FROM labels")
def truth_expectation(spark, sf_dir):
    return t(spark, sf_dir, "labels").select("doc_id", F.round(truth.expectation(truth.truth(F.col("quality").cast("double"), 0.8)), 6).alias("expected"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'blank|null|empty') THEN 'provide_input' WHEN doc_id % 4 >= 2 THEN 'validate_upstream' WHEN regexp_matches(lower(text), 'too short|too long') THEN 'check_length' ELSE 'review_path' END AS action,
  CASE WHEN regexp_matches(lower(text), 'blank|null|empty') THEN source ELSE '' END AS sources FROM documents""")
def cause_suggestions(spark, sf_dir):
    """Texts taken for messages of failures, each failed some times before: what their causes call for."""
    cause = rules.root_cause(F.col("doc_id").cast("string"), F.col("text"), F.array("source"), F.col("doc_id") % 4, F.lit(0))
    return t(spark, sf_dir, "documents").withColumn("cause", cause).select("doc_id", rules.suggestion(F.col("cause")).alias("action"), F.array_join("cause.sources", ",").alias("sources"))


# ---- mining

PAIRS = f"{BASKETS}, p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM baskets x JOIN baskets y ON x.user_id = y.user_id AND x.day = y.day AND x.item < y.item GROUP BY ALL), c AS (SELECT item, count(*) AS m FROM baskets GROUP BY 1)"


@query(f"WITH {PAIRS}, s AS (SELECT a, b, n / m::double AS s FROM p JOIN c ON a = item WHERE n / m::double > 0.1) SELECT a AS item, b AS other, round(s, 6) AS strength FROM s UNION ALL SELECT b, a, round(s, 6) FROM s")
def propagation(spark, sf_dir):
    return mining.propagation(baskets(spark, sf_dir), 0.1).select("item", "other", _r("strength"))


def many_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket per order: the sizes of its parts by rule, so that some pairs always go together."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("i"), (F.col("l_linenumber") % 7).cast("string")).alias("item"))
    return lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_set("item")).alias("items"))


ITEMS = "bk AS (SELECT DISTINCT l_orderkey AS seq, 'i' || l_linenumber % 7 AS item FROM lineitem), ip AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM bk x JOIN bk y ON x.seq = y.seq AND x.item < y.item GROUP BY ALL), ic AS (SELECT item, count(*) AS m FROM bk GROUP BY 1)"


def keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """many_items with two more in every basket, of which one implies the other."""
    k = F.col("seq")
    return many_items(spark, sf_dir).withColumn("items", F.concat("items", F.array(F.concat(F.lit("a"), k % 6), F.concat(F.lit("b"), k % 3))))


@query("""WITH bk AS (SELECT DISTINCT l_orderkey AS seq, unnest(['i' || l_linenumber % 7, 'a' || l_orderkey % 6, 'b' || l_orderkey % 3]) AS item FROM lineitem), ic AS (SELECT item, count(*) AS m FROM bk GROUP BY 1),
ip AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM bk x JOIN bk y ON x.seq = y.seq AND x.item < y.item GROUP BY ALL)
SELECT a, b, n, round(n / m::double, 6) AS confidence FROM ip JOIN ic ON a = item WHERE n / m::double >= 0.9 AND n >= 3""")
def implication_rules(spark, sf_dir):
    return mining.implications(keyed_items(spark, sf_dir)).select("a", "b", "n", _r("confidence"))


@query(f"WITH {ITEMS} SELECT a, b, n FROM ip ORDER BY n DESC, a, b LIMIT 5")
def frequent_pairs(spark, sf_dir):
    return mining.frequent_pairs(many_items(spark, sf_dir))


KNOWN = [("low", ["i1", "i2", "i3"], 0.8), ("high", ["i4", "i5", "i6", "i0"], 0.6)]
PATTERNS = "pt(name, pattern, conf) AS (VALUES ('low', ['i1', 'i2', 'i3'], 0.8::double), ('high', ['i4', 'i5', 'i6', 'i0'], 0.6::double)), bs AS (SELECT seq, list(item) AS items FROM bk GROUP BY seq), ov AS (SELECT seq, name, items, pattern, conf, len(list_intersect(items, pattern)) AS k FROM bs, pt)"


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "name string, items array<string>, confidence double")


@query(f"WITH {ITEMS}, {PATTERNS}, top AS (SELECT * FROM ip WHERE n >= 3 ORDER BY n DESC, a, b LIMIT 5) SELECT a, b, n, round(least(n / 10, 0.7), 6) AS confidence FROM top WHERE NOT EXISTS (SELECT 1 FROM pt WHERE list_contains(pattern, a) AND list_contains(pattern, b))")
def emerging_patterns(spark, sf_dir):
    return mining.emerging_patterns(many_items(spark, sf_dir), known(spark)).select("a", "b", "n", _r("confidence"))


@query(f"WITH {ITEMS}, {PATTERNS}, miss AS (SELECT seq, unnest(list_filter(pattern, lambda x: NOT list_contains(items, x))) AS item, k / len(pattern)::double * conf AS s FROM ov WHERE k > 0) SELECT seq, item, round(max(s), 6) AS score FROM miss GROUP BY ALL")
def predicted_items(spark, sf_dir):
    return mining.predict_missing(many_items(spark, sf_dir), known(spark)).select("seq", "item", _r("score"))


@query(f"WITH {ITEMS}, {PATTERNS} SELECT name, round(least(1.0, any_value(conf) + 0.1 * coalesce(sum(k / len(pattern)::double) FILTER (2 * k > len(pattern)), 0)), 6) AS confidence, count(*) FILTER (2 * k > len(pattern)) AS observations FROM ov GROUP BY name")
def reinforced_patterns(spark, sf_dir):
    return mining.reinforce(many_items(spark, sf_dir), known(spark)).select("name", _r("confidence"), "observations")


@query(f"WITH {ITEMS}, {PATTERNS} SELECT seq, name, round(k / len(pattern)::double * conf, 6) AS score FROM ov WHERE k / len(pattern)::double > 0.3 UNION ALL SELECT DISTINCT seq, 'recipe', 0.9::double FROM bk WHERE item = 'i6'")
def suggested_fixes(spark, sf_dir):
    recipe = spark.createDataFrame([("recipe", ["i6"], 0.9)], "name string, items array<string>, confidence double").withColumn("kind", F.lit("REFACTORING_RECIPE"))
    patterns = known(spark).withColumn("kind", F.lit("SYNDROME")).unionByName(recipe)
    return mining.suggested_fixes(many_items(spark, sf_dir), patterns).select("seq", "name", _r("score"))


@query(f"WITH {ITEMS}, st AS (SELECT a, b, n / m::double AS s FROM ip JOIN ic ON a = item), both_ AS (SELECT a AS x, b AS y, s FROM st UNION ALL SELECT b, a, s FROM st), ru(source, targets) AS (VALUES ('i1', ['i2', 'i3']), ('i2', ['i1', 'i3', 'i4', 'i5']), ('i6', ['i0', 'i5'])) SELECT source, (SELECT count(*) FROM both_ WHERE x = source AND list_contains(targets, y) AND s > 0.5) >= least(len(targets), 3) AS confirmed FROM ru")
def fanout_confirmed(spark, sf_dir):
    asked = spark.createDataFrame([("i1", ["i2", "i3"]), ("i2", ["i1", "i3", "i4", "i5"]), ("i6", ["i0", "i5"])], "source string, targets array<string>")
    return mining.fanout_confirmed(many_items(spark, sf_dir), asked)


@query("""WITH r AS (SELECT o_orderkey % 3 AS level, 'e' || o_orderkey % 2 AS e1, 'f' || o_orderkey % 7 AS e2 FROM orders), z AS (SELECT level, count(*) AS support FROM r GROUP BY 1), s AS (SELECT level, unnest([e1, e2]) AS e FROM r),
q AS (SELECT s.level, e, count(*) AS n FROM s JOIN z ON s.level = z.level GROUP BY s.level, e, support HAVING 2 * count(*) >= support), l AS (SELECT level, string_agg(e, ',' ORDER BY n DESC, e) AS common FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, e) AS k FROM q) WHERE k <= 5 GROUP BY level)
SELECT z.level::bigint AS level, support >= 5 AND common IS NOT NULL AS elevated, (z.level + (support >= 5 AND common IS NOT NULL)::int)::int AS to_level, support, CASE WHEN support >= 5 THEN coalesce(common, '') ELSE '' END AS common FROM z LEFT JOIN l ON z.level = l.level""")
def level_jump(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("long").alias("level"), F.array(F.concat(F.lit("e"), F.col("o_orderkey") % 2), F.concat(F.lit("f"), F.col("o_orderkey") % 7)).alias("examples"))
    return mining.level_jump(o).withColumn("common", F.array_join("common", ","))


@query("SELECT 6 AS level, 0.8::double AS confidence, 500::bigint AS support, 5::bigint AS n_rules, 0.4::double AS impact, 'too_much_breaks_together' AS insight")
def elevated_rule(spark, sf_dir):
    return mining.elevate(mining.seed_principles(spark), 0.8).withColumn("impact", F.round("impact", 6))


@query("SELECT o_orderkey AS name, round(c * CASE WHEN o < 3 THEN 0.855::double ELSE 0.95::double END, 6) AS confidence, o AS observations FROM (SELECT o_orderkey, (o_orderkey % 20 / 20.0)::double AS c, o_orderkey % 12 AS o FROM orders) WHERE NOT (c * CASE WHEN o < 3 THEN 0.855::double ELSE 0.95::double END < 0.1 AND o < 10)")
def decayed_patterns(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 20 / 20).alias("confidence"), (F.col("o_orderkey") % 12).alias("observations"))
    return mining.decayed(o).select("name", _r("confidence"), "observations")


@query("SELECT name, kind, n::bigint AS n FROM (VALUES ('God Object Syndrome', 'SYNDROME', 3), ('Spaghetti Tangle', 'SYNDROME', 3), ('Dependency Hell', 'SYNDROME', 3), ('Copy-Paste Inheritance', 'SYNDROME', 2)) AS v(name, kind, n)")
def seeded_syndromes(spark, sf_dir):
    return mining.seed_patterns(spark).where("kind = 'SYNDROME'").select("name", "kind", F.size("items").cast("long").alias("n"))


@query(f"WITH {STEPS}, p AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL), r AS (SELECT x AS src, count(*) AS m FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT p.src, dst, round(n / m::double, 6) AS confidence, 1.0::double AS amplification, 0::bigint AS latency FROM p JOIN r ON p.src = r.src WHERE n / m::double > 0.1")
def learned_edges(spark, sf_dir):
    return causal.learned(trace.transitions(log(spark, sf_dir)), 0.1).select("src", "dst", _r("confidence"), "amplification", "latency")


@query("SELECT user_id::varchar AS src, strftime(ts, '%Y-%m-%d') AS dst, count(*) AS observations, round(least(1.0, arg_min(value, event_id) / 1000 + 0.1 * (count(*) - 1)), 6) AS confidence FROM events GROUP BY ALL")
def reinforced_edges(spark, sf_dir):
    """Users and the days on which they are seen: every later event of a day strengthens the edge."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("src"), day.alias("dst"), (F.col("value") / 1000).alias("confidence"))
    return causal.reinforced(e).select("src", "dst", "observations", _r("confidence"))


@query("""WITH v AS (SELECT l_quantity::double AS v, lag(l_quantity::double) OVER (ORDER BY l_orderkey * 100 + l_linenumber, l_quantity) AS b FROM lineitem), f AS (SELECT v, count(*) AS k FROM v GROUP BY 1)
SELECT 'l_quantity' AS column_name, count(v) AS n, count(DISTINCT v) AS distinct_values, min(v) AS low, max(v) AS high, (SELECT v FROM f ORDER BY k DESC, v LIMIT 1) AS mode, round((SELECT max(k) FROM f) / count(v)::double, 6) AS mode_share, bool_and(b IS NULL OR b <= v) AS in_order, count(*) FILTER (b IS DISTINCT FROM v) AS runs, round(count(v) / (count(*) FILTER (b IS DISTINCT FROM v))::double, 6) AS mean_run,
CASE WHEN count(DISTINCT v) = 1 THEN 'ONE_VALUE' WHEN count(DISTINCT v) < 0.5 * count(v) THEN 'DICTIONARY' ELSE 'PLAIN' END AS encoding FROM v""")
def column_stats(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"))
    s = mining.column_stats(rows, "l_quantity", "o").withColumn("column_name", F.lit("l_quantity"))
    return s.select("column_name", "n", "distinct_values", "low", "high", "mode", _r("mode_share"), "in_order", "runs", _r("mean_run"), "encoding")


# ---- execution and packets

PLAN = [
    {"id": "entry", "fn_name": "transform_identity", "inputs": ["doc_id"]},
    {"id": "check", "fn_name": "validate_presence", "inputs": ["lang", "source"]},
    {"id": "fits", "fn_name": "validate_length", "inputs": ["lang", "_min", "_max"]},
    {"id": "store", "fn_name": "unknown", "inputs": ["check"]},
]


@query("""SELECT doc_id, '{"doc_id":' || doc_id || '}' AS entry, CASE WHEN coalesce(lang, '') = '' AND coalesce(source, '') = '' THEN '{"valid":false,"errors":["lang can''t be blank","source can''t be blank"]}' WHEN coalesce(lang, '') = '' THEN '{"valid":false,"errors":["lang can''t be blank"]}'
WHEN coalesce(source, '') = '' THEN '{"valid":false,"errors":["source can''t be blank"]}' ELSE '{"valid":true,"errors":[]}' END AS checked, CASE WHEN length(coalesce(lang, '')) < 2 THEN '{"valid":false,"errors":["lang is too short (min 2)"]}' WHEN length(lang) > 2 THEN '{"valid":false,"errors":["lang is too long (max 2)"]}' ELSE '{"valid":true,"errors":[]}' END AS fits,
'{"status":"no_executor","node":"store"}' AS result FROM documents""")
def executed_plan(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(2).alias("_min"), F.lit(2).alias("_max"))
    out = execute.execute(d, PLAN)
    return out.select("doc_id", F.element_at("results", "entry").alias("entry"), F.element_at("results", "check").alias("checked"), F.element_at("results", "fits").alias("fits"), "result")


@query("SELECT doc_id AS execution_id, step::int AS step, node_id, true AS success FROM documents, (VALUES (0, 'entry'), (1, 'check'), (2, 'fits'), (3, 'store')) AS v(step, node_id)")
def execution_log(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(2).alias("_min"), F.lit(2).alias("_max"))
    return execute.execution_log(execute.execute(d, PLAN), "doc_id").drop("result")


@query("SELECT doc_id, upper(lang) AS up, length(source) AS n FROM documents")
def layered(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    steps = {"L0": lambda x: x.withColumn("up", F.upper("lang")), "L1": lambda x: x.withColumn("bad", F.col("no_such_column")), "L2": lambda x: x.withColumn("n", F.length("source").cast("long"))}
    return execute.layers(d, steps)[0].select("doc_id", "up", "n")


@query("SELECT event_id, (event_id % 3 - 1)::int AS ttl, event_id % 3 = 0 AS expired, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'a' END AS trace FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 0, true, '' FROM events WHERE event_id % 3 = 0")
def packet_hops(spark, sf_dir):
    p = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("ttl"), F.lit(0).alias("sequence"), F.array().cast("array<string>").alias("trace"), F.lit("a").alias("target"))
    h = packets.hopped(p, F.lit("a"), F.lit("b"))
    return h.select("event_id", "ttl", F.col("error").isNotNull().alias("expired"), F.array_join("trace", ",").alias("trace"))


@query("SELECT n_name, sha256(n_name || '_create_entry')[1:16] AS short, sha256(n_name || '_create_entry')[1:32] AS long FROM nation")
def packet_topics(spark, sf_dir):
    entry = packets.entry_node(F.col("n_name"), F.lit("create"))
    return t(spark, sf_dir, "nation").select("n_name", packets.topic(entry).alias("short"), packets.topic(entry, 32).alias("long"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user with a sequence without gaps."""
    steps = trace.steps(log(spark, sf_dir)).select("event_id", F.col("step").cast("long").alias("seq"), "execution_id")
    return packets.topics(steps, "execute", F.col("execution_id").cast("string"))


STREAM = "st AS (SELECT event_id, 'execute:' || user_id AS topic, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) - 1 AS seq FROM events)"


@query(f"WITH {STREAM} SELECT event_id, topic FROM st QUALIFY max(seq) OVER (PARTITION BY topic) - seq < 5")
def retained_packets(spark, sf_dir):
    return packets.retained(streams(spark, sf_dir), most=5).select("event_id", "topic")


@query(f"WITH {STREAM} SELECT topic, count(*) AS n, count(*) >= 7 AS full FROM st GROUP BY 1")
def stream_lengths(spark, sf_dir):
    return packets.lengths(streams(spark, sf_dir), most=7)


@query(f"WITH {STREAM} SELECT event_id, topic FROM st WHERE seq > CASE WHEN topic LIKE '%1' THEN 1 ELSE -1 END AND seq <= CASE WHEN topic LIKE '%1' THEN 1 ELSE -1 END + 3")
def read_after(spark, sf_dir):
    s = streams(spark, sf_dir)
    offsets = s.where("topic like '%1'").select("topic", F.lit(1).cast("long").alias("last")).distinct()
    return packets.after(s, offsets, 3).select("event_id", "topic")


@query(f"""WITH a AS (SELECT r_name, {FP.format('r_name')} AS x FROM region), b AS (SELECT n_name, {FP.format('n_name')} AS y FROM nation), d AS (SELECT r_name, n_name, {HAMMING.format('x', 'y')} AS far FROM a, b),
k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY far, n_name) AS k FROM d) SELECT r_name, n_name AS target, 7::int AS ttl FROM k WHERE k <= 3""")
def packet_broadcast(spark, sf_dir):
    p = t(spark, sf_dir, "region").select("r_name", F.lit(8).alias("ttl"), F.lit(0).alias("sequence"), F.array().cast("array<string>").alias("trace"), F.lit("").alias("target"), V.fp_seed(F.col("r_name")).alias("resonance"))
    nodes = t(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), V.fp_seed(F.col("n_name")).alias("fp"))
    return packets.broadcast_targets(p, nodes, 3).select("r_name", "target", "ttl")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '{"valid":true,"errors":[]}' WHEN 'view' THEN '{"payload":"' || event_id || '"}' WHEN 'purchase' THEN '{"status":"no_executor","node":"purchase"}' END AS result FROM events""")
def executed_packets(spark, sf_dir):
    p = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("target"), F.col("event_id").cast("string").alias("payload"))
    nodes = spark.createDataFrame([("error", "validate_presence"), ("view", "transform_identity"), ("purchase", "charge")], "id string, fn_name string")
    return packets.executed(p, nodes, {}).select("event_id", "result")


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'PERSIST' ELSE 'OTHER' END || ':0' AS slot FROM supplier")
def node_slots(spark, sf_dir):
    rows = places(spark, sf_dir)[0].where("id like 's%'").withColumn("node_type", F.when(F.substring("id", 2, 9).cast("long") % 2 == 0, "PERSIST").otherwise("OTHER"))
    return packets.by_node_type(rows).select("id", "slot")


@query(f"""WITH {ITEMS}, p2 AS (SELECT [a, b] AS items, n FROM ip WHERE n >= 5),
p3 AS (SELECT [x.item, y.item, z.item] AS items, count(*) AS n FROM bk x JOIN bk y ON x.seq = y.seq AND x.item < y.item JOIN bk z ON x.seq = z.seq AND y.item < z.item GROUP BY 1 HAVING count(*) >= 5),
p4 AS (SELECT [x.item, y.item, z.item, w.item] AS items, count(*) AS n FROM bk x JOIN bk y ON x.seq = y.seq AND x.item < y.item JOIN bk z ON x.seq = z.seq AND y.item < z.item JOIN bk w ON x.seq = w.seq AND z.item < w.item GROUP BY 1 HAVING count(*) >= 5)
SELECT array_to_string(items, ',') AS items, n FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)""")
def frequent_itemsets(spark, sf_dir):
    """Sets of two to four kinds of line that five orders or more hold."""
    return mining.frequent_itemsets(many_items(spark, sf_dir), 5).select(F.array_join("items", ",").alias("items"), "n")


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, min({c})::varchar AS low, max({c})::varchar AS high, count(DISTINCT {c}) AS d FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
)


@query(f"SELECT column_name, n, nulls, low, high, true AS distinct_near, CASE WHEN low = high THEN 'ONE_VALUE' WHEN d < 0.5 * n THEN 'DICTIONARY' ELSE 'PLAIN' END AS encoding FROM ({_STATS})")
def table_stats(spark, sf_dir):
    """All columns of lineitem that are keys or flags, in one scan; the sketch of distinct values is held against an exact count."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in rows.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in rows.columns])))
    near = F.abs(F.col("distinct_about") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return mining.table_stats(rows).join(exact, "column_name").select("column_name", "n", "nulls", "low", "high", near.alias("distinct_near"), "encoding")


@query("SELECT o_orderkey, o_custkey, 2::bigint AS files_opened FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders UNION ALL SELECT max(o_orderkey) FROM orders)")
def clustered_lookup(spark, sf_dir):
    """The first and the last order by key out of eight clustered files, and how many of these were opened."""
    orders, path = t(spark, sf_dir, "orders"), f"{graph.shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    tables.write_clustered(orders, path, "o_orderkey", 8)
    ends = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    rows, files = tables.looked_up(spark, path, "o_orderkey", list(ends))
    return rows.select("o_orderkey", "o_custkey", F.lit(len(files)).cast("long").alias("files_opened"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 97 = 0""")
def bucketed_upsert(spark, sf_dir):
    """Customers after an upsert that rewrites only the buckets it touches; tests hold that other files stay."""
    customers = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    table = tables.BucketedTable.create(customers, f"{graph.shared_folder(spark)}/bucketed-{uuid.uuid4().hex}", ["c_custkey"], 32)
    some = customers.where("c_custkey % 97 = 0")
    table.upsert(some.withColumn("c_name", F.lit("changed")).union(some.select(F.col("c_custkey") + 1000000, F.lit("new"))))
    return table.read()


@query("""SELECT 1 AS version, c_custkey, c_acctbal FROM customer UNION ALL SELECT 2, c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END FROM customer UNION ALL SELECT 2, -1 - c_custkey, 0 FROM customer WHERE c_acctbal < 0""")
def table_versions(spark, sf_dir):
    """Both versions of a table that an upsert wrote anew: balances below zero are set to it and kept under a key of their own."""
    path = f"{graph.shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    first = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    owing = first.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    catalog.save_version(first, path, 1)
    catalog.save_version(catalog.upserted(first, owing.union(owing.select(-1 - F.col("c_custkey"), "c_acctbal")), ["c_custkey"]), path, 2)
    return catalog.load_version(spark, path, 1).select(F.lit(1).alias("version"), "*").union(catalog.load_version(spark, path).select(F.lit(2).alias("version"), "*"))


_TILED = "unhex(repeat(sha256({0}), 40)[1:2500])::bit"


@query(f"""WITH m AS (SELECT user_id, event_type, max(value) AS top FROM events GROUP BY ALL), p AS (SELECT user_id, string_agg(event_type || ':' || printf('%.2f', top), '|' ORDER BY event_type) AS profile FROM m GROUP BY 1),
s AS (SELECT user_id, string_agg(event_type, '→' ORDER BY ts, event_id) AS trace FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i <= 20 GROUP BY 1),
v AS (SELECT user_id, unhex({HEX.format("('user' || user_id)")})::bit AS a, {_TILED.format('profile')} AS b, {_TILED.format('trace')} AS c FROM p JOIN s USING (user_id))
SELECT user_id, sha256(((a & b) | (a & c) | (b & c))::blob) AS digest FROM v""")
def state_captures(spark, sf_dir):
    """Each user's moment: their vector, how strong each kind of event was, and their first twenty steps, captured in one vector."""
    events = t(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    top = events.groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    profile = top.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "top")))).alias("profile"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.withColumn("i", place).where("i <= 20").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]).alias("steps"))
    named = project.seeded(profile.select("user_id", F.concat(F.lit("user"), "user_id").alias("named")), "named").select("user_id", V.to_bytes(F.col("fp")).alias("state"))
    rows = named.join(profile, "user_id").join(steps, "user_id")
    return rows.select("user_id", F.sha2(project.capture_state(F.col("state"), F.col("profile"), F.col("steps")), 256).alias("digest"))


@query(f"WITH v AS (SELECT n_name, {FP.format('n_name')} AS a, {FP.format('r_name')} AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name, {HAMMING.format('a', 'b')}::int AS distance, round(1 - {HAMMING.format('a', 'b')} / 10000.0::double, 6) AS similarity FROM v")
def vectors_in_sql(spark, sf_dir):
    """Vector functions called from the text of a SQL node."""
    sqlfunctions.register(spark)
    for name in ("nation", "region"):
        t(spark, sf_dir, name).createOrReplaceTempView(f"vectors_{name}")
    text = "SELECT n_name, hamming(a, b) AS distance, round(fp_similarity(a, b), 6) AS similarity FROM (SELECT n_name, fp_seed(n_name) AS a, fp_seed(r_name) AS b FROM vectors_nation JOIN vectors_region ON n_regionkey = r_regionkey)"
    return catalog.sql_node(spark, text, [], {})


@query("""WITH f AS (SELECT p_partkey, 'def f' || p_partkey || '(a, b):' AS head FROM part)
SELECT 'part' || p_partkey AS path, 'FUNCTION' AS node_type, 'f' || p_partkey AS name, 2 AS param_count, 1 AS nesting_depth, CASE WHEN p_partkey > 1 THEN 'f' || (p_partkey - 1) ELSE 'print' END AS calls FROM f""")
def code_graph_in_sql(spark, sf_dir):
    """A Python source file for each part, parsed by a table function that SQL calls: its function, parameters, nesting and calls."""
    sqlfunctions.register(spark)
    k = F.col("p_partkey").cast("string")
    called = F.when(F.col("p_partkey") > 1, F.concat(F.lit("f"), (F.col("p_partkey") - 1).cast("string"))).otherwise("print")
    text = F.concat(F.lit("def f"), k, F.lit("(a, b):\n    if a:\n        return "), called, F.lit("(b)\n"))
    t(spark, sf_dir, "part").select(F.concat(F.lit("part"), k).alias("path"), text.alias("text")).createOrReplaceTempView("sql_files")
    return spark.sql("SELECT path, node_type, name, param_count, nesting_depth, array_join(calls, ',') AS calls FROM code_graph(TABLE(sql_files) PARTITION BY path) WHERE node_type = 'FUNCTION'")


_OBSERVED = "('obs::s' || s_suppkey % 12 || '::c' || s_nationkey % 2)"


@query(f"""WITH o AS (SELECT {_OBSERVED} AS identity, count(*) AS n FROM supplier GROUP BY 1), v AS (SELECT n, {FP.format('identity')} AS a FROM o),
p AS (SELECT i, 'obs::s' || i || '::c0' AS name FROM range(12) AS r(i)), q AS (SELECT name, (0.2 + i / 100)::double AS confidence, {FP.format('name')} AS b FROM p),
s AS (SELECT name, n, 1 - {HAMMING.format('a', 'b')} / 10000.0::double AS similarity FROM v, q)
SELECT q.name, round(least(1.0, confidence + 0.001::double * coalesce(sum(s.similarity * s.n), 0)), 6) AS confidence, coalesce(sum(s.n), 0)::bigint AS observations FROM q LEFT JOIN s ON q.name = s.name AND s.similarity > 0.7 GROUP BY q.name, confidence""")
def reinforced_by_vector(spark, sf_dir):
    """Patterns that are reinforced by what looks like them: suppliers as observations, by the fingerprint of what is seen of them."""
    seen = F.concat(F.lit("obs::s"), F.col("s_suppkey") % 12, F.lit("::c"), F.col("s_nationkey") % 2)
    observations = project.seeded(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), seen.alias("identity")), "identity")
    patterns = spark.range(12).select(F.concat(F.lit("obs::s"), "id", F.lit("::c0")).alias("name"), (0.2 + F.col("id") / 100).alias("confidence"))
    return mining.reinforce_alike(observations, project.seeded(patterns, "name"), 0.001).select("name", _r("confidence"), "observations")
