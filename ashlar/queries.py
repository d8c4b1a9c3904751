"""Registered queries of the engine's own operators on the driver's tables, each with SQL that computes the same rows.

Mappings: ``events`` is the execution log (node: event type, execution: user); nodes and edges of graphs are nations, regions,
suppliers and customers by key; baskets are the event types of a user's day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bitvec as V
from .functions import project, rules, truth
from .operators import bundle, causal, graph, learning, metrics, mining, search, smells, trace
from .plans import explain, suggest
from .sources import catalog, models
from .streaming import packets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("execution_id"), F.col("event_type").alias("node_id"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", "value is blank").alias("error"), "ts", "event_id")


def log_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type as a node; by rule pure unless it is an error, SQL if it is a purchase."""
    ids = t(spark, sf_dir, "events").select(F.col("event_type").alias("id")).distinct()
    return ids.select("id", (F.col("id") != "error").alias("pure"), (F.col("id") == "view").alias("parallelizable"), F.when(F.col("id") == "purchase", "SQL").otherwise("NATIVE").alias("executor"))


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, nations and regions as nodes; each points to where it lies."""
    nation, region, supplier = (t(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    s = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return s.select("id").union(n.select("id")).union(r), s.union(n).select(F.col("id").alias("src"), "dst")


PLACES = """
nodes AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
#: The bits of a seeded vector as words; bytes within a word are swapped, which no count of bits depends on.
FP = "list_transform(range(157), lambda i: ('0x' || CASE WHEN i = 156 THEN sha256({0} || ':' || i)[1:4] ELSE sha256({0} || ':' || i)[1:16] END)::ubigint)"
HAMMING = "list_sum(list_transform(list_zip({0}, {1}), lambda z: bit_count(xor(z[1], z[2]))))"
LOG = "log AS (SELECT user_id AS execution_id, event_type AS node_id, value AS duration_ms, event_type <> 'error' AS success, ts, event_id FROM events)"
LOG_NODES = "nodes AS (SELECT DISTINCT event_type AS id, event_type <> 'error' AS pure, event_type = 'view' AS parallelizable FROM events)"
STEPS = "steps AS (SELECT user_id AS execution_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS dst FROM events), edges AS (SELECT * FROM steps WHERE dst IS NOT NULL)"


# ---- bit-vectors


@query(f"""WITH v AS (SELECT n_name, r_name, {FP.format("n_name")} AS a, {FP.format("r_name")} AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name, r_name, {HAMMING.format("a", "b")}::bigint AS distance, round(1 - {HAMMING.format("a", "b")} / 10000.0::double, 6) AS similarity FROM v""")
def fp_hamming_pairs(spark, sf_dir):
    pairs = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    v = pairs.select("n_name", "r_name", V.fp_seed(F.col("n_name")).alias("a"), V.fp_seed(F.col("r_name")).alias("b"))
    return v.select("n_name", "r_name", V.hamming(F.col("a"), F.col("b")).cast("long").alias("distance"), F.round(V.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"SELECT n_name, list_sum(list_transform({FP.format('n_name')}, lambda x: bit_count(x)))::bigint AS bits FROM nation")
def popcount_nation(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", V.popcount(V.fp_seed(F.col("n_name"))).cast("long").alias("bits"))


@query(f"""WITH v AS (SELECT n_regionkey, unnest({FP.format("n_name")}) AS w, generate_subscripts({FP.format("n_name")}, 1) AS i FROM nation),
x AS (SELECT n_regionkey, i, bit_xor(w) AS w FROM v GROUP BY n_regionkey, i) SELECT n_regionkey, sum(bit_count(w))::bigint AS bits FROM x GROUP BY n_regionkey""")
def xor_reduce_region(spark, sf_dir):
    v = t(spark, sf_dir, "nation").select("n_regionkey", V.fp_seed(F.col("n_name")).alias("fp"))
    return bundle.xor_reduce(v, "n_regionkey").select("n_regionkey", V.popcount(F.col("fp")).cast("long").alias("bits"))


@query(f"""WITH v AS (SELECT n_regionkey, unnest({FP.format("n_name")}) AS w, generate_subscripts({FP.format("n_name")}, 1) AS i FROM nation),
bits AS (SELECT n_regionkey, i, b, sum(((w >> b) & 1)::int) AS c, count(*) AS n FROM v, (SELECT unnest(range(64)) AS b) GROUP BY n_regionkey, i, b)
SELECT n_regionkey, any_value(n)::bigint AS n, count(*) FILTER (2 * c > n)::bigint AS bits FROM bits GROUP BY n_regionkey""")
def bundle_region(spark, sf_dir):
    v = t(spark, sf_dir, "nation").select("n_regionkey", V.fp_seed(F.col("n_name")).alias("fp"))
    return bundle.majority(v, "n_regionkey").select("n_regionkey", "n", V.popcount(F.col("fp")).cast("long").alias("bits"))


@query(f"""WITH v AS (SELECT c_custkey AS idx, {FP.format("c_name")} AS a, {FP.format("'query'")} AS q FROM customer)
SELECT idx::bigint AS idx, {HAMMING.format("a", "q")}::bigint AS distance FROM v ORDER BY distance, idx LIMIT 10""")
def knn_hamming(spark, sf_dir):
    v = project.seeded(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), "c_name"), "c_name").select("idx", "fp")
    return search.knn(v, "query", 10).select("idx", F.col("distance").cast("long").alias("distance"))


@query(f"""WITH v AS (SELECT s_suppkey AS idx, {FP.format("s_name")} AS a, {FP.format("'query'")} AS q FROM supplier)
SELECT idx::bigint AS idx, round(1 - {HAMMING.format("a", "q")} / 10000.0::double, 6) AS similarity FROM v WHERE 1 - {HAMMING.format("a", "q")} / 10000.0::double >= 0.5""")
def resonate_threshold(spark, sf_dir):
    v = project.seeded(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), "s_name"), "s_name").select("idx", "fp")
    return search.resonate(v, "query", 0.5).select("idx", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH q AS (SELECT n_nationkey AS query_id, {FP.format("n_name")} AS a FROM nation), c AS (SELECT s_suppkey AS idx, {FP.format("s_name")} AS b FROM supplier),
d AS (SELECT query_id, idx, {HAMMING.format("a", "b")} AS distance FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, idx) AS rank FROM d)
SELECT query_id::bigint AS query_id, idx::bigint AS idx, distance::bigint AS distance, rank::int AS rank FROM r WHERE rank <= 3""")
def knn_join(spark, sf_dir):
    q = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), V.fp_seed(F.col("n_name")).alias("fp"))
    c = project.seeded(t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), "s_name"), "s_name")
    return search.knn_join(q, c, 3)


@query("SELECT n_name, ('0x' || sha256(unhex(repeat(sha256(n_name), 40)[1:2500]))[1:12])::bigint AS address FROM nation")
def cam_address(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_name", V.cam48(V.fp_tile(F.col("n_name"))).alias("address"))


@query("SELECT sha256(text) AS text_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"))
    return docs.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# ---- execution log


@query("SELECT event_type AS node_id, count(*) AS executions, round(avg(value), 6) AS avg_duration, max(value) AS max_duration, (count(*) FILTER (event_type = 'error'))::bigint AS failures FROM events GROUP BY 1")
def slowest_nodes(spark, sf_dir):
    return trace.slowest_nodes(log(spark, sf_dir), None).withColumn("avg_duration", F.round("avg_duration", 6))


@query(f"WITH {LOG} SELECT execution_id, node_id, event_id FROM log WHERE NOT success ORDER BY ts DESC LIMIT 1")
def last_failure(spark, sf_dir):
    return trace.last_failure(log(spark, sf_dir)).select("execution_id", "node_id", "event_id")


@query(f"WITH {LOG} SELECT event_id, node_id FROM log WHERE NOT success AND node_id <> 'view' ORDER BY ts DESC LIMIT 10")
def failures_of_others(spark, sf_dir):
    return trace.failures_of_others(log(spark, sf_dir), "view").select("event_id", "node_id")


@query(f"WITH {LOG} SELECT execution_id, string_agg(node_id, '>' ORDER BY ts) AS path, count(*) AS n_steps FROM log GROUP BY 1")
def trace_paths(spark, sf_dir):
    return trace.trace_paths(log(spark, sf_dir)).select("execution_id", F.array_join("path", ">").alias("path"), "n_steps")


@query(f"WITH {LOG} SELECT execution_id, max(ts) AS last_ts FROM log WHERE success AND node_id = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def recent_successes(spark, sf_dir):
    return trace.recent_successes(log(spark, sf_dir), "purchase")


@query(f"WITH {STEPS}, {LOG_NODES}, l AS (SELECT DISTINCT src, dst FROM edges) SELECT x.dst AS a, y.dst AS b, x.src AS src FROM l x JOIN l y ON x.src = y.src AND x.dst < y.dst JOIN nodes m ON m.id = x.dst AND m.pure AND NOT m.parallelizable JOIN nodes n ON n.id = y.dst AND n.pure")
def co_target_pairs(spark, sf_dir):
    return trace.co_targets(trace.transitions(log(spark, sf_dir)), log_nodes(spark, sf_dir))


@query("SELECT event_type AS node_id, count(*) AS calls, round(avg(value), 6) AS avg_ms FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) > 10 AND avg(value) > 5 ORDER BY count(*) * avg(value) DESC LIMIT 5")
def cache_candidates(spark, sf_dir):
    return trace.cache_candidates(log(spark, sf_dir), log_nodes(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""WITH s AS (SELECT event_type AS id, count(*) AS n, avg(value) AS a, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT id AS node_id, 'fix_errors' AS action, round(1 + f / n::double, 6) AS speedup FROM s WHERE f / n::double > 0.1 UNION ALL SELECT id, 'cache', round(least(a / 0.1, 100), 6) FROM s WHERE id <> 'error' AND a > 10 UNION ALL SELECT id, 'add_index', 5.0 FROM s WHERE id = 'purchase' AND a > 50""")
def performance_rules(spark, sf_dir):
    return trace.performance_rules(log(spark, sf_dir), log_nodes(spark, sf_dir), 100).withColumn("speedup", F.round("speedup", 6))


@query(f"""WITH RECURSIVE {LOG}, {STEPS}, l AS (SELECT DISTINCT src, dst FROM edges), f AS (SELECT * FROM log WHERE NOT success ORDER BY ts DESC, execution_id, node_id LIMIT 1),
up(id, h) AS (SELECT src, 1 FROM l WHERE dst = (SELECT node_id FROM f) UNION SELECT src, h + 1 FROM up JOIN l ON dst = id WHERE h < 3),
u AS (SELECT coalesce(list(DISTINCT id ORDER BY id), []) AS ids FROM up WHERE id <> (SELECT node_id FROM f)),
o AS (SELECT success, row_number() OVER (ORDER BY ts, success) - 1 AS k FROM log WHERE execution_id = (SELECT execution_id FROM f)), a AS (SELECT min(k) AS failed_at FROM o WHERE NOT success),
n AS (SELECT count(*) - 1 AS before FROM log WHERE NOT success AND node_id = (SELECT node_id FROM f)),
k AS (SELECT *, lower(CASE WHEN NOT success THEN 'value is blank' ELSE 'unknown' END) AS e FROM f)
SELECT k.execution_id, k.node_id, before AS failures_before, failed_at::bigint AS failed_at, array_to_string(ids, ',') AS upstream,
  CASE WHEN regexp_matches(e, 'blank|null|empty') THEN 'missing_input' WHEN regexp_matches(e, 'too short|too long') THEN 'length' WHEN regexp_matches(e, 'unique|duplicate') THEN 'uniqueness' ELSE 'execution' END AS kind,
  CASE WHEN regexp_matches(e, 'blank|null|empty') THEN array_to_string(ids[1:3], ',') ELSE '' END AS sources, before >= 2 AS recurring, failed_at = 0 AS first_step,
  CASE WHEN regexp_matches(e, 'blank|null|empty') THEN 'provide_input' WHEN before >= 2 THEN 'validate_upstream' WHEN regexp_matches(e, 'too short|too long') THEN 'check_length' ELSE 'review_path' END AS suggestion FROM k, u, a, n""")
def explain_last_failure(spark, sf_dir):
    steps = trace.transitions(log(spark, sf_dir)).select("src", "dst").distinct()
    found = explain.explain_last(log(spark, sf_dir), steps)
    return found.select("execution_id", "node_id", "failures_before", F.col("failed_at").cast("long").alias("failed_at"), F.array_join("upstream", ",").alias("upstream"), "cause.kind", F.array_join("cause.sources", ",").alias("sources"), "cause.recurring", "cause.first_step", "suggestion")


# ---- catalog


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'sm_ll%'")
def prefix_like(spark, sf_dir):
    return catalog.prefixed(t(spark, sf_dir, "part").withColumn("id", F.col("p_name")), "sm_ll%").select("p_partkey", "p_name")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def dependency_counts(spark, sf_dir):
    return catalog.dependency_counts(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src")))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return catalog.latest(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer")
def upsert(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return catalog.upserted(rows, rows.where("c_custkey % 10 = 0").withColumn("segment", F.lit("changed")), ["c_custkey"])


# ---- graphs


@query(f"WITH {PLACES} SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS fan_out, (SELECT count(*) FROM edges WHERE dst = id) AS fan_in FROM nodes")
def fan_in_out(spark, sf_dir):
    return graph.degrees(*places(spark, sf_dir))


@query(f"WITH {PLACES} SELECT 'r' || r_regionkey AS start, e.src AS id, 1 AS hops FROM region JOIN edges e ON e.dst = 'r' || r_regionkey UNION SELECT 'r' || r_regionkey, f.src, 2 FROM region JOIN edges e ON e.dst = 'r' || r_regionkey JOIN edges f ON f.dst = e.src")
def upstream_hops(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    return graph.upstream(nodes.where("id like 'r%'"), edges, 3)


@query(f"WITH {STEPS}, l AS (SELECT DISTINCT src, dst FROM edges) SELECT 'all' AS key, round((SELECT count(*) FROM l) / (count(*) * (count(*) - 1))::double, 6) AS cohesion FROM (SELECT DISTINCT event_type FROM events)")
def cohesion(spark, sf_dir):
    steps = trace.transitions(log(spark, sf_dir)).select("src", "dst").distinct()
    return graph.cohesion(log_nodes(spark, sf_dir).select(F.lit("all").alias("key"), "id"), steps).withColumn("cohesion", F.round("cohesion", 6))


# ---- mining and learning

BASKETS = "baskets AS (SELECT DISTINCT user_id, ts::date AS day, event_type AS item FROM events)"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("items"))
    return days.select(F.concat_ws(" ", "user_id", "day").alias("seq"), "items")


@query(f"WITH {BASKETS} SELECT x.item AS a, y.item AS b, count(*) AS n FROM baskets x JOIN baskets y ON x.user_id = y.user_id AND x.day = y.day AND x.item < y.item GROUP BY ALL")
def cooccurring_pairs(spark, sf_dir):
    return mining.pair_counts(baskets(spark, sf_dir))


@query(f"WITH {STEPS}, p AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL), r AS (SELECT x AS src, count(*) AS m FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT p.src, dst, round(n / m::double, 6) AS strength FROM p JOIN r ON p.src = r.src WHERE n / m::double > 0.1")
def correlations(spark, sf_dir):
    return mining.correlations(trace.transitions(log(spark, sf_dir)), 0.1).withColumn("strength", F.round("strength", 6))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'decay' ELSE 'observe' END AS k FROM events),
f AS (SELECT user_id, list_reduce(list_prepend({'k': '', 'c': 0.5::double, 'n': 0::bigint}, list({'k': k, 'c': 0.0::double, 'n': 0::bigint} ORDER BY event_id)),
  lambda s, x: {'k': '', 'c': CASE x.k WHEN 'observe' THEN least(1.0, s.c + 0.1::double) WHEN 'good' THEN least(1.0, s.c + 0.2::double) WHEN 'bad' THEN greatest(0.1, s.c - 0.15::double) ELSE s.c * CASE WHEN s.n < 3 THEN 0.855::double ELSE 0.95::double END END, 'n': s.n + CASE x.k WHEN 'observe' THEN 1 ELSE 0 END}) AS r FROM e GROUP BY user_id)
SELECT user_id AS name, round(r.c, 6) AS confidence, r.n AS observations FROM f""")
def pattern_fold(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "view", "decay").otherwise("observe")
    folded = learning.fold(e.select(F.col("user_id").alias("name"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(0.1).alias("amount")))
    return folded.select("name", F.round("confidence", 6).alias("confidence"), "observations")


@query("""WITH x AS (SELECT user_id, ts, event_id, 0.05::double AS amount, CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' ELSE 'observe' END AS k FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events)),
e AS (SELECT * FROM x UNION ALL SELECT user_id, unnest(generate_series(first + INTERVAL 1 DAY, (SELECT date_trunc('day', max(ts)) FROM events), INTERVAL 1 DAY)) AS ts, NULL, 0, 'decay' FROM (SELECT user_id, date_trunc('day', min(ts)) AS first FROM x GROUP BY user_id)),
f AS (SELECT user_id, list_reduce(list_prepend({'k': '', 'c': 0.5::double, 'n': 0::bigint}, list({'k': k, 'c': amount::double, 'n': 0::bigint} ORDER BY ts, event_id NULLS FIRST)),
  lambda s, x: {'k': '', 'c': CASE x.k WHEN 'observe' THEN least(1.0, s.c + x.c) WHEN 'good' THEN least(1.0, s.c + 0.2::double) WHEN 'bad' THEN greatest(0.1, s.c - 0.15::double) ELSE s.c * CASE WHEN s.n < 3 THEN 0.855::double ELSE 0.95::double END END, 'n': s.n + CASE x.k WHEN 'observe' THEN 1 ELSE 0 END}) AS r FROM e GROUP BY user_id)
SELECT user_id AS name, round(r.c, 6) AS confidence, r.n AS observations FROM f""")
def pattern_epochs(spark, sf_dir):
    """Users learned from day to day, each day ending in a decay: what streaming.learning tells after the last whole day."""
    e = t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").otherwise("observe")
    until = F.lit(e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    timed = learning.with_epochs(e.select(F.col("user_id").alias("name"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(0.05).alias("amount")), 24, until)
    return learning.fold(timed).select("name", F.round("confidence", 6).alias("confidence"), "observations")


# ---- rules and evidence


@query("SELECT doc_id, coalesce(lang, '') <> '' AS has_lang, length(text) >= 100 AND length(text) <= 5000 AS fits FROM documents")
def validation(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", rules.presence(F.col("lang"), "lang")["valid"].alias("has_lang"), rules.length(F.col("text"), "text", 100, 5000)["valid"].alias("fits"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'blank') OR contains(lower(text), 'null') OR contains(lower(text), 'empty') THEN 'missing_input' WHEN contains(lower(text), 'too short') OR contains(lower(text), 'too long') THEN 'length'
WHEN contains(lower(text), 'unique') OR contains(lower(text), 'duplicate') THEN 'uniqueness' ELSE 'execution' END AS kind FROM documents""")
def error_classes(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", rules.error_class(F.col("text")).alias("kind"))


_INTENT_SQL = " || ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(p_name), '{w}')''' for w in words)} THEN ['{label}'] ELSE [] END" for label, words, _ in rules.NAME_INTENTS)


@query(f"SELECT p_partkey, array_to_string({_INTENT_SQL} || CASE WHEN {' OR '.join(f'''contains(lower(p_type), '{w}')''' for w in rules.BODY_INTENT[1])} THEN ['error_handling'] ELSE [] END || CASE WHEN p_size > 3 THEN ['orchestration'] ELSE [] END, ',') AS intents FROM part")
def intents(spark, sf_dir):
    found = rules.intents(F.col("p_name"), F.col("p_type"), F.col("p_size"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: x["intent"]), ",").alias("intents"))


@query("""WITH x AS (SELECT doc_id, quality::double AS f1, 0.8::double AS c1, (1 - toxic)::double AS f2, 0.6::double AS c2 FROM labels)
SELECT doc_id, round((c1 * (1 - c2) * f1 + c2 * (1 - c1) * f2) / (c1 * (1 - c2) + c2 * (1 - c1)), 6) AS frequency, round(least(0.99, (c1 + c2) / (1 + c1 + c2)), 6) AS confidence FROM x""")
def truth_revision(spark, sf_dir):
    both = truth.revision(truth.truth(F.col("quality").cast("double"), 0.8), truth.truth((1 - F.col("toxic")).cast("double"), 0.6))
    return t(spark, sf_dir, "labels").select("doc_id", both.alias("t")).select("doc_id", F.round("t.frequency", 6).alias("frequency"), F.round("t.confidence", 6).alias("confidence"))


# ---- packets


@query("SELECT event_id, 8 AS ttl, 5 AS priority, (event_id % 60000)::int AS sequence, sha256(event_type)[1:16] AS topic, true AS intact FROM events")
def packet_roundtrip(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    source, target = packets.node_hash(F.col("user_id").cast("string")), packets.node_hash(F.col("event_type"))
    header = packets.pack(source, target, F.lit(8), F.lit(5), F.lit(1), F.col("event_id") % 60000)
    u = e.select("event_id", "event_type", packets.unpack(header).alias("u"))
    return u.select("event_id", "u.ttl", "u.priority", "u.sequence", packets.topic(F.col("event_type")).alias("topic"), F.col("u.error").isNull().alias("intact"))


@query("SELECT 's' || s_suppkey AS id, 'r' || n_regionkey AS target, 6 AS ttl, 2 AS sequence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def packet_routing(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    start = nodes.where("id like 's%'").select("id", F.lit(8).alias("ttl"), F.lit(0).alias("sequence"), F.col("id").alias("target"))
    return packets.delivered(start, edges).select("id", "target", "ttl", "sequence")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS node_id, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("ts"), F.col("event_type").alias("node_id"))
    return packets.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents""")
def document_copies(spark, sf_dir):
    """Flagship: exact fingerprint groups of the documents, joined back."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.join(d.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "key").select("doc_id", "copies")


# ---- sources and structure


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model class per nation; those of two words in their name have no readable class."""
    body = F.concat(F.lit("class "), "n_name", F.lit(" < ApplicationRecord\n  belongs_to :region\n  validates :name, presence: true, length: { maximum: 25 }\n"), F.when(F.col("n_regionkey") == 2, "  before_save :check\n").otherwise(""), F.lit("end\n"))
    return t(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit(".rb")).alias("path"), body.alias("text"))


@query("""WITH m AS (SELECT n_name AS model, n_regionkey = 2 AS calls FROM nation WHERE NOT contains(n_name, ' '))
SELECT model, model || '_' || o || '_entry' AS id, 'TRIGGER' AS node_type, 'transform_identity' AS fn_name FROM m, (VALUES ('create'), ('update'), ('destroy')) AS v(o)
UNION ALL SELECT model, model || '_validate_name_presence_0', 'VALIDATE', 'validate_presence' FROM m UNION ALL SELECT model, model || '_validate_name_length_1', 'VALIDATE', 'validate_length' FROM m
UNION ALL SELECT model, model || '_before_save_check', 'TRIGGER', 'check' FROM m WHERE calls UNION ALL SELECT model, model || '_persist', 'PERSIST', 'persist_' || lower(model) FROM m""")
def model_nodes(spark, sf_dir):
    return models.compiled(model_files(spark, sf_dir))[0]


@query("""WITH m AS (SELECT n_name AS model, n_regionkey = 2 AS calls FROM nation WHERE NOT contains(n_name, ' '))
SELECT model, model || '_create_entry' AS src, model || '_validate_name_presence_0' AS dst, 'TRIGGERS' AS edge_type FROM m
UNION ALL SELECT model, model || '_validate_name_presence_0', model || '_validate_name_length_1', 'FEEDS' FROM m
UNION ALL SELECT model, model || '_validate_name_length_1', model || '_before_save_check', 'TRIGGERS' FROM m WHERE calls
UNION ALL SELECT model, model || CASE WHEN calls THEN '_before_save_check' ELSE '_validate_name_length_1' END, model || '_persist', 'FEEDS' FROM m""")
def model_edges(spark, sf_dir):
    return models.compiled(model_files(spark, sf_dir))[1]


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code nodes: every fifth by size a class, the others methods."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "CLASS").otherwise("METHOD")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), kind.alias("node_type"), F.col("p_name").alias("name"), F.col("p_type").alias("body"), size.cast("int").alias("line_count"), (size % 8).cast("int").alias("param_count"), (size % 6).cast("int").alias("nesting_depth"))


@query("""WITH p AS (SELECT p_size, p_size % 5 <> 0 AS own FROM part), m AS (SELECT (count(*) FILTER (own))::bigint AS total_methods, (count(*) FILTER (NOT own))::bigint AS total_classes,
round(avg(p_size) FILTER (own), 6) AS avg_method_length, round(avg(p_size % 8) FILTER (own), 6) AS avg_params, (max(p_size % 6) FILTER (own))::int AS max_nesting FROM p)
SELECT *, round(total_methods / total_classes::double, 6) AS methods_per_class FROM m""")
def code_metrics(spark, sf_dir):
    m = metrics.quality_metrics(part_code(spark, sf_dir))
    return m.select("total_methods", "total_classes", *[F.round(c, 6).alias(c) for c in ("avg_method_length", "avg_params")], "max_nesting", F.round("methods_per_class", 6).alias("methods_per_class"))


@query("SELECT 'LONG_PARAMETER_LIST' AS smell, p_partkey::bigint AS id, round((p_size % 8) / 10.0::double, 6) AS confidence FROM part WHERE p_size % 5 <> 0 AND p_size % 8 > 5")
def long_parameter_lists(spark, sf_dir):
    return smells.long_parameter_list(part_code(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("SELECT 'n' || n_nationkey AS id, 1 + count(s_suppkey) FILTER (s_suppkey % 2 = 0) AS cyclomatic FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def cyclomatic(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    kind = F.when(F.col("id").startswith("n"), "METHOD").when(F.col("id").startswith("s") & (F.substring("id", 2, 9).cast("int") % 2 == 0), "IF").otherwise("EXPR")
    contains = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    return metrics.cyclomatic(nodes.withColumn("node_type", kind), contains)


@query("""WITH lg AS (SELECT user_id AS e, event_type AS n, event_id % 7 <> 0 AS ok, ts FROM events), f AS (SELECT * FROM lg WHERE NOT ok ORDER BY ts DESC, e, n LIMIT 1),
r AS (SELECT e, max(ts) AS t FROM lg WHERE ok AND n = (SELECT n FROM f) AND e <> (SELECT e FROM f) GROUP BY e ORDER BY t DESC, e LIMIT 3), p AS (SELECT e, list(n ORDER BY ts, n) AS path FROM lg GROUP BY e),
c AS (SELECT r.e, a.path AS good, b.path AS bad, (SELECT min(i) FROM range(least(len(a.path), len(b.path))) AS x(i) WHERE a.path[i + 1] <> b.path[i + 1]) AS part FROM r JOIN p a ON a.e = r.e JOIN p b ON b.e = (SELECT e FROM f))
SELECT (SELECT n FROM f) AS node_id, e::varchar AS success_id, CASE WHEN part IS NULL THEN 'check_input' ELSE 'investigate_divergence' END AS action, CASE WHEN part IS NULL THEN 0.7 ELSE 0.5 END::double AS confidence,
  CASE WHEN part IS NULL THEN 'the same path went well before: look at the input' ELSE 'paths part at step ' || part || ': ' || good[part + 1] || ' when it went well, ' || bad[part + 1] || ' when it failed' END AS description FROM c""")
def suggest_fixes(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("success", F.col("event_id") % 7 != 0)
    return suggest.suggest_fixes(rows, log_nodes(spark, sf_dir).select("id", F.lit("VALIDATE").alias("node_type")))


from . import queries_graph, queries_rows  # noqa: E402, F401  (they register their queries)
