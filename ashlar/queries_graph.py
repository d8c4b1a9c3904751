"""Registered queries of graph, smell, causal and model operators.

Graphs are drawn from the driver's tables by rule: ``web`` (suppliers, two ways out, cycles), its forward edges (acyclic), ``code`` (nations as classes,
suppliers as methods, customers as nested control flow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import causal, communities, graph, metrics, smells
from .queries import PLACES, model_files, places, query, t
from .sources import models


def web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    e = s.select(F.col("id").alias("src"), (F.col("id") * 2 % 50 + 1).alias("dst")).union(s.where("id % 3 <> 0").select("id", F.col("id") + 1)).distinct()
    return s, e.join(s.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def forward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = web(spark, sf_dir)
    return nodes, edges.where("src < dst")


WEB = """nodes AS (SELECT s_suppkey::bigint AS id FROM supplier),
drawn AS (SELECT id AS src, id * 2 % 50 + 1 AS dst FROM nodes UNION SELECT id, id + 1 FROM nodes WHERE id % 3 <> 0),
edges AS (SELECT src, dst FROM drawn WHERE dst IN (SELECT id FROM nodes))"""
REACH = "reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src)"
DAG = f"{WEB}, dag AS (SELECT src, dst FROM edges WHERE src < dst)"


@query(f"WITH RECURSIVE {WEB}, {REACH} SELECT id, least(id, (SELECT min(b) FROM reach r WHERE r.a = id AND EXISTS (SELECT 1 FROM reach s WHERE s.a = r.b AND s.b = id))) AS component FROM nodes")
def strong_components(spark, sf_dir):
    return graph.strong_components(*web(spark, sf_dir))


@query(f"""WITH RECURSIVE {WEB}, {REACH}, roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges))
SELECT id FROM roots UNION SELECT b FROM reach WHERE a IN (SELECT id FROM roots)""")
def live_nodes(spark, sf_dir):
    return graph.live_nodes(*web(spark, sf_dir))


@query(f"""WITH RECURSIVE {WEB}, {REACH} SELECT id FROM nodes WHERE id = 7 OR id IN (SELECT b FROM reach WHERE a = 7)""")
def reached_nodes(spark, sf_dir):
    nodes, edges = web(spark, sf_dir)
    return graph.reached(nodes.where("id = 7"), edges)


@query(f"WITH {WEB} SELECT dst AS id FROM edges WHERE src = 4")
def one_hop(spark, sf_dir):
    nodes, edges = web(spark, sf_dir)
    return graph.reach(nodes.where("id = 4"), edges, 1).where("hops = 1").select("id")


@query(f"WITH RECURSIVE {DAG}, walk(id, d) AS (SELECT id, 0 FROM nodes UNION SELECT dst, d + 1 FROM walk JOIN dag ON id = src) SELECT id, max(d)::int AS level FROM walk GROUP BY id")
def topo_levels(spark, sf_dir):
    return graph.levels(*forward(spark, sf_dir))


@query(f"""WITH RECURSIVE {DAG}, walk(id, d) AS (SELECT id, 0 FROM nodes UNION SELECT dst, d + 1 FROM walk JOIN dag ON id = src), needed(id) AS (SELECT 9::bigint UNION SELECT src FROM needed JOIN dag ON dst = id)
SELECT id, max(d)::int AS level FROM walk WHERE id IN (SELECT id FROM needed) GROUP BY id""")
def plan_for_target(spark, sf_dir):
    nodes, edges = forward(spark, sf_dir)
    return graph.plan_for(nodes.where("id = 9"), nodes, edges)


@query(f"""WITH RECURSIVE {DAG}, w(start, id, path) AS (SELECT id, id, [id] FROM nodes UNION ALL SELECT start, dst, list_append(path, dst) FROM w JOIN dag ON id = src),
ended AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY len(path), path) AS k FROM w WHERE id NOT IN (SELECT src FROM dag))
SELECT start, array_to_string(path, '>') AS path FROM ended WHERE k = 1""")
def path_to_terminal(spark, sf_dir):
    nodes, edges = forward(spark, sf_dir)
    return graph.path_to_terminal(nodes, edges).select("start", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(f"""WITH RECURSIVE {WEB}, w(id, path) AS (SELECT 1::bigint, [1::bigint] UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN edges ON id = src WHERE len(path) <= 8 AND NOT list_contains(path, dst)),
s AS (SELECT id, path, len(path) - min(len(path)) OVER (PARTITION BY id) AS more FROM w WHERE id % 10 = 0)
SELECT 1::bigint AS start, id AS "end", array_to_string(path, '>') AS path FROM s WHERE more = 0""")
def shortest_paths(spark, sf_dir):
    nodes, edges = web(spark, sf_dir)
    found = graph.shortest_paths(nodes.where("id = 1"), nodes.where("id % 10 = 0"), edges, 8)
    return found.select("start", "end", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(f"""WITH RECURSIVE {WEB}, w(start, id, path) AS (SELECT src, dst, [src, dst] FROM edges WHERE src < dst UNION ALL SELECT start, dst, list_append(path, dst) FROM w JOIN edges ON id = src WHERE dst > start AND NOT list_contains(path, dst) AND len(path) < 6)
SELECT array_to_string(path, '>') AS cycle, len(path)::int AS length FROM w JOIN edges ON id = src AND start = dst UNION ALL SELECT src::varchar, 1 FROM edges WHERE src = dst""")
def simple_cycles(spark, sf_dir):
    return graph.cycles(*web(spark, sf_dir), most=6).select(F.concat_ws(">", F.col("cycle").cast("array<string>")).alias("cycle"), "length")


@query("""WITH RECURSIVE nodes AS (SELECT s_suppkey::bigint AS id FROM supplier UNION ALL SELECT 100000 + n_nationkey FROM nation WHERE n_regionkey = 1),
edges AS (SELECT s_suppkey::bigint AS src, s_suppkey * 2 % 50 + 1 AS dst FROM supplier WHERE s_suppkey % 4 <> 0),
reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src)
SELECT DISTINCT 'orphan_edge' AS problem, dst AS id FROM edges WHERE dst NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'isolated', id FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 'cycle', id FROM nodes WHERE EXISTS (SELECT 1 FROM reach WHERE a = id AND b = id)
UNION ALL SELECT 'no_entry', NULL WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id NOT IN (SELECT dst FROM edges))
UNION ALL SELECT 'no_terminal', NULL WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id NOT IN (SELECT src FROM edges))""")
def validate_graph(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    nodes = s.union(t(spark, sf_dir, "nation").where("n_regionkey = 1").select((100000 + F.col("n_nationkey")).cast("long")))
    return graph.validate(nodes, s.where("id % 4 <> 0").select(F.col("id").alias("src"), (F.col("id") * 2 % 50 + 1).alias("dst")))


@query("""SELECT 's' || s_suppkey AS id, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1 AND bool_and(s_suppkey <> 5) OVER (PARTITION BY s_nationkey)""")
def co_located_groups(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    turned = edges.where("src like 's%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.parallel_groups(nodes.withColumn("pure", F.col("id") != "s5"), turned).select("id", "n")


@query("""WITH RECURSIVE n AS (SELECT s_suppkey::bigint AS id, s_suppkey % 10 < 5 AS x, s_suppkey % 7 <> 0 AS pure FROM supplier),
f AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.id = a.id + 1 AND a.id % 3 <> 0 AND a.x = b.x AND a.pure AND b.pure),
w(id, head) AS (SELECT id, id FROM n WHERE id NOT IN (SELECT dst FROM f) UNION ALL SELECT dst, head FROM w JOIN f ON id = src) SELECT id, head FROM w""")
def fused_chains(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    nodes = s.select("id", (F.col("id") % 7 != 0).alias("pure"), F.when(F.col("id") % 10 < 5, "A").otherwise("B").alias("executor"))
    edges = s.where("id % 3 <> 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return graph.fuse(nodes, edges)


@query(f"""WITH {PLACES} SELECT id FROM nodes WHERE id LIKE 's1_%' AND id <> 's12' UNION ALL SELECT 'new_r' || r_regionkey FROM region WHERE r_regionkey < 2""")
def composed_graph(spark, sf_dir):
    nodes, edges = places(spark, sf_dir)
    return graph.composed(nodes, edges, "s1", "new", ["s12"], [nodes.where("id in ('r0', 'r1')")])[0]


@query("""SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || ' → ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, 2, r_name || ' → ' || n_name || ' → ' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hierarchical_paths(spark, sf_dir):
    return graph.containment(*_named_places(spark, sf_dir))


def _named_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, region, supplier = (t(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    named = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    named = named.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name")).union(region.select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    _, edges = places(spark, sf_dir)
    return named, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


# ---- code graphs


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c, n = (t(spark, sf_dir, x) for x in ("supplier", "customer", "nation"))
    k, size = F.col("s_suppkey").cast("long"), s.agg(F.count(F.lit(1)).alias("size"))
    methods = s.select(
        F.concat(F.lit("m"), "s_suppkey").alias("id"), F.lit("METHOD").alias("node_type"), F.when(k % 10 == 1, "main").otherwise(F.concat(F.lit("m"), "s_suppkey")).alias("name"),
        F.when(k % 5 == 0, "same").otherwise(F.concat(F.lit("body"), "s_suppkey")).alias("body"), (k * 13 % 120).cast("int").alias("line_count"), (k % 9).cast("int").alias("param_count"), (k % 6).cast("int").alias("nesting_depth"),
    )
    plain = lambda rows, id_, kind: rows.select(id_.alias("id"), F.lit(kind).alias("node_type"), F.lower(F.lit(kind)).alias("name"), F.lit("").alias("body"), F.lit(1).alias("line_count"), F.lit(0).alias("param_count"), F.lit(0).alias("nesting_depth"))
    nodes = methods.union(plain(n, F.concat(F.lit("c"), "n_nationkey"), "CLASS")).union(plain(c, F.concat(F.lit("i"), "c_custkey"), "IF"))
    own = s.crossJoin(F.broadcast(size))  # one row
    m = lambda x: F.concat(F.lit("m"), x.cast("string"))
    calls = own.select(m(k).alias("src"), F.explode(F.array_compact(F.array(k * 7 % F.col("size"), F.when(k % 2 == 0, k * 3 % F.col("size")), F.when(k % 11 == 0, k * 5 % F.col("size")), F.when(k % 11 == 0, k * 17 % F.col("size"))))).alias("to"))
    calls = calls.select("src", m(F.col("to")).alias("dst"), F.lit("CALLS").alias("edge_type"))
    holds = s.select(F.concat(F.lit("c"), "s_nationkey").alias("src"), m(k).alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    u = F.col("c_custkey").cast("long")
    flow = c.crossJoin(F.broadcast(size)).select(F.when(u % 6 == 1, m(u % F.col("size"))).otherwise(F.concat(F.lit("i"), (u - 1).cast("string"))).alias("src"), F.concat(F.lit("i"), "c_custkey").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    return nodes, calls.union(holds).union(flow)


CODE = """z AS (SELECT count(*) AS size FROM supplier),
cn AS (SELECT 'm' || s_suppkey AS id, 'METHOD' AS node_type, CASE WHEN s_suppkey % 10 = 1 THEN 'main' ELSE 'm' || s_suppkey END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'same' ELSE 'body' || s_suppkey END AS body, s_suppkey * 13 % 120 AS line_count, s_suppkey % 9 AS param_count, s_suppkey % 6 AS nesting_depth FROM supplier
  UNION ALL SELECT 'c' || n_nationkey, 'CLASS', 'class', '', 1, 0, 0 FROM nation UNION ALL SELECT 'i' || c_custkey, 'IF', 'if', '', 1, 0, 0 FROM customer),
calls AS (SELECT 'm' || s_suppkey AS src, 'm' || (s_suppkey * 7 % size) AS dst FROM supplier, z UNION ALL SELECT 'm' || s_suppkey, 'm' || (s_suppkey * 3 % size) FROM supplier, z WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'm' || s_suppkey, 'm' || (s_suppkey * 5 % size) FROM supplier, z WHERE s_suppkey % 11 = 0 UNION ALL SELECT 'm' || s_suppkey, 'm' || (s_suppkey * 17 % size) FROM supplier, z WHERE s_suppkey % 11 = 0),
own AS (SELECT 'c' || s_nationkey AS owner, 'm' || s_suppkey AS id FROM supplier),
flow AS (SELECT CASE WHEN c_custkey % 6 = 1 THEN 'm' || (c_custkey % size) ELSE 'i' || (c_custkey - 1) END AS src, 'i' || c_custkey AS dst FROM customer, z),
creach(a, b) AS (SELECT src, dst FROM calls UNION SELECT a, dst FROM creach JOIN calls ON b = src),
deep(root, id, d) AS (SELECT id, id, 0 FROM cn WHERE node_type = 'METHOD' UNION ALL SELECT root, dst, d + 1 FROM deep JOIN flow ON id = src),
cyclo AS (SELECT root AS id, count(*) AS cc FROM deep GROUP BY root)"""
_R = lambda x: f"round(({x})::double, 6)"


def smell(sql: str):
    return query(f"WITH RECURSIVE {CODE} {sql}")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("confidence", F.round("confidence", 6))


@smell(f"""SELECT 'GOD_OBJECT' AS smell, owner AS id, {_R("least((m / 15.0 + f / 30.0) / 2, 1.0)")} AS confidence FROM (SELECT owner, count(*) AS m, sum((SELECT count(DISTINCT dst) FROM calls WHERE src = own.id)) AS f FROM own GROUP BY owner) WHERE m > 10 OR f > 20""")
def smell_god_object(spark, sf_dir):
    return _rounded(smells.god_object(*code(spark, sf_dir)))


@smell(f"SELECT 'SPAGHETTI' AS smell, NULL::varchar AS id, {_R('least(c / n / 4.0, 1.0)')} AS confidence FROM (SELECT (SELECT count(*) FROM calls)::double AS c, (SELECT count(*) FROM cn WHERE node_type = 'METHOD' AND id LIKE 'm1%')::double AS n) WHERE c / n > 2")
def smell_spaghetti(spark, sf_dir):
    nodes, edges = code(spark, sf_dir)
    return _rounded(smells.spaghetti(nodes.where("id like 'm1%'"), edges))


@smell("SELECT src AS id, count(*) AS degree FROM (SELECT src FROM calls UNION ALL SELECT dst FROM calls) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def tangled_nodes(spark, sf_dir):
    return smells.tangled(*code(spark, sf_dir))


@smell("""SELECT 'CIRCULAR_DEPENDENCY' AS smell, min(least(c.id, r.b)) AS id, 1.0::double AS confidence FROM (SELECT c.id, min(r.b) AS b FROM cn c JOIN creach r ON r.a = c.id JOIN creach s ON s.a = r.b AND s.b = c.id WHERE r.b <> c.id GROUP BY c.id) AS r(id, b) JOIN cn c ON c.id = r.id GROUP BY least(r.id, r.b)""")
def smell_circular(spark, sf_dir):
    return smells.circular(*code(spark, sf_dir))


@smell(f"""SELECT 'FEATURE_ENVY' AS smell, id, {_R("least(e / (e + i + 1.0), 1.0)")} AS confidence FROM (SELECT o.id, count(*) FILTER (p.owner IS DISTINCT FROM o.owner) AS e, count(*) FILTER (p.owner = o.owner) AS i FROM own o JOIN (SELECT DISTINCT src, dst FROM calls) k ON k.src = o.id LEFT JOIN own p ON p.id = k.dst GROUP BY o.id) WHERE e > i AND e > 2""")
def smell_feature_envy(spark, sf_dir):
    return _rounded(smells.feature_envy(*code(spark, sf_dir)))


@smell(f"SELECT 'ARROW_CODE' AS smell, root AS id, {_R('least(max(d) / 6.0, 1.0)')} AS confidence FROM deep GROUP BY root HAVING max(d) >= 4")
def smell_arrow_code(spark, sf_dir):
    return _rounded(smells.arrow_code(*code(spark, sf_dir)))


@smell("SELECT 'COPY_PASTE' AS smell, id, 1.0::double AS confidence FROM (SELECT id, min(id) OVER (PARTITION BY body) AS first FROM cn WHERE body <> '') WHERE id <> first")
def smell_copy_paste(spark, sf_dir):
    return smells.copy_paste(code(spark, sf_dir)[0])


@smell(f"SELECT 'LONG_METHOD' AS smell, id, {_R('least(line_count / 100.0, 1.0)')} AS confidence FROM cn WHERE node_type = 'METHOD' AND line_count > 50")
def smell_long_method(spark, sf_dir):
    return _rounded(smells.long_method(code(spark, sf_dir)[0]))


@smell(f"SELECT 'LONG_PARAMETER_LIST' AS smell, id, {_R('least(param_count / 10.0, 1.0)')} AS confidence FROM cn WHERE node_type = 'METHOD' AND param_count > 5")
def smell_long_parameters(spark, sf_dir):
    return _rounded(smells.long_parameter_list(code(spark, sf_dir)[0]))


@smell("SELECT 'DEAD_CODE' AS smell, id, 0.8::double AS confidence FROM cn WHERE node_type = 'METHOD' AND name <> 'main' AND id NOT IN (SELECT dst FROM calls WHERE NOT regexp_matches(src, '[05]$'))")
def smell_dead_code(spark, sf_dir):
    """Methods that nothing calls once the calls of every fifth method are gone."""
    nodes, edges = code(spark, sf_dir)
    return smells.dead_code(nodes, edges.where("edge_type <> 'CALLS' OR src NOT RLIKE '[05]$'"))


NODE_SMELLS = f"""ns AS (SELECT 'GOD_CLASS' AS smell, owner AS id, {_R("least(count(*) / 20.0, 1.0)")} AS confidence FROM own GROUP BY owner HAVING count(*) > 10
UNION ALL SELECT 'LAZY_CLASS', c.id, 0.8 FROM cn c WHERE node_type = 'CLASS' AND (SELECT count(*) FROM own WHERE owner = c.id) < 2
UNION ALL SELECT 'LONG_METHOD', id, {_R("least(cc / 20.0, 1.0)")} FROM cyclo WHERE cc > 10
UNION ALL SELECT 'FEATURE_ENVY', src, {_R("least(count(*) / 10.0, 1.0)")} FROM calls GROUP BY src HAVING count(*) > 5
UNION ALL SELECT 'SPAGHETTI', owner, {_R("least(c / (n * 5.0), 1.0)")} FROM (SELECT owner, count(*) AS n, (SELECT count(*) FROM calls k JOIN own x ON x.id = k.src JOIN own y ON y.id = k.dst WHERE x.owner = o.owner AND y.owner = o.owner) AS c FROM own o GROUP BY owner) WHERE c > 2 * n)"""


@query(f"WITH RECURSIVE {CODE}, {NODE_SMELLS} SELECT smell, id, confidence FROM ns")
def node_smells(spark, sf_dir):
    return _rounded(smells.node_smells(*code(spark, sf_dir)))


@query(f"WITH RECURSIVE {CODE}, {NODE_SMELLS} SELECT smell, row_number() OVER (PARTITION BY smell ORDER BY confidence DESC, id)::int AS place, id, confidence FROM ns")
def ranked_smells(spark, sf_dir):
    return smells.ranked(_rounded(smells.node_smells(*code(spark, sf_dir))))


COUPLED = """lk AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst), pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM lk),
cp AS (SELECT a, b, least(1.0, 0.5 + 0.1 * (SELECT count(*) FROM lk x JOIN lk y ON x.dst = y.dst WHERE x.src = a AND y.src = b) + 0.4 * (SELECT (m.body = n.body)::int FROM cn m, cn n WHERE m.id = a AND n.id = b)) AS coupling FROM pr)"""


@query(f"WITH RECURSIVE {CODE}, {COUPLED} SELECT a, b, round(coupling::double, 6) AS coupling FROM cp")
def coupled_pairs(spark, sf_dir):
    return metrics.coupled_pairs(*code(spark, sf_dir)).withColumn("coupling", F.round("coupling", 6))


@query(f"""WITH RECURSIVE {CODE}, {NODE_SMELLS}, {COUPLED}
SELECT id, CASE smell WHEN 'GOD_CLASS' THEN 'extract_class' WHEN 'LONG_METHOD' THEN 'extract_method' WHEN 'FEATURE_ENVY' THEN 'move_method' ELSE 'inline_class' END AS action, NULL::varchar AS other FROM ns WHERE confidence > 0.5 AND smell <> 'SPAGHETTI'
UNION ALL SELECT a, 'reduce_coupling', b FROM cp WHERE coupling > 0.7 UNION ALL SELECT b, 'reduce_coupling', a FROM cp WHERE coupling > 0.7""")
def refactorings(spark, sf_dir):
    return smells.refactorings(*code(spark, sf_dir))


@smell("""SELECT id, (i + 1) * (o + 1) * cc AS score FROM (SELECT c.id, (SELECT count(*) FROM calls WHERE dst = c.id) AS i, (SELECT count(*) FROM calls WHERE src = c.id) AS o, coalesce(k.cc, 1) AS cc FROM cn c LEFT JOIN cyclo k ON k.id = c.id WHERE node_type IN ('METHOD', 'CLASS')) ORDER BY score DESC, id LIMIT 10""")
def hotspots(spark, sf_dir):
    return metrics.hotspots(*code(spark, sf_dir))


@smell("SELECT id, cc AS cyclomatic FROM cyclo")
def cyclomatic_methods(spark, sf_dir):
    return metrics.cyclomatic(*code(spark, sf_dir)).withColumn("cyclomatic", F.col("cyclomatic").cast("long"))


@smell(f"SELECT {_R('(SELECT count(*) FROM calls) / (SELECT count(*)::double FROM cn)')} AS mean_fan_out, (SELECT count(DISTINCT r.a) FROM creach r JOIN creach s ON s.a = r.b AND s.b = r.a WHERE r.a <> r.b) AS n_cyclic")
def tangledness(spark, sf_dir):
    return metrics.tangledness(*code(spark, sf_dir)).select(F.round("mean_fan_out", 6).alias("mean_fan_out"), "n_cyclic")


@smell(f"""SELECT place::int AS place, urgency, about, {_R("value")} AS value, bound::double AS bound FROM (SELECT 2 AS place, 'HIGH' AS urgency, 'LONG_METHOD' AS about, NULL AS value, NULL AS bound WHERE EXISTS (SELECT 1 FROM cn WHERE node_type = 'METHOD' AND line_count > 50)
UNION ALL SELECT 5, 'LOW', 'DEAD_CODE', NULL, NULL WHERE EXISTS (SELECT 1 FROM cn WHERE node_type = 'METHOD' AND name <> 'main' AND id NOT IN (SELECT dst FROM calls))
UNION ALL SELECT 6, 'HIGH', 'avg_method_length', avg(line_count), 30 FROM cn WHERE node_type = 'METHOD' HAVING avg(line_count) > 30
UNION ALL SELECT 7, 'MEDIUM', 'avg_params', avg(param_count), 4 FROM cn WHERE node_type = 'METHOD' HAVING avg(param_count) > 4
UNION ALL SELECT 8, 'HIGH', 'methods_per_class', (SELECT count(*) FROM supplier) / count(*)::double, 10 FROM nation HAVING (SELECT count(*) FROM supplier) / count(*)::double > 10)""")
def recommendations(spark, sf_dir):
    nodes, edges = code(spark, sf_dir)
    return metrics.recommendations(smells.long_method(nodes).union(smells.dead_code(nodes, edges)), metrics.quality_metrics(nodes)).withColumn("value", F.round("value", 6))


@smell(f"""SELECT {_R("greatest(0, least(100, 100 - 5 * (SELECT count(*) FROM cn WHERE node_type = 'METHOD' AND line_count > 110) - greatest((SELECT avg(line_count) FROM cn WHERE node_type = 'METHOD') - 30, 0) * 0.5 - greatest((SELECT max(nesting_depth) FROM cn WHERE node_type = 'METHOD') - 4, 0) * 3))")} AS score""")
def audit_score(spark, sf_dir):
    nodes, _ = code(spark, sf_dir)
    return metrics.score(smells.long_method(nodes.where("line_count > 110")), metrics.quality_metrics(nodes)).select(F.round("score", 6).alias("score"))


@smell("""SELECT 'LONG_METHOD' AS smell, id, 'new' AS change FROM cn WHERE node_type = 'METHOD' AND line_count > 50 AND param_count <= 5 UNION ALL SELECT 'LONG_METHOD', id, 'fixed' FROM cn WHERE node_type = 'METHOD' AND param_count > 5 AND line_count <= 50""")
def audit_delta(spark, sf_dir):
    nodes, _ = code(spark, sf_dir)
    before = smells.long_parameter_list(nodes).withColumn("smell", F.lit("LONG_METHOD"))
    return smells.delta(before, smells.long_method(nodes))


# ---- causal tracing

CAUSES = f"""{WEB}, ce AS (SELECT src, dst, 0.4 + (src * 7 + dst) % 6 / 10.0::double AS c, 1 + src % 4 / 2.0::double AS m, (src + dst) % 9 AS l FROM edges WHERE src <> dst)"""
CHAINS = """w(start, id, hops, path, c, m, l) AS (SELECT id, id, 0, [id], 1.0::double, 1.0::double, 0::bigint FROM nodes WHERE id % 5 = 1
UNION ALL SELECT start, dst, hops + 1, list_append(path, dst), w.c * ce.c, w.m * ce.m, w.l + ce.l FROM w JOIN ce ON w.id = ce.src WHERE NOT list_contains(path, dst) AND w.c * ce.c >= 0.3 AND hops < 10)"""
BACK = CHAINS.replace("dst, hops", "ce.src, hops").replace("list_append(path, dst)", "list_append(path, ce.src)").replace("w.id = ce.src", "w.id = ce.dst").replace("list_contains(path, dst)", "list_contains(path, ce.src)")
BEST = "f AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY hops, c DESC, path) AS r FROM w WHERE hops > 0)"


def causes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starts, edges with confidences of 0.4 to 0.9, and criticality of the nodes of even id."""
    nodes, edges = web(spark, sf_dir)
    e = edges.where("src <> dst").select("src", "dst", (F.lit(0.4) + (F.col("src") * 7 + F.col("dst")) % 6 / 10).alias("confidence"), (1 + F.col("src") % 4 / 2).alias("amplification"), ((F.col("src") + F.col("dst")) % 9).alias("latency"))
    return nodes.where("id % 5 = 1"), e, nodes.where("id % 2 = 0").select("id", (F.col("id") % 10 / 10).alias("criticality"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("start", "id", F.col("hops").cast("int").alias("hops"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), F.round("confidence", 6).alias("confidence"), F.round("amplification", 6).alias("amplification"), "latency")


_EFFECT = "start, id, hops::int AS hops, array_to_string({0}, '>') AS path, round(c, 6) AS confidence, round(m, 6) AS amplification, l AS latency"


@query(f"WITH RECURSIVE {CAUSES}, {CHAINS} SELECT {_EFFECT.format('path')} FROM w WHERE hops > 0")
def causal_chains(spark, sf_dir):
    return _shown(causal.chains(*causes(spark, sf_dir)[:2]))


@query(f"WITH RECURSIVE {CAUSES}, {CHAINS}, {BEST} SELECT {_EFFECT.format('path')} FROM f WHERE r = 1")
def causal_effects(spark, sf_dir):
    return _shown(causal.effects(*causes(spark, sf_dir)[:2]))


@query(f"WITH RECURSIVE {CAUSES}, {BACK}, {BEST} SELECT {_EFFECT.format('list_reverse(path)')} FROM f WHERE r = 1")
def root_causes(spark, sf_dir):
    return _shown(causal.root_causes(*causes(spark, sf_dir)[:2]))


@query(f"""WITH RECURSIVE {CAUSES}, {CHAINS}, {BEST} SELECT start, id, hops::int AS hops, round(m, 6) AS amplification, round(m * CASE WHEN id % 2 = 0 THEN id % 10 / 10.0 ELSE 0.5 END * c, 6) AS criticality FROM f WHERE r = 1 AND m >= 5""")
def butterflies(spark, sf_dir):
    b = causal.butterflies(*causes(spark, sf_dir))
    return b.select("start", "id", F.col("hops").cast("int").alias("hops"), F.round("amplification", 6).alias("amplification"), F.round("criticality", 6).alias("criticality"))


@query(f"""WITH RECURSIVE {CAUSES}, {CHAINS}, {BEST}, g AS (SELECT start, id, hops, round(m, 9) AS m, m > 2 AND m * CASE WHEN id % 2 = 0 THEN id % 10 / 10.0 ELSE 0.5 END > 1 AS crit FROM f WHERE r = 1),
top AS (SELECT start, string_agg(id, ',' ORDER BY m DESC, id) AS critical FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY m DESC, id) AS k FROM g WHERE crit) WHERE k <= 5 GROUP BY start)
SELECT g.start, count(*) FILTER (hops = 1) AS direct, count(*) FILTER (hops > 1) AS indirect, count(*) AS reach, max(hops)::int AS max_depth, round(max(m), 6) AS max_amplification, coalesce(any_value(critical), '') AS critical FROM g LEFT JOIN top ON g.start = top.start GROUP BY g.start""")
def impact(spark, sf_dir):
    found = causal.impact(*causes(spark, sf_dir))
    return found.select("start", "direct", "indirect", "reach", F.col("max_depth").cast("int").alias("max_depth"), F.round("max_amplification", 6).alias("max_amplification"), F.array_join(F.col("critical").cast("array<string>"), ",").alias("critical"))


# ---- models

MODELS = "m AS (SELECT n_name AS model, n_regionkey = 2 AS calls FROM nation WHERE NOT contains(n_name, ' ')), o(op) AS (VALUES ('create'), ('update'), ('destroy')), b AS (SELECT *, CASE op WHEN 'destroy' THEN model || '_destroy' ELSE model || '_persist' END AS last FROM m, o)"


@query(f"""WITH {MODELS} SELECT model, op AS operation, model || '_' || op || '_entry' AS id, 'entry' AS phase, 'entry' AS kind, true AS pure, true AS parallelizable FROM b
UNION ALL SELECT model, op, model || '_validate_name_' || t || '_' || i, 'validate', 'validation', true, true FROM b, (VALUES ('presence', 0), ('length', 1)) AS v(t, i)
UNION ALL SELECT model, op, model || '_before_save_check', 'before_callback', 'callback', false, false FROM b WHERE calls UNION ALL SELECT model, op, last, 'persist', 'persist', false, false FROM b""")
def semantic_nodes(spark, sf_dir):
    return models.semantic(model_files(spark, sf_dir))[0].select("model", "operation", "id", "phase", "kind", "pure", "parallelizable")


SEMANTIC_EDGES = f"""{MODELS}, se AS (SELECT model, op, model || '_' || op || '_entry' AS src, model || '_before_save_check' AS dst, 'control_flow' AS kind, NULL::varchar AS field FROM b WHERE calls
UNION ALL SELECT model, op, CASE WHEN calls THEN model || '_before_save_check' ELSE model || '_' || op || '_entry' END, model || '_validate_name_' || t, 'data_flow', 'name' FROM b, (VALUES ('presence_0'), ('length_1')) AS v(t)
UNION ALL SELECT model, op, model || '_validate_name_' || t, last, 'control_flow', NULL FROM b, (VALUES ('presence_0'), ('length_1')) AS v(t))"""


@query(f"WITH {SEMANTIC_EDGES} SELECT op AS operation, src, dst, kind, field FROM se")
def semantic_edges(spark, sf_dir):
    return models.semantic(model_files(spark, sf_dir))[1].drop("path")


@query(f"WITH {SEMANTIC_EDGES} SELECT op AS operation, src, dst, CASE kind WHEN 'data_flow' THEN 'FEEDS' ELSE 'TRIGGERS' END AS edge_type FROM se")
def lowered_edges(spark, sf_dir):
    return models.lowered(*models.semantic(model_files(spark, sf_dir)))[1].drop("field")


@query(f"""WITH {MODELS} SELECT op AS operation, model || '_' || op || '_entry' AS id, 'TRIGGER' AS node_type, 'NATIVE' AS executor, 'transform_identity' AS fn_name, 1 AS cost, '_input' AS inputs FROM b
UNION ALL SELECT op, model || '_validate_name_' || t || '_' || i, 'VALIDATE', 'NATIVE', 'validate_' || t, 2, 'name' FROM b, (VALUES ('presence', 0), ('length', 1)) AS v(t, i)
UNION ALL SELECT op, model || '_before_save_check', 'TRIGGER', 'NATIVE', 'check', 5, '_input' FROM b WHERE calls UNION ALL SELECT op, last, 'PERSIST', 'SQL', 'persist_' || op, 10, '_input' FROM b""")
def lowered_nodes(spark, sf_dir):
    return models.lowered(*models.semantic(model_files(spark, sf_dir)))[0].select("operation", "id", "node_type", "executor", "fn_name", "cost", F.array_join("inputs", ",").alias("inputs"))


@query(f"WITH {MODELS} SELECT model || '_validate_name_' || t || '_' || i AS id FROM m, (VALUES ('presence', 0), ('length', 1)) AS v(t, i)")
def cacheable_nodes(spark, sf_dir):
    nodes = models.lowered(*models.semantic(model_files(spark, sf_dir)))[0].where("operation = 'create'")
    return graph.cacheable(nodes).select("id")


@query(f"WITH {SEMANTIC_EDGES} SELECT dst AS id, 'name' AS fields FROM se WHERE kind = 'data_flow' AND op = 'create'")
def data_flow_fields(spark, sf_dir):
    edges = models.semantic(model_files(spark, sf_dir))[1].where("operation = 'create'")
    return graph.data_flow_fields(edges).select("id", F.array_join("fields", ",").alias("fields"))


@query("""WITH m(id, stage) AS (VALUES ('_create_entry', 0), ('_before_save_check', 1), ('_validate_name_presence_0', 2), ('_validate_name_length_1', 2), ('_persist', 3)) SELECT n_name || id AS id, CASE WHEN n_regionkey = 2 OR stage = 0 THEN stage ELSE stage - 1 END::int AS stage FROM m, nation WHERE n_nationkey = 7 AND (n_regionkey = 2 OR id <> '_before_save_check')""")
def execution_stages(spark, sf_dir):
    nodes, edges = models.semantic(model_files(spark, sf_dir).where("path = '7.rb'"))
    return graph.stages(nodes.where("operation = 'create'"), edges.where("operation = 'create'"), models.PHASES)


@query(f"""WITH {SEMANTIC_EDGES}, e AS (SELECT src, dst FROM se WHERE op = 'create'), n AS (SELECT model || '_create_entry' AS id, 'TRIGGER|executor:NATIVE|pure:True|parallel:True|cost:1' AS h FROM m
UNION ALL SELECT model || '_validate_name_' || t, 'VALIDATE|executor:NATIVE|pure:True|parallel:True|cost:2' FROM m, (VALUES ('presence_0'), ('length_1')) AS v(t)
UNION ALL SELECT model || '_before_save_check', 'TRIGGER|executor:NATIVE|pure:False|parallel:False|cost:5' FROM m WHERE calls UNION ALL SELECT model || '_persist', 'PERSIST|executor:SQL|pure:False|parallel:False|cost:10' FROM m)
SELECT id, 'type:' || h || '|out:' || (SELECT count(*) FROM e WHERE src = id) || '|in:' || (SELECT count(*) FROM e WHERE dst = id) || '|out_ids:' || coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = id), '') || '|in_ids:' || coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = id), '') AS structure FROM n""")
def structural_texts(spark, sf_dir):
    nodes, edges = models.lowered(*models.semantic(model_files(spark, sf_dir)))
    return models.structural_text(nodes.where("operation = 'create'"), edges.where("operation = 'create'")).select("id", "structure")


@query("""WITH p AS (SELECT DISTINCT least(s_nationkey, s_suppkey % 25) AS a, greatest(s_nationkey, s_suppkey % 25) AS b FROM supplier WHERE s_nationkey <> s_suppkey % 25),
l AS (SELECT n_nationkey AS id, n_regionkey AS community FROM nation), z AS (SELECT 2.0::double * count(*) AS total FROM p), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
d AS (SELECT x.community, count(*)::double AS degree, sum((x.community = y.community)::int)::double AS within FROM u JOIN l x ON x.id = u.a JOIN l y ON y.id = u.b GROUP BY 1)
SELECT community::bigint AS community, (SELECT count(*) FROM l WHERE l.community = d.community) AS n_nodes, (within / 2)::bigint AS inside, round(within / total - (degree / total) ** 2, 6) AS share FROM d, z""")
def region_modularity(spark, sf_dir):
    """How well regions part the graph of nations that suppliers draw."""
    edges = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") % 25).cast("long").alias("dst"))
    labels = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("community"))
    return communities.modularity(edges, labels).withColumn("share", F.round("share", 6))
