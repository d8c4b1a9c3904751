import random

import pytest
from pyspark.sql import functions as F

from ashlar import queries
from ashlar.operators import causal, graph, learning, mining, smells


def frames(spark, edges, nodes=()):
    ids = sorted({x for e in edges for x in e} | set(nodes))
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string")


def test_reach_levels_and_components_against_brute_force(spark):
    random.seed(3)
    edges = [(f"n{random.randrange(12)}", f"n{random.randrange(12)}") for _ in range(16)]
    nodes, links = frames(spark, edges, ["alone"])
    near = {(a, 0, a) for a in {x for e in edges for x in e} | {"alone"}}
    hops = {(s, x): d for s, d, x in near}
    while True:
        more = {(s, b): d + 1 for (s, a), d in hops.items() for x, b in edges if x == a and (s, b) not in hops}
        if not more:
            break
        hops |= {k: min(d for kk, d in more.items() if kk == k) for k in more}
    got = {(r.start, r.id): r.hops for r in graph.reach(nodes, links).collect()}
    assert got.keys() == hops.keys() and got == hops
    for last in (graph.LAST_EDGES, 0):  # in one task, and by colouring alone
        parts = {r.id: r.component for r in graph.strong_components(nodes, links, last).collect()}
        assert parts == {a: min(b for b in parts if (a, b) in hops and (b, a) in hops) for a in parts}
    assert {r.id for r in graph.reached(nodes.where("id = 'n1'"), links).collect()} == {b for a, b in hops if a == "n1"}


def test_components_of_long_ways_take_few_jobs(spark):
    """A ring with a chord, a tail and a second ring behind it: colouring alone took a turn for each node of a ring."""
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(150, 20), (7, 500)] + [(500 + i, 501 + i) for i in range(40)] + [(540, 520)]
    nodes, links = spark.range(600), spark.createDataFrame(edges, "src long, dst long")
    want = {i: 0 if i < 200 else 520 if 520 <= i <= 540 else i for i in range(600)}
    for last, jobs in ((graph.LAST_EDGES, 20), (60, 150)):
        spark.sparkContext.setJobGroup(f"components-{last}", "")
        assert {r.id: r.component for r in graph.strong_components(nodes, links, last).collect()} == want
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{last}")) < jobs
    spark.sparkContext._jsc.sc().clearJobGroup()


def test_levels_paths_and_marks(spark):
    nodes, links = frames(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")])
    assert {r.id: r.level for r in graph.levels(nodes, links, "stop").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None}
    assert {r.id: r.level for r in graph.levels(nodes, links).collect()}["y"] > {r.id: r.level for r in graph.levels(nodes, links).collect()}["x"]
    assert [r.path for r in graph.path_to_terminal(nodes.where("id = 'a'"), links).collect()] == [["a", "b", "d"]]
    assert graph.path_to_terminal(nodes.where("id = 'x'"), links).collect() == []
    assert {(r.problem, r.id) for r in graph.validate(nodes, links).collect()} == {("cycle", "x"), ("cycle", "y")}
    assert {r.id for r in graph.live_nodes(nodes, links).collect()} == {"a", "b", "c", "d"}
    pure = nodes.select("id", F.lit(True).alias("pure"), F.lit("N").alias("executor"))
    assert sorted((r.id, r.n) for r in graph.parallel_groups(pure, links).collect()) == [("b", 2), ("c", 2)]
    chain, steps = frames(spark, [(f"k{i}", f"k{i + 1}") for i in range(9)])
    pure = chain.select("id", F.lit(True).alias("pure"), F.lit("N").alias("executor"))
    assert {r.head for r in graph.fuse(pure, steps).collect()} == {"k0"}


def code(spark, nodes, edges):
    rows = [(i, t, n, b, lc, pc) for i, t, n, b, lc, pc in nodes]
    return spark.createDataFrame(rows, "id long, node_type string, name string, body string, line_count int, param_count int"), spark.createDataFrame(edges, "src long, dst long, edge_type string")


def test_smells(spark):
    nodes = [(0, "CLASS", "God", "", 10, 0)] + [(i, "METHOD", f"m{i}", "", 10, 0) for i in range(1, 16)]
    nodes += [(20, "FUNCTION", "main", "", 150, 12), (21, "FUNCTION", "dead", "copy", 1, 0), (22, "FUNCTION", "again", "copy", 1, 0)]
    nodes += [(30 + d, "IF", "if", "", 1, 0) for d in range(5)]
    edges = [(0, i, "CONTAINS") for i in range(1, 16)] + [(i, 1 + (i + k) % 15, "CALLS") for i in range(1, 16) for k in (0, 1, 2)]
    edges += [(20, 30, "CONTAINS")] + [(30 + d, 31 + d, "CONTAINS") for d in range(4)]
    n, e = code(spark, nodes, edges)
    found = {(r.smell, r.id): round(r.confidence, 6) for r in smells.analyze(n, e).collect()}
    assert found[("GOD_OBJECT", 0)] == 1.0 and found[("CIRCULAR_DEPENDENCY", 1)] == 1.0 and found[("ARROW_CODE", 20)] == round(5 / 6, 6)
    assert found[("LONG_METHOD", 20)] == found[("LONG_PARAMETER_LIST", 20)] == 1.0 and found[("COPY_PASTE", 22)] == 1.0
    assert found[("DEAD_CODE", 21)] == 0.8 and ("DEAD_CODE", 20) not in found
    assert {r.change for r in smells.delta(smells.long_method(n), smells.dead_code(n, e)).collect()} == {"new", "fixed"}


def test_feature_envy(spark):
    nodes = [(1, "CLASS", "A", "", 1, 0), (2, "CLASS", "B", "", 1, 0), *[(10 + i, "METHOD", f"a{i}", "", 1, 0) for i in range(2)], *[(20 + i, "METHOD", f"b{i}", "", 1, 0) for i in range(4)]]
    edges = [(1, 10, "CONTAINS"), (1, 11, "CONTAINS"), *[(2, 20 + i, "CONTAINS") for i in range(4)], (10, 11, "CALLS"), *[(10, 20 + i, "CALLS") for i in range(4)]]
    assert [(r.id, round(r.confidence, 6)) for r in smells.feature_envy(*code(spark, nodes, edges)).collect()] == [(10, round(4 / 6, 6))]


def test_rule_mining(spark):
    g, lm, fe, cd, ss, dn, sp = "GOD_CLASS LONG_METHOD FEATURE_ENVY CIRCULAR_DEPENDENCY SHOTGUN_SURGERY DEEP_NESTING SPAGHETTI".split()
    baskets = [[g, lm]] * 3 + [[g, lm, fe]] * 2 + [[cd, ss], [cd, ss, fe]] + [[dn, lm]] * 2 + [[dn, lm, sp]]
    df = spark.createDataFrame(list(enumerate(baskets)), "seq long, items array<string>")
    assert sorted((r.a, r.b, r.n) for r in mining.implications(df).collect()) == [(dn, lm, 3), (g, lm, 5)]
    strengths = {(r.item, r.other): round(r.strength, 6) for r in mining.propagation(df).collect()}
    # baskets with both over those with the first in sorted order: FEATURE_ENVY (3 baskets) comes before GOD_CLASS (5)
    assert strengths[(g, lm)] == strengths[(lm, g)] == 1.0 and strengths[(g, fe)] == strengths[(fe, g)] == round(2 / 3, 6)
    rules = spark.createDataFrame([("x", [lm]), (g, [lm, fe]), (g, [lm, sp]), (lm, [])], "source string, targets array<string>")
    assert sorted((r.source, r.confirmed) for r in mining.fanout_confirmed(df, rules).collect()) == [(g, False), (g, True), (lm, True), ("x", False)]
    patterns = spark.createDataFrame([("god", [g, lm, fe], 0.8)], "name string, items array<string>, confidence double")
    learned = spark.createDataFrame(list(enumerate([[g, lm, fe], [g, lm], [dn, sp, lm], [cd, ss], [g, fe]])), "seq long, items array<string>")
    r = mining.reinforce(learned, patterns).first()
    assert r.confidence == 1.0 and r.observations == 3
    asked = spark.createDataFrame([(1, [g])], "seq long, items array<string>")
    assert {x.item for x in mining.predict_missing(asked, patterns).collect()} == {lm, fe}
    assert all(not {x.a, x.b} <= {g, lm, fe} for x in mining.emerging_patterns(df, patterns).collect())


def test_fold_keeps_the_order(spark):
    events = [("p", 1, "observe", 0.6), ("p", 2, "bad", 0.0), ("p", 3, "decay", 0.0), ("p", 4, "good", 0.0)]
    r = learning.fold(spark.createDataFrame(events[::-1], "name string, seq long, kind string, amount double")).first()
    assert abs(r.confidence - ((1.0 - 0.15) * 0.855 + 0.2)) < 1e-9 and r.observations == 1


CAUSES = [("config_change", "validation_rules", 1.0), ("validation_rules", "database_schema", 2.0), ("database_schema", "cache_layer", 1.5), ("cache_layer", "api_endpoints", 3.0), ("api_endpoints", "user_sessions", 2.0), ("config_change", "cache_layer", 1.0)]


def test_causal_graph(spark):
    edges = spark.createDataFrame([(a, b, 0.8, m, 1) for a, b, m in CAUSES], "src string, dst string, confidence double, amplification double, latency long")
    starts, criticality = spark.sql("SELECT 'config_change' AS id"), spark.createDataFrame([("user_sessions", 1.0)], "id string, criticality double")
    two = {(r.hops, round(r.confidence, 5), r.amplification) for r in causal.chains(starts, edges).where("id = 'user_sessions'").collect()}
    assert two == {(3, 0.512, 6.0), (5, 0.32768, 18.0)}
    assert [round(r.criticality, 3) for r in causal.butterflies(starts, edges, criticality).where("id = 'user_sessions'").collect()] == [3.072]
    back = {r.id: r.path for r in causal.root_causes(spark.sql("SELECT 'user_sessions' AS id"), edges).collect()}
    assert back["config_change"] == ["config_change", "cache_layer", "api_endpoints", "user_sessions"]
    seen = spark.createDataFrame([(1, "a", "b", 0.5), (2, "a", "b", 0.9), (3, "a", "b", 0.1)], "seq long, src string, dst string, confidence double")
    assert round(causal.reinforced(seen).first().confidence, 6) == 0.7


def test_weak_edges_are_pruned_and_longer_surer_ways_lead_on(spark):
    # the direct way to b is weak, so only the longer way through c leads on to d
    links = [("a", "b", 0.4), ("a", "c", 0.9), ("c", "b", 0.9), ("b", "d", 0.7), ("d", "a", 1.0), ("a", "z", 0.5), ("z", "y", 0.5)]
    edges = spark.createDataFrame([(a, b, c, 2.0, 1) for a, b, c in links], "src string, dst string, confidence double, amplification double, latency long")
    got = {r.id: (r.hops, r.path, round(r.confidence, 6)) for r in causal.effects(spark.sql("SELECT 'a' AS id"), edges).collect()}
    assert got == {"b": (1, ["a", "b"], 0.4), "c": (1, ["a", "c"], 0.9), "d": (3, ["a", "c", "b", "d"], 0.567), "z": (1, ["a", "z"], 0.5)}
    report = causal.impact(spark.sql("SELECT 'a' AS id"), edges, spark.createDataFrame([("d", 0.9)], "id string, criticality double")).first()
    assert (report.direct, report.indirect, report.reach, report.max_depth, report.max_amplification, report.critical) == (3, 1, 4, 3, 8.0, ["d"])


def test_cycles_stages_and_shortest_paths(spark):
    nodes, links = frames(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "c"), ("c", "d")])
    assert sorted(r.cycle for r in graph.cycles(nodes, links).collect()) == [["a", "b"], ["a", "b", "c"], ["c"]]
    phased = nodes.select("id", F.when(F.col("id") == "d", "late").otherwise("early").alias("phase"), (F.col("id") != "b").alias("parallelizable"))
    _, dag = frames(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert {r.id: r.stage for r in graph.stages(phased, dag, ("early", "late")).collect()} == {"a": 0, "c": 1, "b": 2, "d": 3}
    assert {r.id: r.stage for r in graph.stages(phased, links.where("src <> dst"), ("early", "late")).collect()} == {"c": 0, "b": 1, "d": 2, "a": 3}
    both = graph.shortest_paths(nodes.where("id = 'a'"), nodes.where("id = 'd'"), dag)
    assert sorted(r.path for r in both.collect()) == [["a", "b", "d"], ["a", "c", "d"]]


def test_containment_of_any_depth(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", f"x{i}") for i in range(106)] + [("c1", "c1"), ("c2", "c2")], "id string, name string")
    contains = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(105)] + [("c1", "c2"), ("c2", "c1")], "src string, dst string")
    got = {r.id: (r.depth, r.path) for r in graph.containment(nodes, contains).collect()}
    assert got == {f"n{i:03}": (i, " → ".join(f"x{k}" for k in range(i + 1))) for i in range(106)}


def test_arrow_code_of_any_depth_and_on_cycles(spark):
    kinds = {"m": "METHOD", "f": "FUNCTION", "g": "FUNCTION", **{f"b{i}": "BLOCK" for i in range(66)}, **{f"i{i}": "IF" for i in range(4)}, "w": "WHILE", "v": "BLOCK", "p": "IF", "q": "IF"}
    chain = ["m", *[f"b{i}" for i in range(66)], *[f"i{i}" for i in range(4)]]
    links = [*zip(chain, chain[1:]), ("f", "v"), ("v", "w"), ("w", "v"), ("g", "p"), ("g", "q"), ("p", "q")]
    nodes = spark.createDataFrame(list(kinds.items()), "id string, node_type string")
    edges = spark.createDataFrame([(a, b, "CONTAINS") for a, b in links], "src string, dst string, edge_type string")
    got = {r.id: round(r.confidence, 6) for r in smells.arrow_code(nodes, edges).collect()}
    assert got == {"m": round(4 / 6, 6), "f": 1.0}


def test_slowest_nodes_gives_every_node(spark, monkeypatch):
    rows = spark.createDataFrame([(f"n{i:02}", float(i), True) for i in range(13)], "node_id string, duration_ms double, success boolean")
    monkeypatch.setattr(queries, "log", lambda spark, sf_dir: rows)
    assert [r.node_id for r in queries.QUERIES["slowest_nodes"](spark, "").collect()] == [f"n{i:02}" for i in reversed(range(13))]


@pytest.mark.parametrize("on_cycle", ["least", "stop"])
def test_levels_in_one_task_equal_levels_turn_by_turn(spark, on_cycle):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(25)]
    links = [(a, b) for _ in range(45) for a, b in [rng.sample(names, 2)] if a < b or rng.random() < 0.08] + [("n00", "n00")]
    nodes, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(links, "src string, dst string")
    one = {r.id: r.level for r in graph.levels(nodes, edges, on_cycle).collect()}
    assert one == {r.id: r.level for r in graph.levels(nodes, edges, on_cycle, last_rows=0).collect()} == {r.id: r.level for r in graph.levels(nodes, edges, on_cycle, last_rows=20).collect()}
    assert len(one) == 25 and (on_cycle == "stop" or None not in one.values())


def test_reach_in_one_plan_equals_the_loop(spark, monkeypatch):
    rng = random.Random(9)
    links = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(None, 3)], "src long, dst long")
    starts = spark.createDataFrame([(0,), (7,), (99,), (7,)], "id long")
    for hops in (0, 1, 3, 6):
        for backwards in (False, True):
            monkeypatch.setattr(graph, "ONE_PLAN", 10)
            one = sorted(map(tuple, graph.reach(starts, links, hops, backwards).collect()))
            monkeypatch.setattr(graph, "ONE_PLAN", -1)
            assert one == sorted(map(tuple, graph.reach(starts, links, hops, backwards).collect()))
            assert (99, 99, 0) in one


def test_baskets_are_not_dealt_by_items(spark):
    baskets = spark.createDataFrame([(i, ["x", "y"]) for i in range(30)], "seq long, items array<string>")
    patterns = spark.createDataFrame([("p", ["x", "y", "z"], 0.9)], "name string, items array<string>, confidence double")
    found = [mining.predict_missing(baskets, patterns), mining.reinforce(baskets, patterns), mining.suggested_fixes(baskets, patterns.withColumn("kind", F.lit("SYNDROME")))]
    for frame in found:
        assert "hashpartitioning(hook" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [(r.item, round(r.score, 6)) for r in found[0].collect()] == [("z", 0.6)] * 30
