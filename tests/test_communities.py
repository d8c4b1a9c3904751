import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.functions import bitvec as V
from ashlar.functions import project
from ashlar.operators import communities, mining


def by_rule(edges):
    links = defaultdict(float)
    for a, b in {(min(e), max(e)) for e in edges if e[0] != e[1]}:
        links[a, b] = links[b, a] = 1.0
    total, members = sum(links.values()), {a: a for a, _ in links}
    for _ in range(communities.MOST_LEVELS):
        k = defaultdict(float)
        for (a, _), w in links.items():
            k[a] += w
        c, still, ever = {i: i for i in k}, 0, False
        for turn in range(communities.MOST_TURNS):
            tot = defaultdict(float)
            for i in c:
                tot[c[i]] += k[i]
            new = dict(c)
            for i in c:
                if zlib.crc32(str(i).encode()) % 2 != turn % 2:
                    continue
                near = defaultdict(float, {c[i]: 0.0})
                for (a, b), w in links.items():
                    if a == i and b != i:
                        near[c[b]] += w
                gain = {x: w - k[i] * (tot[x] - (k[i] if x == c[i] else 0.0)) / total for x, w in near.items()}
                best = min(gain, key=lambda x: (-round(gain[x], 9), x))
                if gain[best] > gain[c[i]] + communities.LEAST_GAIN:
                    new[i] = best
            moved, c = new != c, new
            ever, still = ever or moved, 0 if moved else still + 1
            if still == 2:
                break
        if not ever:
            break
        members = {i: c[x] for i, x in members.items()}
        merged = defaultdict(float)
        for (a, b), w in links.items():
            merged[c[a], c[b]] += w
        links = merged
    least = {x: min(i for i in members if members[i] == x) for x in set(members.values())}
    return {i: least[x] for i, x in members.items()}


def quality(edges, label):
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    m, degree = len(pairs), defaultdict(int)
    for a, b in pairs:
        degree[label[a]] += 1
        degree[label[b]] += 1
    return sum(label[a] == label[b] for a, b in pairs) / m - sum((d / 2 / m) ** 2 for d in degree.values())


def test_communities_equal_a_plain_run_of_the_rule(spark):
    rng = random.Random(1)
    edges = [(a, b) for a in range(24) for b in range(24) if rng.random() < (0.4 if a % 3 == b % 3 else 0.01)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = {r.id: r.community for r in communities.communities(df).collect()}
    clean = [e for e in edges if None not in e]
    assert got == by_rule(clean)
    parts = communities.modularity(df, spark.createDataFrame(list(got.items()), "id long, community long")).collect()
    assert abs(sum(r.share for r in parts) - quality(clean, got)) < 1e-9
    assert quality(clean, got) >= 0.9 * quality(clean, {i: i % 3 for i in got})


def test_no_edges_and_one_ball(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert communities.communities(empty).collect() == []
    nodes = spark.createDataFrame([(f"m{i}",) for i in range(12)], "id string")
    ball = spark.createDataFrame([(f"m{i}", f"m{j}", "CALLS") for i in range(12) for j in range(i)], "src string, dst string, edge_type string")
    (r,) = communities.big_ball_of_mud(nodes, ball).collect()
    assert (r.smell, r.id, r.confidence) == ("BIG_BALL_OF_MUD", None, 1.0)
    apart = spark.createDataFrame([(f"m{i}", f"m{j}", "CALLS") for i in range(12) for j in range(i) if i // 4 == j // 4], "src string, dst string, edge_type string")
    assert communities.big_ball_of_mud(nodes, apart).collect() == []


def test_data_clumps(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["z", "y", "x", "w"]), ("c", ["x", "y", "z", "w"]), ("d", ["w", "x", "y", "z"]), ("e", ["q"]), ("f", None)]
    got = {(tuple(r["items"]), r["n"]) for r in communities.data_clumps(spark.createDataFrame(rows, "id string, parameters array<string>")).collect()}
    assert got == {(("x", "y", "z"), 4), (("w", "x", "y", "z"), 3)}


@pytest.mark.parametrize("block", [4096, 3])
def test_patterns_found_by_vector(spark, monkeypatch, block):
    monkeypatch.setattr(mining, "QUERY_BLOCK", block)
    monkeypatch.setattr(mining, "CHUNK_ROWS", 5)
    texts = [f"t{i % 6}" for i in range(20)]
    seen = project.seeded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "seq long, t string"), "t").repartition(3)
    patterns = project.seeded(spark.createDataFrame([(f"t{i}", 0.5) for i in range(4, 12)], "name string, confidence double"), "name")
    near = V.xor(F.col("fp"), F.array(*[F.lit(-1).cast("long") if i < 40 else F.lit(0).cast("long") for i in range(V.WORDS)]))
    far = V.xor(F.col("fp"), F.array(*[F.lit(-1).cast("long") if i < 50 else F.lit(0).cast("long") for i in range(V.WORDS)]))
    more = seen.where("seq < 1").withColumn("seq", F.lit(200).cast("long")).withColumn("t", F.lit("t4"))
    seeded = project.seeded(more.select("seq", "t"), "t")
    seen = seen.select("seq", "fp").unionByName(seeded.select("seq", near.alias("fp"))).unionByName(seeded.select((F.col("seq") + 1).alias("seq"), far.alias("fp")))
    got = sorted((r.name, r.seq, round(r.similarity, 4)) for r in mining.alike_patterns(seen, patterns).collect())
    assert got == sorted([(t, i, 1.0) for i, t in enumerate(texts) if t in ("t4", "t5")] + [("t4", 200, 0.744)])
    learned = {r.name: (round(r.confidence, 6), r.observations) for r in mining.reinforce_alike(seen, patterns, 0.01).collect()}
    assert learned["t4"] == (round(0.5 + 0.01 * (3 + 0.744), 6), 4) and learned["t9"] == (0.5, 0)


def test_captured_state(spark):
    state = project.encode_state(F.col("tau"), F.lit(-0.2), F.lit("calm"))
    rows = spark.createDataFrame([(1, 0.3, [("a", 0.125), ("b", 1.005)], [f"s{i}" for i in range(25)]), (2, -0.3, None, None), (3, 0.0, [], [])], "id long, tau double, p array<struct<k:string,v:double>>, trace array<string>")
    got = rows.withColumn("base", state).withColumn("s", project.capture_state(F.col("base"), F.map_from_entries("p"), F.col("trace"))).collect()
    tile = lambda text: np.frombuffer((hashlib.sha256(text.encode()).digest() * 40)[: V.BYTES], dtype=np.uint8)
    for r in got:
        a, b = np.frombuffer(r.base, dtype=np.uint8), tile("|".join(f"{x.k}:{x.v:.2f}" for x in r.p or []))
        c = tile("→".join(r.trace[:20])) if r.trace else np.zeros(V.BYTES, dtype=np.uint8)
        bits = sum(np.unpackbits(x).astype(int) for x in (a, b, c))
        assert (np.unpackbits(np.frombuffer(r.s, dtype=np.uint8)) == (bits >= 2)).all()
