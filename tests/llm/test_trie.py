import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ashlar.llm import trie

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in own.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


def expected(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    found = {}
    for n in sorted(members, key=len, reverse=True):
        below = [found[x] for x in children[n]]
        saved = (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(b[6] for b in below)
        ends = ",".join(str(c) for c in sorted(members[n]) if len(seqs[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        found[n] = (min(members[n]), len(n), parent, len(members[n]), len(children[n]), sum(b[5] for b in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(found.values(), key=str)


def run(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    convs = df.select("conv_id").distinct()
    long = {k: v for k, v in parameters.items() if k == "long"}
    got = trie.prefix_trie(trie.rebuilt(trie.turns(df, **long), convs), convs, **parameters)
    return sorted((tuple(r) for r in got.select(*FIELDS).collect()), key=str)


def some_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(95, 130), 200, 205, 301, -5, -100, -107]:
        n = rng.choice([1, 2, 3, 4, 7, 12])
        rows += [(c, rng.choice([i, i, i, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é日", "", None, "more\n"])) for i in range(n)]
    return rows + [rows[3], rows[3], (None, 1, "user", "nobody's")]


@pytest.mark.parametrize("parameters", [{}, {"hot": 2}, {"long": 3}, {"long": 1, "hot": 0}])
def test_against_nested_prefixes(spark, monkeypatch, parameters):
    monkeypatch.setattr(trie, "HOT_KEYS", 10**9)  # so that ``hot`` alone decides
    rows = some_rows()
    assert run(spark, rows, **parameters) == expected(rebuilt(sequences(rows)))


def test_one_long_conversation_and_many_copies(spark):
    rows = [(100, i, "user", f"turn {i}") for i in range(300)] + [(c, i, "user", f"turn {i}") for c in range(1000, 1400) for i in range(4)]
    assert run(spark, rows) == expected(rebuilt(sequences(rows)))


def test_pointer_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(trie.C, "written", lambda df, name, keep=False, f=trie.C.written: (rounds.append(name), f(df, name, keep))[1])
    rows = [(100, i, "user", str(i)) for i in range(200)]
    assert len(run(spark, rows)) == 201
    assert rounds.count("given") == 8  # 2**8 > 200


def test_empty_table(spark):
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_very_long_texts(spark):
    rows = [(c, i, "user", "日" * 70_000 + str(i)) for c in (100, 101) for i in range(2)]
    assert run(spark, rows) == expected(rebuilt(sequences(rows)))


def test_ids_of_many_members_are_hashed_piece_by_piece(spark):
    ids = [*range(3000), *range(-700, 0), 10**12]
    ends = spark.createDataFrame([(c,) for c in ids], "conv_id long").select(F.lit(b"n").alias("node"), "conv_id").repartition(5)
    got = trie.end_digests(ends).collect()
    assert [(bytes(r.node), r.ends_sha256) for r in got] == [(b"n", hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())]


def test_nodes_of_an_empty_conversation(spark):
    convs = spark.createDataFrame([(1,), (2,), (2,)], "conv_id long")
    items = trie.turns(spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in trie.prefix_trie(items, convs).select("depth", "n_convs", "ends_sha256").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(0, 2, sha("2")), (1, 1, sha("1"))]
