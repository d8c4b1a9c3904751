import random

import numpy as np
import pyarrow as pa
import pytest

from ashlar.llm import neardup
from ashlar.llm.graphs import components


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        size = min(len(w), words)
        sets.append({(size, *w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(s), min(x for x in groups[find(i)] if x is not None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def varied(seed, base_words, copies, edits):
    random.seed(seed)
    base = [f"w{random.randrange(5000)}" for _ in range(base_words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(random.randint(0, edits)):
            own[random.randrange(len(own))] = f"e{random.randrange(9999)}"
        yield " ".join(own)


def test_against_all_pairs(spark):
    texts = [*varied(1, 120, 60, 4), *varied(2, 200, 30, 12), *varied(3, 8, 30, 2), *varied(4, 400, 10, 60), "", None, " \n", "a", "A", "a b", "a  b", "b a"]
    random.seed(5)
    random.shuffle(texts)
    rows = list(enumerate(texts))
    for words, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=words, percent=percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("small, block", [(neardup.SMALL, neardup.BLOCK), (2, 3)])
def test_chains_within_one_bucket(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    # each text is close to the next only, so a bucket's first member reaches few and further pivots must link the rest
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(i * 7) % 60] = f"x{i}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_repeated_ids_null_ids_and_clashing_names(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (2, "a b c d", 1), (None, "a b c d", 1), (None, "only here", 1), (3, "", 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("1", "1", True)] * 2 + [("2", "1", False), ("None", "1", False), ("None", "None", True), ("3", "3", True)])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_fill_and_agree_with_similarity():
    random.seed(6)
    sets = [np.unique(np.array([random.getrandbits(64) for _ in range(n)], dtype=np.uint64)) for n in (1, 2, 5, 300, 4000)]
    for own in (s := neardup.sketches(sets, 64)):
        assert (own != neardup._FULL).all()
    assert (s[0] == neardup.sketches(sets[:1], 64)[0]).all()
    a, shared = sets[3], sets[4][:700]
    x, y = neardup.sketches([np.concatenate([shared, a[:100]]), np.concatenate([shared, a[100:200]])], 2048)
    assert abs((x == y).mean() - 700 / 900) < 0.05
    assert [len(v) for v in neardup.shingle_sets(pa.array(["a b c d", "a b", None]), 3)] == [2, 1, 0]


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                low = min(label.get(a, a), label.get(b, b))
                label[a] = label[b] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), last_edges=3).collect()}
    assert got.keys() == {r.node for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda d: sorted(sorted(n for n in d if d[n] == c) for c in set(d.values()))
    assert groups(got) == groups(label) and all(got[c] == c for c in got.values())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
