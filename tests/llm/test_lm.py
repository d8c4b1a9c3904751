import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ashlar.llm import lm

TEXTS = [(0, "the cat sat"), (1, "the cat ran"), (2, "a dog sat"), (3, "the dog zzz"), (4, ""), (5, None), (6, "the cat sat"), (6, "the cat sat"), (None, "A  Cat\n"), (7, "the cat ran a dog " * 310 + "unseen words the cat")]


def brute(rows, train, order, strength):
    """Walks the automaton state by state."""
    texts = [[w.decode() for w in (t or "").encode().lower().split()] + ["</>"] for _, t in rows]
    counts = Counter()
    begins = sum(train)
    for words, ok in zip(texts, train, strict=True):
        if ok:
            for i in range(len(words)):
                for k in range(1, order + 1):
                    history = words[max(0, i - k + 1) : i + 1]
                    counts[(k, *(["<"] if len(history) < k else []), *history)] += 1
    total = sum(c for g, c in counts.items() if g[0] == 1)
    types = sum(1 for g in counts if g[0] == 1)

    def p(words, i, k):
        if k == 1:
            return (counts[(1, words[i])] + 0.5) / (total + 0.5 * (types + 1))
        gram = words[max(0, i - k + 1) : i + 1]
        gram = (["<"] if len(gram) < k else []) + gram
        before = gram[:-1]
        seen = begins if before == ["<"] else counts[(len(before), *before)] if "<" not in before else counts[(k - 1, *before)]
        return (counts[(k, *gram)] + strength * p(words, i, k - 1)) / (seen + strength)

    return [sum(math.log10(p(w, i, min(order, i + 2))) for i in range(len(w))) for w in texts], total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_a_walk_by_hand(spark, order):
    rows = [(i, t, t) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = lm.score(df, F.col("doc_id") != 3, order=order).collect()
    ids = [i for i, _ in TEXTS]
    wanted, total = brute(TEXTS, [i != 3 for i in ids], order, lm.STRENGTH)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(i), round(s, 9)) for i, s in zip(ids, wanted, strict=True))
    assert {r.train_tokens for r in got} == {total} and [r.doc_id for r in got if r.held_out] == [3]


def test_probabilities_add_up_to_one(spark):
    # every continuation of "the": the words known, the end, and one unknown word for all others
    known = ["the", "cat", "sat", "ran", "a", "dog"]
    train = [(i, t) for i, t in TEXTS if i not in (3, 7, None)]
    probes = [(100 + i, "the " + w) for i, w in enumerate([*known, "unseen"])]
    df = spark.createDataFrame([*train, (99, "the"), *probes], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 90).collect()}
    mass = 10 ** got[99]  # "the" then the end: the end's share
    first = 10 ** got[99]
    assert 0 < first < 1 and mass < 1
    # p(the, w, end) = p(the) p(w|the) p(end|w); compare shares of known histories by the unigram model instead
    base = {r.doc_id: r.base_score for r in lm.score(df, F.col("doc_id") < 90).collect()}
    ends = base[99]
    the = base[100] - ends  # second "the"
    assert abs(sum(10 ** (base[100 + i] - ends) for i in range(len(known) + 1)) + 10 ** (ends - the) - 1) < 1e-9


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).collect() == []
