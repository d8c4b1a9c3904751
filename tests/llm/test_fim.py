import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ashlar.llm import fim


def test_elias_fano_selects_every_boundary():
    rng = random.Random(3)
    texts = ["", "a", "é", "日本語", "😀" * 700, "x" * 5000, "".join(rng.choice("aé日😀 \n") for _ in range(4000))]
    for text in texts:
        data = text.encode()
        packed = fim.elias_fano(data)
        want = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert [fim.select(packed, i) for i in range(len(want))] == want
    assert len(fim.elias_fano(b"x" * 80_000)) < 80_000 * 2.2 / 8 + 100  # two bits a boundary
    assert len(fim.elias_fano("日".encode() * 80_000)) < 80_000 * 4.2 / 8 + 100


def expected(doc_id, text, plain=10, spm=20, seed=1, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    p, s, m = marks
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, s + suf + p + pre + m + mid) if h[3] % 100 < spm else (n, "psm", a, b - a, p + pre + s + suf + m + mid)


def rows():
    rng = random.Random(5)
    kinds = [lambda: "".join(rng.choice("ab é日😀<PSM>\n") for _ in range(rng.randint(0, 60))), lambda: "copy of a text", lambda: "holds <S> itself", lambda: "", lambda: None]
    made = [(i, rng.choice(kinds)()) for i in range(400)]
    return made + made[:5] + [(None, "no id"), (None, None), (1000, "日x" * 60_000)]


@pytest.mark.parametrize("hot", [1_000, 20])
def test_against_cutting_each_text(spark, hot):
    data = rows()
    made = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(4), hot=hot)
    made = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made)) == sorted(key((i, t, *expected(i, t))) for i, t in data)
    assert all(r.back == (r.text or "") for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_shares_of_forms_and_other_parameters(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    marks = ("[pre]", "[suffix]", "[m]")
    made = fim.fill_in_middle(df, sentinels=marks, plain_percent=50, spm_percent=50, seed=9).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, 50, 50, 9, marks) and r.back == r.text for r in made)
    share = sum(r.form == "plain" for r in made) / 4000
    assert abs(share - 0.5) < 0.04


def test_index_has_a_row_for_each_distinct_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",), ("a",)], "text string").repartition(3)
    got = {r.text: (r.n_documents, r.n_units) for r in fim.distinct_texts(df).collect()}
    assert got == {"a": (3, 1), "b": (1, 1), "": (2, 0)}


def test_empty_and_names_that_clash(spark):
    names = ["n", "form", "output", "own_text", "entry", "salt", "copies", "absent", "cut", "index", "text_key", "boundaries"]
    df = spark.createDataFrame([(i, "some text", *names) for i in range(30)], ["doc_id", "text", *names])
    got = fim.fill_in_middle(df, hot=10)
    assert got.columns == ["doc_id", "text", *names, "n_1", "form_1", "prefix_chars", "middle_chars", "output_1"]
    assert {tuple(r)[2:14] for r in got.collect()} == {tuple(names)}
    assert fim.fill_in_middle(df.limit(0)).collect() == []
