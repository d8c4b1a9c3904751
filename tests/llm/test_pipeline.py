import hashlib
import math
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from ashlar.llm import mixing

from .test_bpe import library
from .test_linededup import brute as brute_lines
from .test_neardup import brute as brute_near


def brute_mix(rows):
    """Copies of each (doc_id, source, text): Poisson counts of rates that bring sources to the square root of their shares."""
    n = Counter(source for _, source, _ in rows)
    total = sum(round(k**mixing.ALPHA, 9) for k in n.values())
    out = {}
    for doc_id, source, text in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{doc_id}:{text}".encode()).hexdigest()[:13], 16) / 2**52
        rate = n[source] ** mixing.ALPHA / total * len(rows) / n[source]
        term = reached = math.exp(-rate)
        k = 0
        while u >= reached:
            k += 1
            term *= rate / k
            reached += term
        if k:
            out[doc_id] = k
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    lines = corpus_pipeline.line_dedup(spark, kept, sf_dir)
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()], 6)
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t for d, (t, n) in want.items() if not n or t}
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0 and lines.columns == columns
    near = corpus_pipeline.near_dedup(spark, lines, sf_dir)
    stays = {d for d, _, c in brute_near(sorted((r.doc_id, r.text) for r in lines.collect()), 5, 80) if d == c}
    assert {r.doc_id for r in near.collect()} == stays and near.columns == columns
    mixed = corpus_pipeline.mix(spark, near, sf_dir)
    assert mixed.columns == columns and mixed.exceptAll(near).join(near, columns, "left_anti").count() == 0
    assert Counter(r.doc_id for r in mixed.collect()) == brute_mix([(r.doc_id, r.source, r.text) for r in near.collect()])
    texts, encoding = {r.doc_id: r.text for r in mixed.collect()}, library()
    coded = corpus_pipeline.tokenize(spark, mixed, sf_dir).collect()
    assert len(coded) == mixed.count()
    for r in coded:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decodes_exactly and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_reproducible_and_decodes(spark, sf_dir):
    one, other = (sorted((r.doc_id, r.n_tokens, r.decoded_sha256, r.decodes_exactly) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert one == other and one and all(r[3] for r in one)
    assert all(len(r[2]) == len(hashlib.sha256(b"").hexdigest()) for r in one)


def test_stages_take_rows_that_repeat_and_nulls(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", "en", None, 1), (None, "lone " + text.replace("w", "v"), None, None, None), (4, None, "en", "a", 0), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "").collect() == []


def test_a_run_leaves_its_last_table_alone(spark, sf_dir):
    import glob

    from ashlar.llm._common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(folder + "/*"))
    rows = corpus_pipeline.run(spark, sf_dir)
    left = set(glob.glob(folder + "/*")) - before
    assert len(left) == 1 and "/mixing-" in left.pop() and rows.count() > 0


def test_names_that_clash(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    names = ["own", "own_hash", "hashed", "n", "quality", "n_removed_lines", "key", "copy", "__id", "__th", "__n"]
    docs = spark.createDataFrame([(i, text.replace("x", f"y{i // 2}x"), "en", "a", 1, *"abcdefghijk") for i in range(4)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == names and {tuple(r)[5:] for r in docs.collect()} <= {tuple("abcdefghijk")}
