import random
import re

from ashlar.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    random.seed(4)
    bits = ["a", "b", "c", "éa", "😀", "#*", " ", " ", "\n", "\t", "\x0b", " ", "\x1c", "$", "\r\n"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 80))) for _ in range(300)] + ["", None, "a a a", "a a a a", "x y z x y z", "a\na\na"]
    rows = [(i, t, "h", 0) for i, t in enumerate(texts)]
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")).collect()
    for r in got:
        q = r.quality_1
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute(r.text), r.text
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)


def hosts_table(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(f"good{h}", good) for h in range(6) for _ in range(30)] + [(f"good{h}", bad) for h in range(6) for _ in range(2)]
    rows += [("bad", bad)] * 58 + [("bad", good)] * 2 + [("single", good)] + [(None, good)] * 5
    return spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")


def test_bad_hosts_go_and_good_or_small_ones_stay(spark):
    got = quality.assess(hosts_table(spark)).collect()
    kept = {r.doc_id for r in got if r.quality.kept}
    for r in got:
        assert (r.doc_id in kept) == (not r.quality.base_failed and r.source != "bad")
    rates = {r.source: r.quality.host_rate for r in got}
    assert 58 / 60 > rates["bad"] > 0.5 > rates["single"] > 0


def test_salted_join_gives_the_same_rows(spark):
    one, other = (quality.assess(hosts_table(spark), broadcast_hosts=n).orderBy("doc_id").collect() for n in (10, 0))
    assert one == other


def test_empty_table_and_one_host(spark):
    assert quality.assess(spark.createDataFrame([], "text string, source string")).collect() == []
    only = quality.assess(spark.createDataFrame([("w " * 3, "h")], "text string, source string")).first()
    assert only.quality.base_failed and not only.quality.kept


def test_long_text(spark):
    text = " ".join(f"w{i % 40000}" for i in range(120_000))
    got = quality.assess(spark.createDataFrame([(text, "h")], "text string, source string")).first().quality
    assert got.n_words == got.n_repeat_words == 120_000


def test_names_that_clash(spark):
    names = ["own", "rate", "salt", "salted_as", "host", "__host", "__rate", "quality", "n"]
    df = spark.createDataFrame([(1, "w " * 60, "h", *"abcdefghi"), (2, "w", None, *"abcdefghi")], ["doc_id", "text", "source", *names])
    for bound in (10, 0):
        got = quality.assess(df, broadcast_hosts=bound)
        assert got.columns == ["doc_id", "text", "source", *names, "quality_1"]
        assert {tuple(r)[3:12] for r in got.collect()} == {tuple("abcdefghi")} and got.count() == 2
