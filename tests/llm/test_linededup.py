import random
import re

from ashlar.llm import linededup

SPACES = " \t\r\x0b\x0c"


def brute(rows, run):
    """rows: distinct (id, text); every window of units against every earlier one."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        units = [(i, x.strip(SPACES), j) for i, x in enumerate(lines) if x.strip(SPACES) for j in range(-(-len(re.split(r'[ \t\r\x0b\x0c]+', x.strip(SPACES))) // linededup.UNIT_WORDS))]
        gone = set()
        for s in range(len(units) - run + 1):
            content = tuple(u[1:] for u in units[s : s + run])
            if content in seen:
                gone |= {u[0] for u in units[s : s + run]}
            seen.setdefault(content, (doc_id, s))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc_id] = (text if not gone else left if left.strip(SPACES + "\n") else "", len(gone))
    return out


def test_against_every_window(spark):
    random.seed(7)
    pool = [f"line {i} " + "word " * random.randint(0, 30) for i in range(12)] + ["", "  ", "\t"]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 25)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[3][1]), (203, "a\n" * 50), (204, ("é" * 300 + "\n") * 2), (205, "é" * 300 + " \r\ntail")]
    shuffled = random.sample(rows, len(rows))
    df = spark.createDataFrame([(d, t, 1) for d, t in shuffled], "doc_id long, text string, n_removed_lines int").repartition(3)
    for run in (2, 6):
        got = {r.doc_id: (r.text, r.n_removed_lines_1) for r in linededup.dedup_lines(df, run_units=run).collect()}
        assert got == brute(rows, run)


def test_rows_that_repeat_end_alike(spark):
    text = "\n".join(f"a rather long line number {i} with some more words in it" for i in range(5))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == [(1, text), (1, text), (2, "")]
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_long_text(spark):
    text = "\n".join(f"line {i} of a very long text that does not end soon" for i in range(60_000))
    rows = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, "new\n" + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.text), r.n_removed_lines) for r in rows) == [(1, len(text), 0), (2, 3, 60_000)]


def test_a_passage_of_short_words_is_found_wherever_it_stands(spark):
    passage = " ".join(f"{'abcdefg'[i % 7]}{i}" for i in range(51))
    wide = " ".join("一二" + "三四五六七"[i % 5] for i in range(20))  # few words, many bytes
    rows = [(i, f"own line {i}\n{passage}\nand more {i}") for i in range(3)] + [(10 + i, f"other {i}\n{wide}\nend {i}") for i in range(2)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == "own line 1\nand more 1" and got[2] == "own line 2\nand more 2"
    assert got[10] == rows[3][1] and got[11] == rows[4][1]


def test_names_that_clash(spark):
    text = "\n".join(f"a rather long line number {i} with some more words in it" for i in range(6))
    names = ["key", "id", "id_of", "starts", "result", "own", "own_key", "__key", "__starts", "n_removed_lines"]
    rows = [(1, text, *"abcdefghij"), (2, text, *"abcdefghij")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, ["doc_id", "text", *names]))
    assert got.columns == ["doc_id", "text", *names, "n_removed_lines_1"]
    assert sorted(map(tuple, got.collect())) == [(1, text, *"abcdefghij", 0), (2, "", *"abcdefghij", 6)]
