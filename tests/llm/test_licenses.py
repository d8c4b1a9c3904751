import random
import re

from ashlar.llm import licenses


def common(a, b):
    """Length of the longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_alignment_is_increasing_and_recursive():
    text = "x x released under the big mit license x".split()
    pairs = licenses.align(text, "released under the mit license".split())
    assert [text[i] for i, _ in pairs] == "released under the mit license".split()
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert licenses.align([], []) == [] and licenses.align(["a"], []) == []


def test_scan_against_every_window(spark):
    random.seed(3)
    filler = "the of under license work version 2 cc by permission and this".split() + [f"w{i}" for i in range(40)]
    named = sorted(licenses.TEMPLATES.items())
    rows = [(0, None, 1), (1, "", 1), (2, "Released under the MIT License. " * 3, 1), (3, "released UNDER the mit-license!", 1)]
    for n in range(60):
        words = [random.choice(filler) for _ in range(random.randint(0, 300))]
        if n % 2:
            at = random.randint(0, len(words))
            words[at:at] = random.choice(named)[1].split()
        rows.append((10 + n, " ".join(words), 1))
    rows.append((99, " ".join([*filler * 3000, named[0][1]]), 1))
    got = {r.doc_id: {x.license: (x.coverage, x.first_word, x.last_word) for x in r.licenses_1} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses int").repartition(4)).collect()}
    for doc_id, text, _ in rows:
        words = split(text)
        if len(words) > 5000:
            continue
        most = {name: common(words, split(body)) for name, body in named}
        size = {name: len(split(body)) for name, body in named}
        assert {k: v[0] for k, v in got[doc_id].items()} == {k: n / size[k] for k, n in most.items() if 10 * n >= 9 * size[k]}, doc_id
        for k, (coverage, first, last) in got[doc_id].items():  # the span holds as many words, and no smaller one at either end does
            body = split(dict(named)[k])
            assert common(words[first : last + 1], body) == most[k] == round(coverage * size[k])
            assert common(words[first + 1 : last + 1], body) < most[k] > common(words[first:last], body)
    assert "MIT" in got[2] and "MIT" in got[3] and "Apache-2.0" in got[99] and got[0] == got[1] == {}


def test_planted_lines_are_found_and_nothing_else(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in licenses.scan(docs).collect():
        said = [k for k, body in licenses.TEMPLATES.items() if len(body.split()) < 15 and body in r.text]
        assert set(said) <= {x.license for x in r.licenses}
        assert r.licenses == [] or "icense" in r.text


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "text string")).columns == ["text", "licenses"]
    assert licenses.scan(spark.createDataFrame([], "text string")).collect() == []


def longest_increasing(pairs):
    best = [[]]
    for n in range(len(pairs)):
        before = [x for x in best if not x or (x[-1][0] < pairs[n][0] and x[-1][1] < pairs[n][1])]
        best.append(max(before, key=len) + [pairs[n]])
    return len(max(best, key=len))


def rule(text, template):
    """How many words the recursive alignment matches, checked step by step: of the anchors that align() chose at each level."""
    pairs = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(x < y and v < w for (x, v), (y, w) in zip(pairs, pairs[1:]))
    return pairs


def patience(text, template):
    """The recursion, written plainly; ties of equally long subsequences are settled as patience sorting settles them."""
    if not text or not template:
        return 0
    if text[0] == template[0]:
        return 1 + patience(text[1:], template[1:])
    if text[-1] == template[-1]:
        return 1 + patience(text[:-1], template[:-1])
    shared = [w for w in dict.fromkeys(template) if w in text]
    if not shared:
        return 0
    n = {w: (text.count(w), template.count(w)) for w in shared}
    kinds = ([w for w in shared if n[w] == (1, 1)], [w for w in shared if n[w][0] == n[w][1]], [w for w in shared if max(n[w]) == min(max(x) for x in n.values())])
    chosen = next(k for k in kinds if k)
    at = lambda seq, w: [i for i, x in enumerate(seq) if x == w]
    pairs = sorted(((i, j) for w in chosen for i, j in zip(at(text, w), at(template, w))), key=lambda p: p[1])
    anchors = licenses._increasing(pairs)
    assert len(anchors) == longest_increasing(pairs) and all(p < q and v < w for (p, v), (q, w) in zip(anchors, anchors[1:]))
    edges = [(-1, -1), *anchors, (len(text), len(template))]
    return len(anchors) + sum(patience(text[i + 1 : k], template[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:]))


def test_recursive_alignment_against_its_rule():
    random.seed(11)
    for n in range(1000):
        letters = "abcdefghijklmnopqrstuvwxyz"[: random.choice([2, 4, 8, 26])]
        text, template = ([random.choice(letters) for _ in range(random.randint(0, most))] for most in (40, 12))
        pairs = rule(text, template)
        assert len(pairs) == patience(text, template) <= common(text, template), (text, template)
        assert bool(pairs) == bool(set(text) & set(template))


def test_best_match_is_an_alignment_of_its_region():
    random.seed(14)
    fewer = 0
    for _ in range(1000):
        template = [random.choice("abcdefghijkl") for _ in range(random.randint(1, 9))]
        text = [random.choice("abcdefghijklmnop") for _ in range(random.randint(0, 40))]
        wanted = random.randint(1, len(template))
        most, got = common(text, template), licenses.best_match(text, template, wanted)
        fewer += got is None and most >= wanted
        if got:
            n, first, last = got
            assert wanted <= n <= common(text[first : last + 1], template) <= most and text[first] in template and text[last] in template
            assert n >= len(licenses.align([w for w in text if w in template], template))
    assert fewer < 50  # a longest common subsequence reaches ``wanted`` there and no alignment does


def test_results_come_from_the_alignment(monkeypatch):
    template = "released under the terms of the mit license".split()
    assert licenses.best_match(["x", *template], template, 8) == (8, 1, 8)
    monkeypatch.setattr(licenses, "align", lambda text, template: [])
    assert licenses.best_match(["x", *template], template, 8) is None


def test_inserted_words_are_found_at_any_place(spark):
    notice = "Released in 2020 by Example under the terms of the MIT License"
    far = "Released " + "zz " * 500 + "under the MIT License"
    rows = [(i, "zz " * i + notice + " zz" * 40) for i in range(45)] + [(100, "zz " * 9 + far), (101, "Licensed under CC BY. " + "zz " * 3 + "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: {x.license: (x.coverage, x.first_word, x.last_word) for x in r.licenses} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == {"MIT": (1.0, i, i + 11)} for i in range(45))
    assert got[100] == {"MIT": (1.0, 9, 513)} and got[101] == {"CC-BY-NC-4.0": (1.0, 7, 13)}


def test_fuller_copy_beside_one_that_is_full_enough():
    template = [f"t{i}" for i in range(20)]
    text = [*template[:18], "x", "x", *template, "x"]
    assert licenses.best_match(text, template, 18) == (20, 20, 39)


def test_gaps_without_anchors_are_closed():
    twice = "of the one of the two".split()
    assert len(licenses.align(twice * 2, twice)) == 6
    assert len(licenses.align("a x b a y b".split(), "a b a b".split())) == 4


def test_anchors_far_from_the_notice_do_not_hide_it():
    template = [f"t{i}" for i in range(30)]
    notice = [w for i, w in enumerate(template) if i not in (3, 17, 25)]
    text = ["t25", "x", "t17", "x", "t3", *["x"] * 50, *notice, "x", "t3", "t17"]
    got = licenses.best_match(text, template, 27)
    assert got[0] == common(text, template) == common(text[got[1] : got[2] + 1], template) >= 27


def test_hundreds_of_templates(spark):
    random.seed(13)
    words = [f"w{i}" for i in range(4000)] + ["the", "of", "software", "permission"] * 200
    templates = {f"L{i}": " ".join(random.choice(words) for _ in range(random.randint(5, 200))) for i in range(500)}
    rows, planted = [], {}
    for n in range(120):
        text = [random.choice(words) for _ in range(random.randint(0, 400))]
        if n % 2:
            name = f"L{random.randrange(500)}"
            body = templates[name].split()
            for _ in range(len(body) // 12):
                body[random.randrange(len(body))] = "changed"
            at = random.randint(0, len(text))
            text[at:at] = body
            planted[n] = name
        rows.append((n, " ".join(text)))
    got = {r.doc_id: {x.license for x in r.licenses} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), templates=templates).collect()}
    assert all(name in got[n] for n, name in planted.items())
    size = {k: len(b.split()) for k, b in templates.items()}
    for n, text in rows[:20]:
        own = text.split()
        assert got[n] == {k for k, b in templates.items() if 10 * common(own, b.split()) >= 9 * size[k]}
    assert licenses.scan(spark.createDataFrame(rows[:3], "doc_id long, text string"), templates={"none": " ."}).where("size(licenses) > 0").collect() == []
