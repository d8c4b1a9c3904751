import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ashlar.llm import urlfilter

DAY0 = datetime(2024, 1, 1)


def brute(captures, entries):
    out = []
    for url, at in captures:
        found = set()
        for pattern, category in {(p, c) for p, c, t, _ in entries if p is not None and t is not None}:
            events = sorted((t, a) for p, c, t, a in entries if (p, c) == (pattern, category) and t is not None and at is not None and t <= at)
            if not events or events[-1][1] != "add" or url is None or "://" not in url:
                continue
            host, _, path = url.split("://")[1].split("?")[0].split("#")[0].partition("/")
            host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
            dom, _, own = pattern.rstrip("/").partition("/")
            if not own and (host == dom or host.endswith("." + dom)):
                found.add((pattern.rstrip("/"), category))
            if own and host == dom and (path + "/").startswith(own + "/"):
                found.add((pattern.rstrip("/"), category))
        out.append((url, at, sorted(found, key=str)))
    return sorted(out, key=str)


def tables(spark):
    random.seed(11)
    when = lambda: DAY0 + timedelta(days=random.randrange(20))
    hosts = ["a.com", "b.a.com", "x.b.a.com", "ba.com", "c.org"]
    patterns = [*hosts, "com", "a.com/x", "a.com/x/y", "b.a.com/x/", "none.net"]
    entries = [(random.choice(patterns), random.choice(["k1", "k2"]), when(), random.choice(["add", "add", "remove"])) for _ in range(60)] + [(None, "k1", DAY0, "add"), ("a.com", "k1", None, "add")]
    captures = [(f"http{random.choice(['', 's'])}://{random.choice(['', 'u:p@'])}{random.choice(hosts).upper() if random.random() < 0.2 else random.choice(hosts)}{random.choice(['', ':80'])}{random.choice(['', '/', '/x', '/x/y/z', '/xy?q=/x', '/X#f'])}", when()) for _ in range(300)]
    captures += [(None, DAY0), ("not a url", DAY0), ("http://a.com/", None), *captures[:20]]
    return captures, entries


def test_against_every_entry(spark, monkeypatch):
    captures, entries = tables(spark)
    left = spark.createDataFrame([(*c, True) for c in captures], "url string, fetched timestamp_ntz, blocked boolean")
    right = spark.createDataFrame(entries, "pattern string, category string, at timestamp_ntz, action string")
    want = brute(captures, entries)
    for bound in (urlfilter.BROADCAST_INTERVALS, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_INTERVALS", bound)
        rows = urlfilter.filter_urls(left, right).collect()
        assert sorted(((r.url, r.fetched, sorted({(m.pattern, m.category) for m in r.matches}, key=str)) for r in rows), key=str) == want
        assert all(r.blocked_1 == bool(r.matches) for r in rows)


def test_empty_list_and_empty_table(spark):
    captures = spark.createDataFrame([("http://a.com/", DAY0)], "url string, fetched timestamp_ntz")
    entries = spark.createDataFrame([], "pattern string, category string, at timestamp_ntz, action string")
    assert [r.blocked for r in urlfilter.filter_urls(captures, entries).collect()] == [False]
    assert urlfilter.filter_urls(captures.limit(0), entries).collect() == []


def test_names_that_clash(spark):
    names = ["u", "t", "of_url", "at_time", "__u", "__t", "pattern", "known", "active", "blocked", "matches"]
    captures = spark.createDataFrame([("http://a.com/", DAY0, *"abcdefghijk")], ["url", "fetched", *names]).withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    entries = spark.createDataFrame([("a.com", "k", DAY0, "add")], "pattern string, category string, at timestamp_ntz, action string")
    got = urlfilter.filter_urls(captures, entries)
    assert got.columns == ["url", "fetched", *names, "blocked_1", "matches_1"]
    assert tuple(got.first())[2:14] == (*"abcdefghijk", True)
