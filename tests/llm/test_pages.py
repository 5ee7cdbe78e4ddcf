"""op2 and op4."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.llm import url_rules, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/x", "block"),
         ("shop.de", "", "block"), ("Shop.DE", "/ok/", "allow"), ("tie.fr", "/p/", "allow"), ("tie.fr", "/p/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.EXAMPLE.net/en/1?x#y", "https://example.net/en", "https://myexample.com/de/",
    "https://w.example.com/de/a/b", "http://x.org/fr/", "http://c.a.b.org/xylophone", "http://a.b.org/y", "http://shop.de", "http://shop.de?q", "http://shop.de/ok/1",
    "http://tie.fr/p/q", "file:///etc/net/", "http://a..net//en/", "http://net:80/", "http://user@net/", "://net/", "a://b://net/", "http://ÉX.net/\n/", "http://net/" + "a/" * 3000,
]


def slow_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(k if k % 5 else None, u, "clash") for k, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    found = url_rules.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert sorted(found.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    rows = found.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judge(r["url"]), r["url"]


def test_verdicts_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [r["verdict"] for r in url_rules.judge(pages, rules.limit(0)).collect()] == ["allow"]
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_only_built_in_functions(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    plan = url_rules.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("k", range(10))
def test_loser_tree(k):
    rng = random.Random(k)
    for _ in range(30):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    start = datetime(2024, 1, 1)
    bodies = [None, "", "short", "é" * 60, "x" * 120, "x" * 120, "WARC/1.1\r\n\r\n" * 20, "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 5, "z" * 200_000, "é" * 60]
    urls = ["http://b.org/1", "http://a.b.org/1?q", None, "no scheme", "http://B.org/1#f", "http://b.org/\r\nX: y"]
    rows = [(k, urls[k % 6], start + timedelta(seconds=k % 4), b) for k, b in enumerate(bodies * 6)] + [
        (None, "http://b.org/1", None, "x" * 120), (4, "http://b.org/1", start, "x" * 120), (99, urls[0], start, "n" * 100)
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, captured_at timestamp, payload string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "archives")
    warc.write_archives(captures.drop("digest").repartition(3), path)
    read = warc.read_captures(spark, path)
    found = sorted(warc.merge_runs(read).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(rows)))
    order = [(r["url_key"], r["captured_at"] or datetime.min, -1 if r["page_id"] is None else r["page_id"]) for r in found]
    assert order == sorted(order)
    body = lambda b: (b or "").encode()
    first = {}
    for i, _, _, b in rows:
        if i is not None:
            first[body(b)] = min(i, first.get(body(b), i))
    def want(i, b):
        raw = body(b)
        refers = first[raw] if len(raw) >= 100 and raw in first and first[raw] != i else None
        return (str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", str(refers))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in found)
    assert got == sorted(want(i, b) for i, _, _, b in rows)
    assert read.select("archive").distinct().count() >= 3


def test_no_captures(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, captured_at timestamp, payload string")
    warc.write_archives(none, str(tmp_path / "none"))
    assert warc.merge_runs(warc.read_captures(spark, str(tmp_path / "none"))).count() == 0
