"""Verdicts equal a plain reading of the rules."""

import random

import pytest

from lexivec.llm import url_filter as u

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("b.c.net", "/e", "allow"), ("Odd.org", "", "block"), ("odd.org", "/x?", "allow"), ("two.org", "/", "allow"), ("two.org", "/", "block"),
         (None, "/", "block"), ("", "/", "block"), ("null.org", None, "block"), ("null.org", "/", None)]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, action in RULES:
        if not h or p is None or action is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), action)
            best = max(best, (key, h + p, action)) if best else (key, h + p, action)
    return host, path, best and best[1], best[2] if best else "allow"


def urls():
    rng = random.Random(3)
    out = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "x://a.b.c.net/en/1#x", "http://com:80/", "http://É.com/A?b",
           "http://example.com.evil.org/en/", "http://notexample.com/en/", "http://a." * 50 + "example.com/en/" + "y" * 9000, "a://b://c.com/",
           "http://example.com/en", "http://x.odd.org", "http://odd.org/x?q", "http://two.org/", "http://null.org/", "http://example.com/en/\nz"]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "www", "example", "com", "net", "b", "c", "odd", "org", ""]) for _ in range(rng.randrange(1, 5)))
        out.append(f"{rng.choice(['http', 'https'])}://{host}{rng.choice(['', '/', '/en/', '/en/x', '/es/', '/e', '?q', '#f', '/x?'])}")
    return out


@pytest.mark.parametrize("limit", [u.BROADCAST_RULES, 0])
def test_verdicts(spark, limit):
    given = urls()
    pages = spark.createDataFrame([(k % 90, x, 1, "old") for k, x in enumerate(given)], "page_id long, url string, copies int, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = u.judge_urls(pages.repartition(3), rules, broadcast_rules=limit)
    assert got.columns == ["page_id", "url", "copies", "host", "path", "rule", "verdict"]
    rows = sorted(map(str, ((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect())))
    assert rows == sorted(str((k % 90, x, *judge(x))) for k, x in enumerate(given))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_no_rules_no_rows_and_copies(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.com/")] * 3 + [(None, None)], "page_id long, url string")
    got = u.judge_urls(pages, none, default="block").collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"block"} and {r.rule for r in got} == {None}
    assert u.judge_urls(pages.limit(0), none).count() == 0
