"""URL filter against plain Python, with filters so small that false positives abound."""

import re

import pytest

from vulnspark.llm import url_filter as uf
from vulnspark.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def key(url):
    host, path = split(url)
    query = re.match(r"[^?#]*\??([^#]*)", url.split("://", 1)[1] if "://" in url else "")[1]
    left = sorted(p for p in query.split("&") if p and p.split("=")[0] != "ref" and not p.split("=")[0].startswith("utm_"))
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(left) if left else "")


def plain(url, listed):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, None))
    on = url is not None and key(url) in {key(x) for x in listed if x is not None}
    return host, path, rule[1], rule[2] or ("block" if on else "allow"), on


URLS = [None, "", "no scheme", "http://", "http://A.B.Example.COM/en/x", "https://www.example.com/en/", "https://www.example.com/enx", "http://example.com",
        "http://example.com?x=/en/", "http://notexample.com/en/", "http://net/es/", "http://x.net/es", "http://x.net/es/1?b=2&a=1#f", "http://x.org/p/?utm_a=1&ref=2",
        "http://www.x.org/p", "ftp://x.org/p//", "http://x.org/p?q=1", "http://x.org/P", "x://y://z/a", "http://ÄB.org/ü", "http://user@h.org:80/a?b#c?d", "http://com/", "http://.com/"]


@pytest.mark.parametrize("bits,limit", [(16, 1 << 23), (1, 1 << 23), (16, 0)])
def test_verdicts(spark, bits, limit):
    urls = URLS + [f"http://h{i}.org/{i % 7}" for i in range(300)]
    listed = ["http://x.org/p", "https://h.org/a", None, "no scheme", "http://x.net/de/"] + [f"https://www.h{i}.org/{i % 7}/?ref=1" for i in range(0, 300, 9)]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)] + [(None, URLS[4], 1, "x"), (3, URLS[3], 1, "x")], "page_id long, url string, host int, block string")
    got = uf.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), URL_RULES, bits, limit).collect()
    want = [(i, *plain(u, listed)) for i, u in enumerate(urls)] + [(None, *plain(URLS[4], listed)), (3, *plain(URLS[3], listed))]
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.passed_filter for r in got if r.listed)
    false = sum(r.passed_filter and not r.listed for r in got)
    assert false <= 3 if bits == 16 else false > 3


def test_no_rows(spark):
    pages, listed = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string")
    assert uf.judge(pages, listed, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in uf.judge(one, listed, URL_RULES).collect()] == ["allow"]


def test_no_rules_leave_the_list_to_decide(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://b.example/y"), (3, None)], "page_id long, url string")
    listed = spark.createDataFrame([("http://a.example/x",)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge(pages, listed, []).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow")}
