import itertools
import random

import xxhash

from gridlark.llm import url_filters as U


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
    host = "".join(c.lower() if c.isascii() else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fit = [(len(h) + len(p), h + p, v) for h, p, v in U.RULES if under(h) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if any(map(under, U.BLOCKED_HOSTS)) else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["", "com", "a.com", "example.com", "EXAMPLE.com", "www.example.com", "x.www.example.com", "notexample.com", "a.net", "net", "spam-farm.example.org", "m.Spam-farm.example.org", "xspam-farm.example.org", "é.net", "a..com", ".com", "a.com."]
    paths = ["", "/", "/en", "/en/", "/en/7.html", "/es/", "/ES/1", "/fr/a/b", "//en/", "/é/"]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "HTTPS://", "://", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#t", "?x://y/en/")]
    urls += [None, "", "mailto:a@b.com", "http://" + "a." * 5000 + "com/en/", "http://a.net/es/" + "x" * 100_000]
    rng.shuffle(urls)
    pages = spark.createDataFrame([(k % 300, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = sorted(map(repr, (tuple(r) for r in U.verdicts(pages).collect())))
    assert got == sorted(repr((k % 300, *brute(u))) for k, u in enumerate(urls))


def test_equal_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 7 if b.startswith((b"a", b"b")) else len(b))
    path = tmp_path / "f"
    path.write_bytes(U.built([("a.org", "/", "block"), ("b.org", "/", "allow"), ("c.org", "", "listed")]))
    index = U.Index(str(path))
    assert index.found([b"a.org\0/", b"b.org\0/", b"bb.org\0/", b"c.org\0", b"d.org\0"]) == [["block"], ["allow"], [], ["listed"], []]


def test_empty(spark):
    assert U.verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []
