import random
import re

from tessera.llm import url_filter as uf

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def canon(url):
    return None if url is None or "://" not in url else "".join(parts(url)).rstrip("/") if parts(url)[1] else parts(url)[0]


def judged(url, listed):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return (host, path, *max(fit)[2:])
    return host, path, None, "block" if canon(url) is not None and canon(url) in listed else "allow"


def urls(n, seed):
    rnd = random.Random(seed)
    out = [None, "", "no scheme", "http://", "://x.net/fr/a", "HTTP://WWW.Example.COM/en/1", "http://a.example.com/EN/2", "http://notexample.com/en/", "http://net/fr/", "http://x.net?q=/fr/", "http://x.net#/fr/", "http://x.org/a://b/c", "http://ÉX.org/a/", "http://x.org/a//", "http://x.org/" + "p" * 20000]
    for _ in range(n):
        out.append(f"https://{rnd.choice(['h.org', 'www.h.org', 'k.net', 'example.com', 'hot.org'])}/{rnd.choice(['en', 'fr', 'es'])}/{rnd.randrange(40)}{rnd.choice(['', '/', '?a=1', '#top'])}")
    return out + ["https://hot.org/de/1"] * (n // 3)


def check(spark, force_keyed, monkeypatch):
    if force_keyed:
        monkeypatch.setattr(uf, "BROADCAST_BYTES", -1)
    all_urls, listing = urls(600, 1), [*urls(60, 2)[:40], "http://hot.org/de/1/", None]
    pages = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(all_urls)] + [(0, all_urls[0], "old", 7)], "page_id long, url string, verdict string, key int")
    out = uf.judge(pages, spark.createDataFrame([(u,) for u in listing], "u string"), RULES)
    assert out.columns == ["page_id", "url", "key", "host", "path", "canon", "rule", "possible", "listed", "verdict"]
    rows = out.collect()
    assert len(rows) == len(all_urls) + 1
    listed = {canon(u) for u in listing if canon(u) is not None}
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, listed), r.url
        assert r.listed == (canon(r.url) in listed) and (r.possible or not r.listed)
    free = [r for r in rows if r.canon is not None and not r.listed]
    assert sum(r.possible for r in free) <= 0.05 * len(free)


def test_broadcast(spark, monkeypatch):
    check(spark, False, monkeypatch)


def test_keyed(spark, monkeypatch):
    check(spark, True, monkeypatch)


def test_rows_of_a_hot_url_are_dealt_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(uf, "BROADCAST_BYTES", -1)
    pages = spark.createDataFrame([(i, "https://hot.org/de/1") for i in range(2000)], "page_id long, url string")
    out = uf.judge(pages, spark.createDataFrame([("https://hot.org/de/1",)], "u string"), RULES)
    assert out.where("listed and verdict = 'block'").count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan.split("Join")[1]


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://k.net/fr/1")], "page_id long, url string")
    none = spark.createDataFrame([], "u string")
    assert uf.judge(pages, none, RULES).first().verdict == "block" and uf.judge(pages, none, ()).first().verdict == "allow"
    assert uf.judge(pages.limit(0), none, RULES).count() == 0
