import random
import re

from quern.llm import urls

ALPHA = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules=urls.RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(ALPHA), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, False, None, "allow")
    return host, path, best[3], best[4]


def got(spark, rows, rules=urls.RULES):
    frame = spark.createDataFrame(rows, "page_id long, url string, rule int")
    listed = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, listed).collect())


def test_odd_urls(spark):
    texts = [
        None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "http://org/x", "http://xorg/y", "https://EXAMPLE.org/en/1?x=/es/", "http://example.org/en/12", "http://www.example.org/es/",
        "http://example.org/es", "http://example.org?/es/", "http://b.com/de/#x", "http://b.com/fr/a", "http://b.com/den", "a://b://c.org/d", "http://x.example.org./es/", "http://ÄB.com/fr/é", "x\nhttp://k.org/p\nq",
        "http://a.org/" + "y" * 5000, "http://" + "s." * 400 + "com/de/z", "http://b.com/fr/a",
    ]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    assert got(spark, rows) == sorted((k, *brute(t)) for k, t, _ in rows)


def test_random_rules(spark):
    rng = random.Random(4)
    rules = [(rng.choice(["allow", "block"]), h, p) for h in ("a.b", "b", "c.a.b", "d") for p in ("/", "/x", "/x/y", "/xy")]
    rows = [(k, f"http://{'.'.join(rng.choices('abcd', k=rng.randint(1, 4)))}/{''.join(rng.choices('xy/', k=rng.randint(0, 5)))}", 1) for k in range(300)]
    assert got(spark, rows, rules) == sorted((k, *brute(t, rules)) for k, t, _ in rows)


def test_pages_and_empty_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert sorted(map(tuple, urls.op4_urls(spark, sf_dir).collect()), key=str) == sorted(((p.page_id, *brute(p.url)) for p in pages), key=str)
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), empty).collect()} == {"allow"}
    assert got(spark, [])== []


def test_clashing_names_null_ids_and_long_urls(spark):
    rows = [(None, "http://example.org/es/x", 1), (None, "http://example.org/es/x", 1), (3, "http://b.com/" + "y" * 100_000, 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, n long").selectExpr("*", "1 as _x", "2 as _digest", "3 as r_host", "4 as verdict")
    rules = spark.createDataFrame([("block", "example.org", "/es/"), ("allow", "com", "/" + "y" * 50_000)], "verdict string, host string, path string")
    found = urls.judge(frame, rules).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in found) == [(0, "block"), (0, "block"), (3, "allow")] and {r["_x"] for r in found} == {1}
