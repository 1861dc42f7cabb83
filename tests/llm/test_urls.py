import random
import re

from quarry.llm.urls import RULES, BloomCascade, url_filter

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "https://www.Example.com/en/x?y=1", "https://www.example.com/fr/x", "http://example.com",
    "http://a.b.net/es/1#t", "http://net/fr/", "http://a.net/de/", "http://xnet/es/", "https://b.org/en/", "x://y://example.com/en/", "http://user@example.com/en/", "http://example.com?x=/en/",
    "http://sub.www.example.com/en/", "http://example.com/en", "http://.net/es/", "http://a\nb.net/es/\n?", "http://É.net/es/",
]


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(a, h, p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_rules_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["com", "net", "org", "example", "www", "EN", "a"]
    urls = URLS + ["http://" + ".".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/1", "/fr/x?y", "#a", "/EN/"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_empty_table_rules_and_clashes(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (None, None, None)], "page_id long, url string, rule string")
    assert [r.verdict for r in url_filter(df, []).collect()] == ["allow"] * 3
    assert url_filter(df.limit(0)).count() == 0
    assert sorted(str(r.rule) for r in url_filter(df).collect()) == ["None", "com/", "com/"]


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(5)
    universe = [f"key{rng.random()}" for _ in range(5000)]
    for n in (0, 1, 40, 2500):
        listed = universe[:n]
        u = spark.createDataFrame([(k,) for k in universe + universe[:50]], "key string")
        cascade = BloomCascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), u)
        found = {r.key for r in u.where(cascade.contains(u["key"])).collect()}
        assert found == set(listed)
        if n > 1:
            assert len(cascade.levels) > 1 or n < 100


def test_lists_too_large_for_literals_give_the_same(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    small, large = (url_filter(df, max_bytes=b) for b in (4 << 20, 1))
    assert small.columns == ["page_id", "html", "host", "path", "rule", "verdict"] and sorted(large.columns) == sorted(small.columns)
    rows = [tuple(r) for r in small.collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in large.select(small.columns).collect()), key=str)
    assert {r[0]: r[2:] for r in rows} == {i: brute(u) for i, u in enumerate(URLS)}
    table = spark.createDataFrame(RULES, "action string, host string, path string")
    assert sorted((tuple(r) for r in url_filter(df, table).collect()), key=str) == sorted(rows, key=str)
