import random
import re
import time

from gleanery.llm.url_rules import url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/", "allow")]
PARSED = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def brute(url, rules, default="allow"):
    m = PARSED.match(url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), a, h + p) for h, p, a in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, urls, rules, **options):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in urls], "page_id bigint, url string, host string, key string").repartition(3)
    found = url_rules(df, spark.createDataFrame(rules, "host string, path string, action string"), **options)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["com", "net", "example", "www", "en", "a", "b", "com1", "co"]
    rules = RULES + [(".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(["/", "/en/", "/en/a", ""]), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [
        f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}{rng.choice(['', '/', '/en/', '/en/a?q=/x', '/es/#f', '?/en/', ':80/en/'])}"
        for _ in range(400)
    ]
    urls += [None, "", "no scheme", "://", "x://WWW.Example.COM/en/1", "a://b://c/en/", "http://.com/", "http://example.com./en/", "http://é.com/x" * 2000]
    rows = list(enumerate(urls)) + [(4, urls[4])] * 3 + [(None, urls[5])]
    assert judged(spark, rows, rules) == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)


def test_one_host_with_most_rows_and_repeated_rows(spark):
    rows = [(i % 50, "http://www.example.com/en/x") for i in range(3000)]
    assert set(judged(spark, rows, RULES)) == {(i, "www.example.com", "/en/x", "www.example.com/en/", "allow") for i in range(50)}


def test_empty_tables_and_default(spark):
    assert judged(spark, [(1, "http://a.com/")], [], default="block") == [(1, "a.com", "/", None, "block")]
    assert judged(spark, [], RULES) == []


def test_thousands_of_rules_on_one_host(spark):
    rng = random.Random(2)
    paths = sorted({"/" + "/".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(6_000)})
    rules = [("example.com", p, rng.choice(["allow", "block"])) for p in paths] + [("com", "/a/b/c", "block"), ("com", "/" + "a/" * 2_000, "block")]
    rows = [(i, f"http://www.example.com/{'/'.join(rng.choices('abcd', k=rng.randint(0, 12)))}{rng.choice(['', '?x', '#y'])}") for i in range(6_000)]
    rows += [(6_000, "http://example.com/" + "a/" * 3_000)]
    started = time.perf_counter()
    found = judged(spark, rows, rules)
    assert time.perf_counter() - started < 30
    some = rng.sample(rows, 200) + rows[-1:]
    ids = {i for i, _ in some}
    assert sorted(r for r in found if r[0] in ids) == sorted((i, *brute(u, rules)) for i, u in some)
