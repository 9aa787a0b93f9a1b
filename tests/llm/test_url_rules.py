import random
import re

from obsframe.llm import url_rules

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("a.b.c.net", "/", "allow"), ("B.C.net", "/e", "block"), ("xample.com", "", "block"),
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in rules
        if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def run(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.filter_urls(pages, frame).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.com", "x.www.example.com", "notexample.com", "b.c.net", "q.a.b.c.net", "c.net", "net", "org", "", "a..net"]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/es/", "/es/1#t", "/fr/2", "/e", "?q", "#f"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)]
    urls += [None, "", "no scheme.com/en/", "://", "http://u://example.com/en/"]
    assert run(spark, urls) == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_hosts_over_many_ranges_carry_open_rules(spark):
    rules = [("d.com", "/", "block"), ("com", "/", "allow"), ("h5.d.com", "/", "allow")]
    urls = [f"http://h{n}.d.com/" for n in range(400)] + [f"http://e{n}.com/" for n in range(50)]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_ties_empty_tables_and_clashing_columns(spark):
    assert run(spark, ["http://a.com/"], [("a.com", "/", "allow"), ("a.com", "/", "block")])[0][3] == "block"
    assert run(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    assert run(spark, ["http://a.com/"], [(None, "/", "block"), ("com", None, "block")])[0][3] == "allow"
    assert run(spark, []) == {}
    pages = spark.createDataFrame([("k", "http://a.com/x" + "y" * 100000, "old", 2)], "key string, url string, verdict string, _key int")
    row = url_rules.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).first()
    assert (row["_key"], row["key"], row["verdict"], row["rule"]) == (2, "k", "allow", "com/")
