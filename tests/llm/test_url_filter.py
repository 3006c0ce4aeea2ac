import random

from deltion.llm import url_filter
from tests.llm.helpers import against_sql, write

URLS = ["http://example.com/en/a", "http://www.example.com/en/", "HTTP://WWW.Example.COM/en/x?y", "http://example.com", "http://x.net/es/q#z", "http://net/fr/", "http://badexample.com/en/", None, "", "no scheme", "://", "http://com/", "a://b://c.com/en/", "http://example.com:80/en/", "http://.com/", "http://x.org/"]


def test_edge_rows(spark, tmp_path):
    pages = [(i % 14, u, "h") for i, u in enumerate(URLS)] + [(None, "http://www.example.com/en/", None)] * 2
    assert against_sql(spark, write(spark, tmp_path / "t", pages=pages), "op2_url_rules") == []
    assert against_sql(spark, write(spark, tmp_path / "e"), "op2_url_rules") == []
    assert against_sql(spark, "/root/testdata/sf0.01", "op2_url_rules") == []


def test_many_rules_over_many_ranges(spark):
    rng = random.Random(5)
    labels, paths = ["a", "b", "c", "com"], ["", "/", "/x", "/x/y", "/x/y/z", "/q"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(paths)) for _ in range(120)] + [(None, "a", "/"), ("block", None, "/"), ("block", "c", None)]
    urls = [(i, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?a', '/z'])}") for i in range(1500)] + [(i, "http://a.b.com/x/y") for i in range(800)]
    got = url_filter.apply_rules(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=13, sample_rows=500).collect()
    clean = {(h, p or "", v) for v, h, p in rules if h and v}

    def judge(row):
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in clean if (row.host == h or row.host.endswith("." + h)) and row.path.startswith(p)]
        return max(fits)[3:] if fits else (None, "allow")

    assert len(got) == len(urls) and sorted(r.page_id for r in got) == sorted(u[0] for u in urls)
    assert all((r.rule, r.verdict) == judge(r) for r in got)


def test_separators_and_borders_in_hosts(spark, tmp_path):
    hosts = ["a.com\x01b", "a.\x01com", "com\x01", "\x01.com", "com\x02", "x.com\x02\x03y", "\x02.com", "\U0010ffff.com", "com\U0010ffff", "\U0010ffff\U0010ffff.net", "x.net\U0010ffff", "a.com", ".com", "com.", "..com", "example.com\x00", "www.example.com\x01", "EXAMPLE.com"]
    pages = [(i, f"http://{h}{path}", None) for i, (h, path) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/x", "/es/", "?q"))]
    assert against_sql(spark, write(spark, tmp_path / "t", pages=pages), "op2_url_rules") == []


def test_every_range_gets_the_rules_of_its_keys(spark):
    from deltion.llm.url_filter import apply_rules

    urls = spark.createDataFrame([(i, f"http://{chr(0x10ffff) if i % 2 else 'a'}{i}.com\x01x.com/") for i in range(200)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    assert all(r.verdict == "block" for r in apply_rules(urls, rules, ranges=40).collect())
