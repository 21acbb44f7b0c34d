from __future__ import annotations

import duckdb

from panelspark.llm.queries import ORACLE_SQL, URL_RULES
from panelspark.llm.urls import filter_urls

ASCII = {c: c + 32 for c in range(65, 91)}
URLS = [None, "", "no scheme", "://", "http://Example.ORG", "http://example.org/es/x?y#z", "http://a.b.EXAMPLE.org/en/12", "http://notexample.org/es/", "https://x.com/fr/1://y",
        "https://x.com/de/", "https://x.com/De/", "ftp://com/fr/", "http://org./a", "http://.org/a", "http://org#/a", "http://u@h.org:80/a", "http://example.org/\nes/",
        "http://é.ÉX.org/ü" + "/long" * 3000, "http://x.net/a", "http://example.org/en/1", "http://example.org/es"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return rest[:n].translate(ASCII), rest[n:m]


def judge(url, rules, default="allow"):
    host, path = split(url)
    fits = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, default)


def check(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, table).collect()}
    known = [r for r in rules if r[0] is not None and r[1] is not None]
    assert got == {i: judge(u, known) for i, u in enumerate(URLS * 2)}


def test_rules_of_the_query(spark):
    check(spark, list(URL_RULES))


def test_ties_nulls_and_repeats(spark):
    check(spark, [("org", "/a", "allow"), ("org", "/a", "block"), ("x.com", "/", "allow"), ("com", "/fr", "block"), (None, "/", "block"), ("org", None, "block"),
                  ("org", "/a", "block"), ("x.net", "", "block"), ("é.Éx.org", "/ü/l", "block")])


def test_hot_urls_keep_all_rows(spark):
    urls = [None if i % 3 == 0 else "http://a.org/x" if i % 3 == 1 else f"http://h{i}.com/fr/{i}" for i in range(6000)]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, salt int, row int")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    got = filter_urls(pages, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judge(u, list(URL_RULES)) for i, u in enumerate(urls)}
    assert len(got) == 6000 and all((r.salt, r.row) == (1, 2) for r in got)


def test_no_rules_and_no_pages(spark):
    check(spark, [])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")).collect() == []


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = filter_urls(pages, spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_oracle_agrees_on_odd_urls():
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    got = {r[0]: tuple(r[1:]) for r in con.execute(ORACLE_SQL["op4_url_filters"]).fetchall()}
    assert got == {i: judge(u, URL_RULES) for i, u in enumerate(URLS)}
