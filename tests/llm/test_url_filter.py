"""URL filters against brute force over all rules, and small cases."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import queries, url_filter

URLS = [
    None, "", "no scheme here", "http://", "https://A.Example.COM/en/1", "https://www.example.com/en/1?x", "http://example.com", "http://example.com/", "http://notexample.com/en/", "http://x.net/es/7#t", "http://x.net/ES/7",
    "http://x.net/fr", "http://x.net:80/fr/1", "//y.net/fr/", "ftp://u@z.net/fr/?q=://w.com/", "http://cheap-pills.example.org/a", "http://my-cheap-pills.example.org/a", "http://shop.cheap-pills.org", "http://a.org/get.EXE", "http://a.org/get.exe?x=1",
    "http://a.org/?a=1&affid=3", "http://a.org/?myaffid=3", "http://en.wikipedia.org/warez/", "http://en.wikipedia.org", "http://analytics.site.org/blog/x", "http://analytics.site.org/x", "http://é.org/casino/ñ", "javascript:alert(1)", "http://a.org/" + "x/" * 5_000 + "porn/", "http://a.org/\n/porn/",
    "http://x.net/es/7#t",
]


def brute(url, rules):
    url = url or ""
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url)
    low = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x)
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fit = []
    for kind, rule, action in rules:
        if kind == "host":
            own, slash, rest = rule.partition("/")
            if (host == own or host.endswith("." + own)) and (path.startswith(slash + rest) if slash else path[:1] in ("", "/")):
                fit.append(("host", len(rule), rule, action))
        else:
            body = "".join({"*": "[\\s\\S]*", "^": "(?:[^0-9a-z_.%-]|\\Z)"}.get(c, re.escape(c)) for c in rule.strip("|").lower())
            begin = r"\A[a-z][0-9a-z+.\-]*://(?:[^/?#]*\.)?" if rule.startswith("||") else r"\A" if rule[0] == "|" else ""
            if re.search(begin + body + (r"\Z" if rule.endswith("|") else ""), low(url)):
                fit.append(("pattern", action == "allow", len(rule), rule, action))
    by_host = max((f for f in fit if f[0] == "host"), default=None)
    by_pattern = max((f for f in fit if f[0] == "pattern"), default=None)
    return host, path, by_host and by_host[2], (by_host or by_pattern or ["allow"])[-1], by_pattern and by_pattern[3]


@pytest.fixture(scope="module")
def pages(spark):
    more = [f"http://{h}.{d}/{p}" for h in ("a", "www.example", "m.ads", "ads", "x.analytics", "slots-of-time") for d in ("com", "net", "org", "gov") for p in ("", "en/1", "es/2?clickid=2", "fr/3.zip", "blog/redirect=http", "research/xxx/")]
    return spark.createDataFrame(list(enumerate(URLS + more)), "page_id long, url string").withColumns({c: F.lit("q") for c in ("row", "host", "token", "rank", "a.b")}).repartition(3)


@pytest.mark.parametrize("block", [1000, 7])
def test_against_brute_force(pages, block):
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    got = url_filter.annotate(pages, block=block).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == brute(urls[r["page_id"]], url_filter.DEFAULT), (urls[r["page_id"]] or "")[:99]


def test_rules_of_all_forms_against_brute_force(spark, pages):
    rules = [("pattern", p, a) for p, a in (("*", "block"), ("||", "block"), ("a*z", "allow"), ("|http://a.org^", "allow"), ("a.org|", "block"), ("^en^", "block"), ("EN/1", "allow"), ("(x", "block"), ("es/2?", "block"), ("e+[.]\\", "allow"))] + [("host", "org", "allow"), ("host", "a.org", "block"), ("host", "www.example.net/e", "allow")]
    table = spark.createDataFrame(rules + rules[:2], "kind string, rule string, action string")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in url_filter.annotate(pages, table).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == brute(urls[r["page_id"]], rules), (urls[r["page_id"]] or "")[:99]


def test_a_rule_is_indexed_by_its_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://common.org/{i}",) for i in range(50)] + [("http://rare.org/common/",)], "url string")
    rules = spark.createDataFrame([("pattern", "||rare.*/common/", "block"), ("pattern", "common", "block"), ("host", "common.org", "allow")], "kind string, rule string, action string")
    index = {r["rule"]: (r["token"], sorted(r["tokens"])) for r in url_filter.rarest(url_filter.compiled(rules), urls).collect()}
    assert index == {"||rare.*/common/": ("rare", ["common", "rare"]), "common": ("", []), "common.org": ("common", ["common", "org"])}


def test_no_python_on_the_way(pages):
    plan = url_filter.annotate(pages.select("page_id", "url"))._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan


def test_keep_returns_whole_rows(spark, pages):
    kept = url_filter.keep(pages)
    assert kept.columns == pages.columns
    want = sorted(r["page_id"] for r in url_filter.annotate(pages).where("verdict = 'allow'").collect())
    assert sorted(r["page_id"] for r in kept.collect()) == want
    assert url_filter.annotate(pages.limit(0)).count() == 0 and url_filter.keep(pages.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (1, "http://a.net/es/"), (None, "http://a.net/es/"), (None, None)], "page_id long, url string")
    got = sorted(map(str, ((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.annotate(pages).collect())))
    assert got == sorted(map(str, [(1, "com/", "allow"), (1, "com/", "allow"), (1, "net/es/", "block"), (None, "net/es/", "block"), (None, None, "allow")]))
    assert all(r["verdict"] == "allow" and r["rule"] is None for r in url_filter.annotate(pages, url_filter.rule_table(spark, [])).collect())


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    columns = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    want = duck.sql(queries.SQL["op11_url_filter"])
    assert sorted(want.columns) == sorted(columns)
    got = queries.op11_url_filter(spark, sf)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())))
