import random

import pytest

from terrane.llm import urls
from tests.conftest import DATA
from tests.oracle import same

SCHEMA = "page_id long, url string, html string, host string, rule string, verdict string"


def slow(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, default)


ODD = [None, "", "no scheme", "http://", "://net/", "http://NET/", "http://net", "http://net?x", "http://example.net/en", "http://example.net/en/", "http://a.example.net/en/x?y=/z#w", "http://xexample.net/en/",
       "https://M.Example.COM/de/1", "https://example.com/DE/1", "http://org/fr/", "http://a.org./fr/", "http://user@net:80/", "http://a.net/\nb", "ftp://a://b.net/", "http://É.net/ü", "http://" + "a." * 500 + "net/", "http://net/" + "x" * 20000]


@pytest.mark.parametrize("rules", [urls.RULES, [("block", "b", ""), ("allow", "a.b", ""), ("block", "a.b", "/p"), ("allow", "c.a.b", "/p/q/")], [], [("allow", "net", "/")]], ids=["own", "nested", "none", "one"])
def test_equals_brute_force(spark, rules):
    rng = random.Random(1)
    pool = ODD + [f"http://{'.'.join(rng.choice('abcn') for _ in range(rng.randint(1, 5)))}.b/{rng.choice(('', 'p', 'p/q', 'p/q/', 'x/p/q/'))}" for _ in range(300)]
    rows = [(i, u, "h", "own", "own", "own") for i, u in enumerate(pool)] + [(5, pool[5], "h", None, None, None)]
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got == {i: slow(u, rules) for i, u in enumerate(pool)}


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("listed,universe", [(1, 1), (1, 5000), (300, 20000), (500, 500)])
def test_cascade_is_exact_over_its_universe(spark, listed, universe):
    every = spark.range(universe).selectExpr("concat('k', id) AS key")
    cascade = urls.Cascade.build(every.limit(listed), every)
    assert every.where(cascade.holds(every.key)).count() == listed


def test_plan_is_native_and_joins_nothing(spark):
    plan = urls.op7_url_filter(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_matches_sql(spark):
    same(spark, f"{DATA}/sf0.01", urls.op7_url_filter, urls.OP7_SQL)


def test_a_table_of_rules_beyond_literals(spark, monkeypatch):
    """Rules as a table, with nulls and repeats, and filters that are subqueries; the answer is the list's."""
    rng = random.Random(3)
    rules = list({(f"{'.'.join(rng.choice('abcn') for _ in range(rng.randint(1, 3)))}.b", rng.choice(("", "/", "/p", "/p/q"))): rng.choice(("block", "allow")) for _ in range(200)}.items())
    rules = [(v, h, p) for (h, p), v in rules]
    pool = [f"http://{'.'.join(rng.choice('abcn') for _ in range(rng.randint(1, 5)))}.b/{rng.choice(('', 'p', 'p/q', 'p/q/', 'x'))}" for _ in range(300)] + ODD
    rows = [(i, u, "h", None, None, None) for i, u in enumerate(pool)]
    table = spark.createDataFrame([*rules, *rules[:20], (None, "b", "/"), ("block", None, "/"), ("block", "b", None)], "verdict string, host string, path string")
    monkeypatch.setattr(urls, "LITERAL", 2)
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA), table).collect()}
    assert got == {i: slow(u, rules) for i, u in enumerate(pool)}
    monkeypatch.setattr(urls, "MOST", 1)
    with pytest.raises(ValueError):
        urls.filter_urls(spark.createDataFrame(rows, SCHEMA), table)
