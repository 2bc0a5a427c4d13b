from pyspark.sql import functions as F

from talentmesh.llm import urls
from talentmesh.llm.queries import URL_RULES

from .helpers import frame

URLS = ["http://a.net/x", "https://A.Example.NET/en/1?q=/de/", "http://example.net/en", "http://example.net/en/", "http://net/", "http://net",
        "http://xexample.com/de/1", "http://m.example.com/de/1#a", "http://b.org/fr/", "http://b.org/FR/", "ftp://b.org#/fr/", None, "", "no scheme",
        "://", "http://c.net?x=/", "http://a.b.c.example.net/de/", "http://evil.org.net/fr/", "x://y://z.net/", "http://é.net/ü", "http://net./",
        "http://a.net:80/x", "http://a.net/x"]


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, default
    best = min(fit, key=lambda r: (-len(r.key), r.host, r.path))
    return host, path, best.key, best.verdict


def check(spark, rules, values):
    df = frame(spark, list(enumerate(values)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, rules).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(values)}


def test_rules(spark):
    check(spark, URL_RULES, URLS)


def test_many_rules_over_a_wide_universe(spark):
    rules = [urls.Rule(f"h{i}.net", f"/{'abc'[i % 3]}/" if i % 2 else "", "block" if i % 5 else "allow") for i in range(60)]
    check(spark, rules, [f"http://{'w.' * (i % 3)}h{i % 200}.net/{'abcd'[i % 4]}/{i}" for i in range(1500)])


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 4000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urls.build_cascade(universe.union(universe), listed)
    assert len(cascade.levels) > 1
    got = universe.where(cascade.contains(F.col("key"))).select("key").collect()
    assert {r[0] for r in got} == {f"k{i}" for i in range(0, 4000, 7)}


def test_empty_tables_and_no_rules(spark):
    df = frame(spark, [], "page_id long, url string")
    assert urls.judge(df, URL_RULES).collect() == []
    one = frame(spark, [(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(one, []).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_no_python_in_the_plan(spark):
    df = frame(spark, [(1, "http://a.net/x")], "page_id long, url string")
    plan = urls.judge(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_rules_whose_filters_outgrow_a_plan_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_WORDS", 0)
    check(spark, URL_RULES, URLS)
    rules = [urls.Rule(f"h{i}.net", f"/{'abc'[i % 3]}/" if i % 2 else "", "block" if i % 5 else "allow") for i in range(60)]
    check(spark, rules, [f"http://{'w.' * (i % 3)}h{i % 200}.net/{'abcd'[i % 4]}/{i}" for i in range(300)])
