import random

import pytest
from pyspark.sql import functions as F

from depweave.llm import url_filter as U
from tests.compare import held

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA)


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules_hosts_and_paths(spark):
    urls = [
        "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "x://notexample.com/en/7", "http://com/en/", "http://com/EN/", "http://b.example.net/de/81", "http://c.net/de/8", "ftp://a.org/es/#x", "http://a.org?x=http://b.com/en/",
        "no scheme", None, "http://", "http://a.com//en/", "a://b://c/d", "http://É.com/en/1", "http://a.com\n/en/",
    ]
    got = verdicts(U.judge(pages(spark, [(u, None) for u in urls])))
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[i][2] for i in range(1, 9)] == ["com/en/", "com/en/", "com/en/", None, "example.net/de/8", "net/de/", "org/es/", None]
    assert got[8][:2] == ("a.org", "") and got[9] == ("", "", None, "allow") == got[10] and got[11][:2] == ("", "")
    assert got[12][1:3] == ("//en/", None) and got[13][:2] == ("b:", "//c/d") and got[14][:3] == ("É.com", "/en/1", "com/en/")


def slow_rank(seed, links, rounds, backwards=False):
    base = {h: s * (100 - U.DAMPING) // 100 for h, s in seed.items()}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    mass = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for a, bs in out.items():
            for b in bs:
                giver, taker = (b, a) if backwards else (a, b)
                if giver in mass:
                    new[taker] = new.get(taker, 0) + mass[giver] * U.DAMPING // (100 * len(bs))
        mass = new
    return mass


def test_distrust_runs_backwards_and_trust_forwards(spark):
    link = lambda *hosts: "".join(f"<a HREF = '//{h}/x'>" for h in hosts)
    rows = [("http://bad.com/en/1", None), ("http://farm.io/a", link("BAD.com", "bad.com")), ("http://neutral.io/a", "<a href=/en/>"), ("http://mixed.io/", link("bad.com", "neutral.io", "example.com", "q.io", "r.io", "s.io"))]
    got = verdicts(U.judge(pages(spark, rows)))
    assert [got[i][3] for i in range(4)] == ["block", "block", "allow", "allow"]
    assert verdicts(U.judge(pages(spark, rows), threshold=10))[3][3] == "block"
    rescued = rows + [("http://good.example.com/en/7", link("farm.io"))]
    assert verdicts(U.judge(pages(spark, rescued)))[1][3] == "allow"


def test_every_member_of_a_farm_is_caught(spark):
    """However many hosts point at a blocked one; those that also link elsewhere as much are not."""
    link = lambda *hosts: "".join(f'<a href="https://{h}">' for h in hosts)
    rows = [("http://bad.org/es/", None)] + [(f"http://farm{i}.io/", link("bad.org")) for i in range(40)] + [(f"http://second{i}.io/", link(f"farm{i}.io")) for i in range(3)] + [("http://fair.io/", link("bad.org", "a.io"))]
    got = verdicts(U.judge(pages(spark, rows)))
    assert [got[i][3] for i in range(len(rows))] == ["block"] * 44 + ["allow"]


def test_ranks_and_sql_on_a_random_graph(spark, tmp_path):
    rng = random.Random(2)
    hosts = [f"h{i}.{t}" for i in range(12) for t in ("com", "net", "org", "io")]
    rows = [(f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(9)}", "".join(f'<a href="http://{rng.choice(hosts)}/">' for _ in range(rng.randrange(5)))) for _ in range(150)]
    df = pages(spark, rows)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    parsed = df.withColumn("host", U.host_of(F.col("url")))
    links = {(r.src, r.dst) for r in U.host_edges(parsed).collect()}
    seed = {h: 10**9 // (i + 1) for i, h in enumerate(hosts[:9])}
    got = {r.host: r.mass for r in U.propagate(spark.createDataFrame(list(seed.items()), "host string, seed long"), U.host_edges(parsed), 5).collect()}
    assert got == slow_rank(seed, links, 5)
    got = {r.host: r.mass for r in U.propagate(spark.createDataFrame(list(seed.items()), "host string, seed long"), U.host_edges(parsed), 5, backwards=True).collect()}
    assert got == slow_rank(seed, links, 5, backwards=True)
    assert held(spark, str(tmp_path), U.query, U.SQL) == 150


def test_clashing_names_and_long_html(spark):
    names = ["__host", "__best", "__verdict", "c0", "n", "Rule", "mass", "a.b"]
    html = "<p>x</p>" * 200_000 + '<a href="//bad.com">'
    rows = [(1, "http://bad.com/en/", None, *names), (2, "http://far.io/", html, *names), (2, "http://far.io/", html, *names)]
    out = U.judge(spark.createDataFrame(rows, ["page_id", "url", "html", *names]))
    assert out.columns == ["page_id", "url", *(n for n in names if n != "Rule"), "host", "path", "rule", "verdict"]
    assert all(r["verdict"] == "block" and r["__host"] == "__host" and r["n"] == "n" for r in out.collect())


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/", "x", "y"), (1, "http://a.com/en/", "x", "y")], "page_id long, url string, host string, verdict string").withColumn("html", F.lit(None).cast("string"))
    assert [(r.page_id, r.verdict) for r in U.judge(df).collect()] == [(1, "block")] * 2
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
