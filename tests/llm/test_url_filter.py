import pytest

from alertlake.llm.queries import table
from alertlake.llm.url_filter import RULES, judge, judge_sql, rule_table

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


CASES = [
    ("https://A.Example.COM/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, "allow"),
    ("http://q.example.net/de/8", "q.example.net", "/de/8", "example.net/de/8", "block"),
    ("http://q.example.net/de/9", "q.example.net", "/de/9", "net/de/", "allow"),
    ("http://x.org/es/#f", "x.org", "/es/", "org/es/", "block"),
    ("http://x.org?/es/", "x.org", "", None, "allow"),
    ("HTTP://ÄB.De", "Äb.de", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("//no-scheme/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://two\nlines.com/en/\nx", "two\nlines.com", "/en/\nx", "com/en/", "block"),
]


@pytest.fixture(scope="module")
def told(pages):
    """Two runs, so that pages of one host don't seed each other."""
    found = {}
    for urls in ([c[0] for c in CASES[::2]], [c[0] for c in CASES[1::2]]):
        found |= {urls[r.page_id]: r for r in judge(pages([(u, None) for u in urls])).collect()}
    return found


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), CASES)
def test_rules(told, url, host, path, rule, verdict):
    r = told[url]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def walk(seed, edges, damping=0.85, rounds=10):
    score = {h: (1 - damping) * s for h, s in seed.items()}
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in seed.items()}
        for (a, b), n in edges.items():
            new[b] += damping * score[a] * n / sum(m for (x, _), m in edges.items() if x == a)
        score = new
    return score


def test_both_walks_against_a_plain_one(pages):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    df = pages([
        ("http://good.net/de/1", link("mid.fr", "MID.fr", "good.net", "end.fr")),
        ("http://mid.fr/a", link("end.fr", "farm.fr")),
        ("http://end.fr/a", None),
        ("http://farm.fr/a", link("bad.com", "bad.com") + "<a href='//bad.com'>"),
        ("http://feeder.fr/a", "<a href=https://farm.fr?q>" + '<a href="/local">'),
        ("http://bad.com/en/1", link("end.fr")),
        ("http://bad.com/fr/1", ""),
    ])
    got = {r.page_id: r for r in judge(df).collect()}
    edges = {("good.net", "mid.fr"): 2, ("good.net", "end.fr"): 1, ("mid.fr", "end.fr"): 1, ("mid.fr", "farm.fr"): 1, ("farm.fr", "bad.com"): 3, ("feeder.fr", "farm.fr"): 1, ("bad.com", "end.fr"): 1}
    hosts = {h for e in edges for h in e}
    trust = walk({h: float(h == "good.net") for h in hosts}, edges)
    distrust = walk({h: 0.5 * (h == "bad.com") for h in hosts}, {(b, a): n for (a, b), n in edges.items()})
    for r in got.values():
        assert r.trust == pytest.approx(trust[r.host]) and r.distrust == pytest.approx(distrust[r.host])
    assert [got[i].verdict for i in range(7)] == ["allow", "allow", "allow", "block", "block", "block", "block"]


def test_empty_and_clashing_columns(pages):
    assert judge(pages([])).collect() == []
    from pyspark.sql import functions as F

    df = pages([("http://x.com/en/", None)] * 3).withColumns({c: F.lit("?") for c in ("host", "path", "rule", "trust", "walk")})
    assert [r.verdict for r in judge(df).collect()] == ["block"] * 3


def test_walks_go_on_until_verdicts_stand(pages):
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [("http://bad.com/en/1", None), ("http://h1.fr/", link("bad.com")), *((f"http://h{i}.fr/", link(f"h{i - 1}.fr")) for i in range(2, 16))]
    # Two hosts that link to each other, one of them to the blocked one: the walk never ends by itself.
    rows += [("http://r1.fr/", link("r2.fr") + link("bad.com")), ("http://r2.fr/", link("r1.fr"))]
    got = {r.host: r for r in judge(pages(rows)).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    edges = {("bad.com", "h1.fr"): 1, ("bad.com", "r1.fr"): 1, ("r1.fr", "r2.fr"): 1, ("r2.fr", "r1.fr"): 1, **{(f"h{i - 1}.fr", f"h{i}.fr"): 1 for i in range(2, 16)}}
    want = walk({h: float(h == "bad.com") for h in got}, edges, rounds=300)
    assert all(got[h].distrust == pytest.approx(want[h], abs=1e-6) for h in got)
    assert got["h15.fr"].distrust == pytest.approx(0.15 * 0.85**15 / 2)


def test_thousands_of_rules(pages, spark):
    """More rules than a plan could list; each page falls under the longest of its own."""
    rules = [("block", f"h{i}.com", "/a/") for i in range(3000)] + [("allow", f"h{i}.com", f"/a/{i % 7}") for i in range(3000)] + [("block", "com", "/z")]
    urls = [(f"http://w.h{i}.com/a/{j}", None) for i in range(0, 3000, 100) for j in (i % 7, 8)] + [("http://x.com/zz", None), ("http://com", None)]
    for given in (rules, rule_table(spark, rules)):
        got = {r.page_id: (r.rule, r.verdict) for r in judge(pages(urls), given).collect()}
        for k, i in enumerate(range(0, 3000, 100)):
            assert got[2 * k] == (f"h{i}.com/a/{i % 7}", "allow") and got[2 * k + 1] == (f"h{i}.com/a/", "block")
        assert got[len(urls) - 2] == ("com/z", "block") and got[len(urls) - 1][0] is None


def test_the_tables_pages_with_links_put_in(spark, sf):
    """The test tables' pages have relative links only: with links between their hosts, verdicts follow the SQL's walk."""
    import duckdb
    from pyspark.sql import functions as F

    own = table(spark, sf, "pages").orderBy("page_id").toPandas()
    hosts = own["url"].str.extract(r"://([^/?#]*)")[0].str.lower().dropna().unique()
    rank = {h: i for i, h in enumerate(hosts)}
    # A tree of hosts: no link leads farther than the ten steps that the SQL takes.
    own["html"] = [f'<a href="https://{hosts[(rank[h] - 1) // 2]}/p">' if (h := (u or "").split("://")[-1].split("/")[0].lower()) in rank and rank[h] else None for u in own["url"]]
    con = duckdb.connect()
    con.register("pages", own)
    want = sorted(con.execute(judge_sql()).fetchall(), key=lambda r: r[0])
    got = judge(spark.createDataFrame(own)).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want
    plain = judge(spark.createDataFrame(own).withColumn("html", F.lit(None).cast("string"))).select("page_id", "verdict").orderBy("page_id").collect()
    assert [r.verdict for r in got] != [r.verdict for r in plain] and len(RULES) == 5
