"""Link ranks far from their seeds and with many seeds."""

from tofcube.llm import urls

BAD = urls.UrlRule("block", "bad.com/")


def judged(spark, links):
    pages = [(k, f"http://{a}/", f'<a href="http://{b}/">x</a>' if b else None) for k, (a, b) in enumerate(links)]
    return lambda rules, **k: {r["host"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), rules, **k).collect()}


def test_chain_longer_than_eight_hosts(spark):
    hosts = ["bad.com", *(f"h{k}.net" for k in range(14))]
    got = judged(spark, [(hosts[0], None), *zip(hosts[1:], hosts, strict=False)])([BAD], min_distrust=1e-3)
    assert got == dict.fromkeys(hosts, "block")


def test_threshold_follows_the_number_of_seeds(spark):
    for n in (1, 60):
        seeds = [(f"s{k}.bad.com", None) for k in range(n)]
        assert judged(spark, [*seeds, ("near.net", "s0.bad.com")])([BAD], min_distrust=0.05)["near.net"] == "block"


def test_share_of_own_links_decides(spark):
    """One link to a blocked host among 200 doesn't block, nor does linking to such a host alone; 150 of 200 do."""
    other = [("few.net", f"x{k}.net") for k in range(200)] + [("few.net", "bad.com")]
    many = [("many.net", "bad.com")] * 150 + [("many.net", f"x{k}.net") for k in range(50)]
    got = judged(spark, [("bad.com", None), *other, *many, ("follows.net", "few.net"), ("behind.net", "many.net")])([BAD])
    assert got == {"bad.com": "block", "few.net": "allow", "many.net": "block", "follows.net": "allow", "behind.net": "block"}


def test_host_with_few_blocked_pages(spark):
    """A host that is blocked in one page of a hundred passes on a hundredth of its distrust."""
    pages = [(k, f"http://big.com/{'bad' if k == 0 else k}", None) for k in range(100)] + [(200, "http://fan.net/", '<a href="http://big.com/">x</a>')]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, [urls.UrlRule("block", "big.com/bad")]).collect()}
    assert got[0] == "block" and got[1] == "allow" and got[200] == "allow"


def test_sql_says_the_same_of_linked_pages(spark, tmp_path):
    """The query's SQL over pages with links, where eight rounds are enough."""
    import random

    import duckdb

    from tofcube.llm import queries

    rnd = random.Random(8)
    hosts = ["a.org", "shop.com", "x.net", "y.net", "z.net", "example.org", "u.net", "v.net"]
    page = lambda k: (k, f"http://{rnd.choice(hosts)}/{rnd.choice(['de/', 'fr/', 'es/1', 'en/2', ''])}{k}", "".join(f'<a href="//{rnd.choice(hosts)}/{j}">l</a>' for j in range(rnd.randint(0, 3))))
    more = [(100, "http://w.com/de/1", None), (101, "http://fan.net/", '<a href="//w.com/">l</a>')]
    spark.createDataFrame([page(k) for k in range(60)] + more, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    want = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op2_url_filter']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
