import datetime as dt

from judgefuse.llm import queries, urls

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)


def test_as_of(spark):
    entries = spark.createDataFrame([
        (1, "bad.com", D(10), "block"), (2, "bad.com", D(40), "remove"), (3, "ok.bad.com", D(20), "allow"),
        (4, "x.org/p", D(5), "block"), (5, "bad.com", D(10), "block"), (6, "twice.net", D(3), "block"),
        (7, "twice.net", D(3), "allow"), (8, None, D(1), "block"), (9, "n.com", None, "block"), (10, "late.com", D(300), "block"),
    ], "entry_id long, pattern string, day date, action string")
    rows = [(1, "http://a.bad.com/x", D(9), True), (2, "http://a.bad.com/x", D(10), False), (3, "http://A.BAD.com./x", D(39), False),
            (4, "https://bad.com", D(40), True), (5, "http://ok.bad.com/", D(19), False), (6, "http://u:p@ok.bad.com:80/", D(20), True),
            (7, "http://x.org/p/q?z", D(200), False), (8, "http://x.org/pp", D(200), True), (9, "http://twice.net/", D(9), True),
            (10, None, D(9), True), (11, "http://a.bad.com/x", None, True), (12, "not a url", D(9), True),
            (2, "http://a.bad.com/x", D(10), False), (13, "http://late.com/" + "y" * 50000, D(299), True), (14, "http://late.com/", D(400), False)]
    captures = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, fetched date").selectExpr("*", "1 as pattern")
    got = sorted((r.page_id, r.kept) for r in urls.judge(captures, entries).collect())
    assert got == sorted((r[0], r[3]) for r in rows)
    assert urls.judge(captures, entries.limit(0)).filter("not kept").count() == 0
    assert urls.judge(captures.limit(0), entries).count() == 0


def test_query_keeps_rows(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op8_url_filter(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
