import datetime as dt

import duckdb
from pyspark.sql import functions as F

from lociframe.llm.url_filters import ORACLE_SQL, domains_of, filter_captures, host_of, op9_temporal_url_filters, page_of, validity_intervals

DAY = dt.date(2024, 1, 1)


def on(n):
    return DAY + dt.timedelta(n)


ENTRIES = [
    ("domain", "bad.example", "block", on(0)),
    ("domain", "bad.example", "remove", on(10)),
    ("domain", "bad.example", "block", on(20)),
    ("host", "ok.bad.example", "allow", on(5)),
    ("page", "ok.bad.example/x", "block", on(6)),
    ("host", "tie.example", "allow", on(3)),
    ("host", "tie.example", "block", on(3)),
    ("host", "tie.example", "remove", on(3)),
    ("odd", "a", "block", on(0)),
    ("host", None, "block", on(0)),
    ("host", "void.example", "shout", on(0)),
    ("host", "void.example", "block", None),
]


def judge(spark, rows, entries=ENTRIES):
    captures = spark.createDataFrame([(i, u, d, "v") for i, u, d in rows], "page_id long, url string, fetched_on date, verdict string")
    return filter_captures(captures, spark.createDataFrame(entries, "scope string, value string, action string, listed_on date"))


def test_as_of(spark):
    cases = [
        ("http://A.B.bad.example./p?q", on(0), "block"),
        ("http://bad.example", on(9), "block"),
        ("http://bad.example:80/", on(10), "none"),
        ("http://bad.example", on(19), "none"),
        ("http://user@bad.example/#f", on(20), "block"),
        ("http://notbad.example", on(0), "none"),
        ("http://ok.bad.example/y", on(4), "block"),
        ("http://ok.bad.example/y", on(5), "allow"),
        ("http://ok.bad.example/X/", on(7), "block"),
        ("http://ok.bad.example/x", on(5), "allow"),
        ("http://tie.example", on(3), "block"),
        ("http://void.example", on(9), "none"),
        ("nothing", on(0), "invalid"),
        (None, on(0), "invalid"),
        ("http://bad.example", None, "undated"),
        ("http://bad.example", on(-1), "none"),
    ]
    got = {r.page_id: r for r in judge(spark, [(i, u, d) for i, (u, d, _) in enumerate(cases)]).collect()}
    assert [got[i].verdict for i in range(len(cases))] == [c[2] for c in cases]
    assert (got[7].rule_scope, got[7].rule_value, got[7].rule_from) == ("host", "ok.bad.example", on(5))


def test_hot_host_repeats_and_empty_tables(spark):
    rows = [(1, "http://w.bad.example/p", on(1))] * 3000 + [(None, "http://z.example/" + "y" * 50000, on(1))] * 2 + [(k, f"http://h{k}.example/", on(1)) for k in range(500)]
    got = judge(spark, rows).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 3000, "none": 502}
    assert judge(spark, []).count() == 0
    assert {r.verdict for r in judge(spark, rows[-5:], []).collect()} == {"none"}


def test_intervals_and_urls(spark):
    got = validity_intervals(spark.createDataFrame(ENTRIES, "scope string, value string, action string, listed_on date")).collect()
    assert {(r.key, r.action, r.valid_from, r.valid_to) for r in got} == {
        ("domain:bad.example", "block", on(0), on(10)),
        ("domain:bad.example", "block", on(20), None),
        ("host:ok.bad.example", "allow", on(5), None),
        ("page:ok.bad.example/x", "block", on(6), None),
        ("host:tie.example", "block", on(3), None),
    }
    url = F.lit("HTTPS://Me:pw@A.b.C.d:8080/P/q//?x#y")
    row = spark.range(1).select(host_of(url), page_of(url), domains_of(host_of(url))).first()
    assert tuple(row) == ("a.b.c.d", "a.b.c.d/P/q", ["b.c.d", "c.d"])


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    key = lambda r: tuple(str(x) for x in r)
    cols = ["page_id", "host", "fetched_on", "verdict", "rule_scope", "rule_value", "rule_from"]
    want = sorted(map(key, con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL})").fetchall()))
    df = op9_temporal_url_filters(spark, sf)
    assert sorted(map(key, df.select(*cols).collect())) == want
    assert "Python" not in df._jdf.queryExecution().toString()


def test_a_key_with_many_dates(spark):
    """Rows in step with the captures, whatever the number of dates of their key."""
    entries = [("host", "busy.example", ("block", "allow", "remove")[i % 3], on(i)) for i in range(600)]
    rows = [(i, "http://busy.example/p", on(i % 700 - 20)) for i in range(4000)]
    got = {r.page_id: (r.verdict, r.rule_from) for r in judge(spark, rows, entries).collect()}
    for i, _, day in rows:
        n = min((day - DAY).days, 599)
        want = ("none", None) if n < 0 or n % 3 == 2 else (("block", "allow")[n % 3], on(n))
        assert got[i] == want
