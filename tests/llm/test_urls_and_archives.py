"""URL rules against a linear search, and WARC archives read back through the index."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contactloom.llm import url_filter, warc
from contactloom.llm.queries import OP3_SQL, OP7_SQL, QUERIES

RULES = "host string, path string, verdict string"


def expected(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (url, host, path, best[2] if best else None, best[3] if best else default)


def test_rules(spark):
    rng = random.Random(4)
    labels, paths = ["a", "b", "c.d", "xn--e", "É"], ["", "/", "/a", "/a/b", "/ab", "/b?x", "/a\nb", "/é/"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(paths)): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"https://{host()}{rng.choice(paths)}{rng.choice(['', '/a', '?q=1', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://A.B/A", "x://y://a/b", "http://a" + ".a" * 300 + "/", urls[0], urls[0]]
    df = spark.createDataFrame([(i % 50, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string").repartition(3)
    got = url_filter.match_rules(df, spark.createDataFrame(rules, RULES), default="allow").collect()
    assert sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted((expected(u, rules, "allow") for u in urls), key=str)


def test_rules_with_nulls_twins_and_empty_tables(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("A.B", "/", "block"), (None, "/", "block"), ("a.b", None, "block")], RULES)
    pages = spark.createDataFrame([(1, "http://a.b/x"), (None, None)], "page_id long, url string")
    assert {(r.rule, r.verdict) for r in url_filter.match_rules(pages, rules).collect()} == {("a.b/", "block"), (None, "allow")}
    assert [r.verdict for r in url_filter.match_rules(pages, rules.where("host = '-'"), default="block").collect()] == ["block"] * 2
    assert url_filter.match_rules(pages.where("page_id > 5"), rules).count() == 0


@pytest.mark.parametrize(("name", "sql"), [("op3_url_filters", OP3_SQL), ("op7_warc", OP7_SQL)])
def test_queries_equal_their_sql(spark, name, sql):
    import duckdb

    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()) == want


def test_archives_round_trip(spark):
    rng = random.Random(2)
    big, small = "<p>" + "é" * 60, "tiny"
    pages = [(i, f"http://{rng.choice('abc')}.example.org/{i % 7}", rng.choice([big, small, None, "", f"<b>{i}</b>" * 30, "\r\n\r\nWARC/1.1\r\n" * 20])) for i in range(300)]
    pages += [(1000, None, big), (1001, "no host", "x" * 300_000), (1002, "http://a.example.org/1?q", "x" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int").repartition(4)
    rows = {r.page_id: r for r in warc.archive_and_read(df, lines=7).collect()}
    assert len(rows) == len(pages)
    first = {}
    for page, _, html in sorted(pages, key=lambda p: p[0]):
        data = (html or "").encode()
        r = rows[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        origin = first.setdefault(data, page) if len(data) >= 100 else page
        assert (r.record_type, r.refers_to) == (("response", None) if origin == page else ("revisit", origin))
        assert bytes(r.content) == (data if origin == page else b"")
    assert warc.archive_and_read(df.where("page_id < 0")).count() == 0


def test_archives_with_null_and_equal_ids(spark):
    df = spark.createDataFrame([(None, "http://a/", "z" * 200), (5, "http://a/", "z" * 200), (5, "http://a/", "z" * 200)], "page_id long, url string, html string")
    rows = warc.archive_and_read(df).collect()
    assert sorted((str(r.page_id), r.record_type) for r in rows) == [("5", "response"), ("5", "response"), ("None", "response")]


def test_damaged_records_are_refused():
    data = warc.record_bytes(1, "http://a/", b"abc", "d", None)
    assert warc.parsed_record(data)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parsed_record(data[:-3])


def test_hosts_of_one_ancestor_are_spread_over_the_ranges(spark, monkeypatch):
    """Many hosts with one path meet the sweep as one key of their common ancestor."""
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/")).alias("url"))
    rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow"), ("org", "/x", "block")], "host string, path string, verdict string")
    swept, seen = url_filter.swept, []

    def spy(keys, stacks, ranges):
        seen.append(keys.where("ancestor = 'com'").count())
        return swept(keys, stacks, ranges)

    monkeypatch.setattr(url_filter, "swept", spy)
    out = url_filter.match_rules(pages, rules)
    assert out.count() == 6000 and {r.page_id for r in out.where("verdict = 'allow'").collect()} == {7}
    assert seen == [1]
