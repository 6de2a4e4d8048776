"""The ordered primitives against brute force on small random tables, hot keys included."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.operators import ordered as O


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(3)
    out = [("c1", rnd.randrange(0, 900), rnd.randrange(1, 9)) for _ in range(120)]
    out += [("c1", 500, 1)] * 60  # a third of all rows at one position
    out += [("c2", rnd.randrange(0, 50), 2) for _ in range(5)]
    return out


def test_cumulative_at(spark, items):
    points = [(c, p, s) for c in ("c1", "c2", "c3") for p in (-70, 0, 1, 499, 500, 501, 899, 2000) for s in (O.BEFORE, O.UP_TO)]
    got = O.cumulative_at(
        spark.createDataFrame(points, "chr string, p bigint, side int"),
        spark.createDataFrame(items, "chr string, pos bigint, v bigint"),
        ["v"],
        width=64,
    )
    want = sorted(
        (c, p, s, sum(v for k, pos, v in items if k == c and (pos < p or (s == O.UP_TO and pos == p)))) for c, p, s in points
    )
    assert rows(got) == want


def test_window_totals_of_points_and_intervals(spark, items):
    windows = [("c1", a, a + w) for a in range(-100, 950, 90) for w in (0, 40, 333)]
    wdf = spark.createDataFrame(windows, "chr string, lo bigint, hi bigint")
    spans = [(c, p, p + 17 * v, v) for c, p, v in items]
    sdf = spark.createDataFrame(spans, "chr string, s bigint, e bigint, v bigint")
    points = O.window_totals(wdf, sdf.select("chr", F.col("s").alias("pos"), "v"), ["v"], width=64)
    assert rows(points) == sorted((c, a, b, sum(v for k, s, _, v in spans if k == c and a <= s <= b)) for c, a, b in windows)
    touching = O.window_totals(wdf, sdf, ["v"], first="s", last="e", width=64)
    assert rows(touching) == sorted((c, a, b, sum(v for k, s, e, v in spans if k == c and s <= b and e >= a)) for c, a, b in windows)


def test_previous_row_crosses_buckets(spark):
    data = [("a", p) for p in (1, 5, 300, 301, 900)] + [("b", 7)]
    df = spark.createDataFrame(data, "chr string, p bigint")
    got = O.previous_row(df, ["chr"], "p", ["p"], [], width=64).select("chr", "p", F.col("prev.p").alias("q"))
    assert sorted((r.chr, r.p, r.q or -1) for r in got.collect()) == [
        ("a", 1, -1), ("a", 5, 1), ("a", 300, 5), ("a", 301, 300), ("a", 900, 301), ("b", 7, -1)
    ]


def test_last_seen_and_running_total(spark):
    data = [("f", i, "h" if i in (2, 70) else "x", 1) for i in range(0, 140, 2)]
    df = spark.createDataFrame(data, "file string, line bigint, kind string, n bigint")
    seen = O.last_seen(df, ["file"], "line", F.col("kind") == "h", [], width=16).select("line", F.col("seen.line").alias("at"))
    assert {r.line: r["at"] for r in seen.collect()} == {i: (None if i < 2 else 2 if i < 70 else 70) for i in range(0, 140, 2)}
    total = O.running_total(df, ["file"], "line", ["line"], "n", "before", width=16)
    assert {r.line: r.before for r in total.collect()} == {i: i // 2 for i in range(0, 140, 2)}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_neighbours(spark, items, n):
    track = [(c, p - v, p + v, p, float(i)) for i, (c, p, v) in enumerate(items)]
    tdf = spark.createDataFrame(track, "chr string, start bigint, end bigint, mids bigint, sigVal double")
    points = [(c, p, s) for c in ("c1", "c2") for p in (0, 250, 499, 500, 501, 905) for s in (O.BEFORE, O.UP_TO)]
    pdf = spark.createDataFrame(points, "chr string, p bigint, side int")
    got = {
        (r.chr, r.p, r.side): ([e.sigVal for e in r.before or []], [e.sigVal for e in r.after or []])
        for r in O.locate(pdf, tdf, ["mids", "sigVal"], n).collect()
    }
    for c, p, s in points:
        ranked = sorted((m, st, en, v) for k, st, en, m, v in track if k == c)
        left = [r for r in ranked if r[0] < p or (s == O.UP_TO and r[0] == p)]
        assert got[c, p, s] == ([r[3] for r in left[-n:]], [r[3] for r in ranked[len(left):][:n]])


def test_overlap_pairs_nested_and_touching(spark):
    rnd = random.Random(5)
    a = [("c", i, s, s + rnd.choice([0, 3, 40, 700])) for i, s in enumerate(rnd.randrange(0, 600) for _ in range(60))]
    b = [("c", i, s, s + rnd.choice([0, 5, 60, 900])) for i, s in enumerate(rnd.randrange(0, 600) for _ in range(60))]
    left = spark.createDataFrame(a, "chr string, x int, a_start bigint, a_end bigint")
    right = spark.createDataFrame(b, "chr string, y int, b_start bigint, b_end bigint")
    closed = (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
    for merge in (True, False):
        got = rows(O.overlap_pairs(left, right, closed, narrowest=4, merge=merge).select("x", "y"))
        assert got == sorted((i, j) for _, i, s, e in a for _, j, t, f in b if s <= f and e >= t)


def test_overlap_pairs_of_all_lengths(spark):
    rnd = random.Random(8)
    def some(n):
        spans = [(s, s + int(10 ** rnd.uniform(0, 8.5))) for s in (rnd.randrange(0, 10**8) for _ in range(n))]
        return [("c", i, s, e) for i, (s, e) in enumerate([*spans, *spans[:5], (0, 10**9), (7, 7)])]
    a, b = some(120), some(90)
    left = spark.createDataFrame(a, "chr string, x int, a_start bigint, a_end bigint")
    right = spark.createDataFrame(b, "chr string, y int, b_start bigint, b_end bigint")
    half_open = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    got = rows(O.overlap_pairs(left, right, half_open).select("x", "y"))
    assert got == sorted((i, j) for _, i, s, e in a for _, j, t, f in b if s < f and e > t)
    assert O.overlap_pairs(left, right.limit(0), half_open).count() == 0


def test_overlap_pairs_of_a_pile_up(spark):
    """Equal intervals meet once, not once for each pair of copies; a long interval stands in two bins at most."""
    left = spark.range(3000).select(F.lit("c").alias("chr"), F.col("id").alias("x"), F.lit(1000).cast("long").alias("a_start"), F.lit(1500).cast("long").alias("a_end"))
    right = spark.range(1000).select(F.lit("c").alias("chr"), F.col("id").alias("y"), F.lit(1200).cast("long").alias("b_start"), F.lit(100_000_000).cast("long").alias("b_end"))
    pairs = O.overlap_pairs(left, right, F.col("a_start") <= F.col("b_end"))
    seen = {}
    original = type(left).join
    assert pairs.count() == 3_000_000
    def spy(self, other, *args, **kw):
        if "_b" in self.columns and "_b" in other.columns:
            seen["rows"] = (self.count(), other.count())
        return original(self, other, *args, **kw)
    type(left).join = spy
    try:
        O.overlap_pairs(left, right, F.col("a_start") <= F.col("b_end"))
    finally:
        type(left).join = original
    assert max(seen["rows"]) <= 4


@pytest.mark.parametrize("piece", [O.ONE_PIECE, 10])
def test_ordered_counts_and_quantiles(spark, monkeypatch, piece):
    monkeypatch.setattr(O, "ONE_PIECE", piece)
    rnd = random.Random(1)
    data = [("g", rnd.choice([1.5, 2.0, rnd.random() * 9])) for _ in range(300)] + [("h", 4.0)] + [("g", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    values = {k: np.array(sorted(v for q, v in data if q == k and v == v)) for k in "gh"}
    for r in O.ordered_counts(df, ["k"], "v", splits=8).collect():
        assert (r.below, r.cnt, r.n) == ((values[r.k] < r.v).sum(), (values[r.k] == r.v).sum(), len(values[r.k]))
    for r in O.exact_quantiles(df, ["k"], "v", {"a": 0.04, "m": 0.5, "z": 0.96}).collect():
        assert [r.a, r.m, r.z] == pytest.approx(list(np.percentile(values[r.k], [4, 50, 96])))
    whole = O.ordered_counts(df.filter("k = 'g'"), [], "v", splits=8)
    assert sum(r.cnt for r in whole.collect()) == len(values["g"])


def test_hash_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    one = O.hash_sample(df, ["id"], 777, (), 4)
    assert one.count() == 777
    expected = [r.id for r in df.orderBy(O.hash_order(["id"], 4)).limit(777).collect()]
    assert sorted(r.id for r in one.collect()) == sorted(expected)
    sizes = spark.createDataFrame([(0, 10), (1, 0), (2, 10_000)], "g bigint, size bigint")
    counts = Counter(r.g for r in O.hash_sample(df, ["id"], sizes, ["g"]).collect())
    assert counts == {0: 10, 2: 1666}


@pytest.mark.parametrize("limit", [O.BROADCAST_BYTES, 0])
def test_lookup_with_a_hot_key(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "BROADCAST_BYTES", limit)
    big = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500).alias("k"))
    small = spark.range(1400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = O.lookup(big, small, ["k"], ["v"])
    for r in got.collect():
        k = 7 if r.id % 3 == 0 else r.id % 1500
        assert (r.k, r.v) == (k, 2 * k if k < 1400 else None)
    assert got.count() == 9000


def test_a_table_of_few_values_is_measured_in_memory(spark):
    """Sorted and repeated values take next to nothing on disk, but a broadcast holds every row."""
    rows = O.cut_lineage(spark.range(1_000_000).select(F.lit("chr1").alias("chr"), F.floor(F.col("id") / 1000).alias("pos"), F.lit(True).alias("v")).coalesce(1))
    assert O.planned_bytes(rows) < 1 << 20
    assert not O.broadcastable(rows, 8 << 20)
    assert O.broadcastable(O.cut_lineage(rows.limit(1000)), 8 << 20)


def test_lookup_computes_the_large_table_once(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id").write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    small = spark.range(0, 3000, 2).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    monkeypatch.setattr(O, "BROADCAST_BYTES", 0)
    found = O.lookup(big, small, ["k"], ["v"])
    assert not [f for f in found.inputFiles() if f"{tmp_path}/big" in f]
    assert all(r["v"] == (r["k"] * 2 if r["k"] == 7 or r["k"] % 2 == 0 else None) for r in found.collect()) and found.count() == 3000
