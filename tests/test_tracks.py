"""Padding, boundary, orientation and loop rules on hand-made tracks."""

import pytest
from pyspark.sql import functions as F

from contactloom.operators import features as X
from contactloom.operators import tracks as T

TRACK = "chr string, start bigint, end bigint, mids bigint, sigVal double"


def track(spark, mids, chrom="c"):
    return spark.createDataFrame([(chrom, m - 1, m + 1, m, float(i + 1)) for i, m in enumerate(mids)], TRACK)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5])
def test_boundary_lists(spark, count):
    """N = 2: none, one, N, 2N-1, 2N and 2N+1 peaks in the window [100, 200]."""
    n, mids = 2, [100, 120, 130, 150, 200][:count]
    sig = {m: float(i + 2) for i, m in enumerate(mids)}  # the outside peak at 50 is the first of the track
    regions = spark.createDataFrame([("c", 100, 200, 1)], "chr string, start bigint, end bigint, id int")
    got = {}
    for r in X.boundary_peaks(track(spark, [50, *mids, 300]), regions, n).collect():
        got.setdefault(r.boundary, {})[r.idx] = (r.mids, r.sigVal)
    lists = {b: [v[i] for i in range(n)] for b, v in got.items()}
    item = [(m, sig[m]) for m in mids]
    if count == 0:
        want = [(100, 0.0)] * 2, [(200, 0.0)] * 2
    elif count == 1:
        want = [(100, 0.0)] * 2, [item[0], (mids[0], 0.0)]
    elif count >= 2 * n:
        want = item[:n], item[-n:]
    else:
        half = count // 2
        head, tail = item[:half], item[half:]
        want = head + [(head[-1][0], 0.0)] * (n - half), sorted(tail + [(tail[0][0], 0.0)] * (n - len(tail)))
    assert (lists["start"], lists["end"]) == want


def test_nearest_peaks_padding(spark):
    points = spark.createDataFrame([("c", 5), ("c", 20), ("c", 40)], "chr string, p bigint")
    got = {}
    for r in X.nearest_peaks(track(spark, [10, 20, 30]), points, 2).collect():
        got.setdefault((r.p, r.side), {})[r.idx] = (r.mids, r.sigVal)
    flat = {k: [v[0], v[1]] for k, v in got.items()}
    assert flat[5, "left"] == [(0, 0.0), (0, 0.0)]
    # an item at the point itself is on neither side; stand-ins come after the real items
    assert flat[20, "left"] == [(10, 1.0), (0, 0.0)]
    assert flat[20, "right"] == [(30, 3.0), (30, 0.0)]
    assert flat[40, "left"] == [(20, 2.0), (30, 3.0)]
    assert flat[40, "right"] == [(41, 0.0), (41, 0.0)]


def test_orientation_rules(spark):
    peaks = spark.createDataFrame(
        [("c", 0, 100, 50, 1.0), ("c", 200, 300, 250, 2.0), ("c", 400, 500, 450, 3.0), ("c", 600, 700, 650, 4.0)], TRACK
    )
    motifs = spark.createDataFrame(
        [("c", 10, 20, 9.0, "+"), ("c", 30, 40, 4.0, "+"), ("c", 100, 110, 7.0, "-"), ("c", 210, 220, 5.0, "+"), ("c", 230, 240, 5.0, "-"), ("c", 590, 600, 2.0, "-")],
        "chr string, start bigint, end bigint, score double, orientation string",
    )
    got = {r.start: (r.plus_orientation, r.minus_orientation) for r in T.orient_peaks(peaks, motifs).collect()}
    # lowest score wins; a motif starting at the peak's end meets it, one ending at its start does not
    assert got == {0: (4.0, 7.0), 200: (5.0, 5.0), 400: (0.0, 0.0), 600: (0.0, 0.0)}
    kept = T.keep_oriented(T.orient_peaks(peaks, motifs)).collect()
    assert [(r.start, r.plus_orientation, r.minus_orientation) for r in kept] == [(0, 0.0, 7.0)]


def test_touching_intervals(spark):
    a = spark.createDataFrame([("c", 0, 10)], "chr string, start bigint, end bigint")
    b = spark.createDataFrame([("c", 10, 20), ("c", -5, 0), ("c", 11, 12)], "chr string, start bigint, end bigint")
    assert [r.b_start for r in T.intersect(a, b).collect()] == [10]
    assert sorted(r.b_start for r in T.stab(a, b).collect()) == [-5, 10]


def test_nested_intervals(spark):
    df = spark.createDataFrame([("c", 0, 100), ("c", 10, 50), ("c", 10, 50), ("c", 20, 60), ("c", 70, 80), ("d", 1, 2)], "chr string, start bigint, end bigint")
    assert {r.chr: r.nested for r in T.nested_intervals(df).collect()} == {"c": 1, "d": 0}


def test_binned_sums_double_count_inner_edges(spark):
    regions = spark.createDataFrame([("c", 0, 30, 1)], "chr string, start bigint, end bigint, id int")
    got = {r.bin: r.sigVal for r in T.binned_sums(track(spark, [0, 10, 25, 30]), regions, 10).collect()}
    assert got == {0: 3.0, 1: 2.0, 2: 7.0}


def test_loop_needs_both_anchors_of_the_same_loop(spark):
    loops = spark.createDataFrame([(1, "c", 100, 110, 500, 510), (2, "c", 900, 910, 990, 999)], "id int, chr string, x1 bigint, x2 bigint, y1 bigint, y2 bigint")
    contacts = spark.createDataFrame([("c", 105, 505), ("c", 105, 995), ("c", 120, 520), ("d", 105, 505)], "chr string, contact_st bigint, contact_en bigint")
    got = {(r.chr, r.contact_st, r.contact_en): r.IsLoop for r in T.flag_loops(contacts, loops, 10, 64).collect()}
    assert got == {("c", 105, 505): 1, ("c", 105, 995): 0, ("c", 120, 520): 1, ("d", 105, 505): 0}


def test_eigenvector_past_the_end(spark):
    e1 = spark.createDataFrame([("c", i, float(i + 1)) for i in range(3)], "chr string, bin bigint, E1 double")
    regions = spark.createDataFrame([("c", 10, 40, 1), ("c", 25, 29, 2), ("c", 31, 50, 3)], "chr string, start bigint, end bigint, id int")
    got = {(r.id, r.k): r.E1 for r in T.eigenvector_windows(regions, e1, 10).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 3.0, (1, 2): 0.0, (2, 0): 3.0}
    assert [r.id for r in T.eigenvector_violations(regions, e1, 10).collect()] == [3]


def test_bins_of_few_long_regions_are_not_broadcast(spark):
    """The planner takes a table of regions for small, whatever number of bins they are cut into."""
    track = spark.range(20).select(F.lit("c").alias("chr"), (F.col("id") * 1000).alias("mids"), F.lit(1.0).alias("sigVal"))
    regions = spark.range(3).select(F.lit("c").alias("chr"), (F.col("id") * 100).alias("start"), F.lit(2_000_000).cast("long").alias("end"), "id")
    sums = T.binned_sums(track, regions, 100)
    top = next(line for line in sums._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line)
    assert "SortMergeJoin" in top
    assert sums.groupBy("id").agg(F.sum("sigVal").alias("s")).count() == 3
