"""Invariants of rearrangements and rules at region borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.operators import rearrange as R

CONTACTS = "chr string, contact_st bigint, contact_en bigint, contact_count double, dist bigint"
REGION = R.Region("c", 100, 150)


def contacts(spark, pairs):
    return spark.createDataFrame([("c", a, b, 1.0, b - a) for a, b in pairs] + [("d", 120, 300, 5.0, 180)], CONTACTS)


def pairs(df):
    return sorted((r.contact_st, r.contact_en) for r in df.filter("chr = 'c'").collect())


def test_deletion_and_back(spark):
    df = contacts(spark, [(50, 90), (100, 200), (110, 200), (50, 120), (150, 160), (50, 150)])
    gone = R.delete_contacts(df, REGION)
    # an end exactly on the region's start stays and moves with the rest
    assert pairs(gone) == [(50, 90), (50, 100), (50, 150), (100, 110)]
    assert [(r.contact_st, r.dist) for r in gone.filter("chr = 'd'").collect()] == [(120, 180)]
    outside = contacts(spark, [(50, 90), (150, 160), (50, 170)])
    back = R.lift_back_deletions(R.delete_contacts(outside, REGION), [REGION])
    assert pairs(back) == pairs(outside)


def test_duplication_adds_copies(spark):
    df = contacts(spark, [(50, 90), (110, 200), (160, 170)])
    assert pairs(R.duplicate_contacts(df, REGION)) == [(50, 90), (160, 250), (160, 250), (210, 220)]
    back = R.lift_back_duplications(R.duplicate_contacts(df, REGION), [REGION])
    assert {(r.contact_st, r.contact_en): r.contact_count for r in back.filter("chr = 'c'").collect()} == {(50, 90): 1.0, (110, 200): 2.0, (160, 170): 1.0}


TRACK = "chr string, start bigint, end bigint, mids bigint, sigVal double, plus_orientation double, minus_orientation double"


def test_peaks(spark):
    df = spark.createDataFrame([("c", s, e, (s + e) // 2, 1.0, 2.0, 0.0) for s, e in [(80, 90), (95, 105), (100, 150), (110, 120), (145, 160), (170, 180), (90, 160)]], TRACK)
    deleted = sorted((r.start, r.end) for r in R.delete_peaks(df, REGION).collect())
    assert deleted == [(40, 110), (80, 90), (95, 105), (95, 110), (120, 130)]
    assert sorted((r.start, r.end) for r in R.delete_peaks(df, REGION, 5).collect()) == [(40, 110), (80, 90), (120, 130)]
    doubled = sorted((r.start, r.end) for r in R.duplicate_peaks(df, REGION).collect())
    assert doubled == [(80, 90), (95, 105), (100, 150), (110, 120), (160, 170), (195, 210), (220, 230)]
    turned = {(r.start, r.end): (r.plus_orientation, r.minus_orientation) for r in R.invert_peaks(df, REGION).collect()}
    assert turned == {(80, 90): (2.0, 0.0), (100, 150): (0.0, 2.0), (130, 140): (0.0, 2.0), (170, 180): (2.0, 0.0)}


def test_genes(spark):
    rows = [("far", 100, 5_000, 1), ("promoter", 9_500, 30_000, 1), ("tail", 8_000, 10_500, 1), ("minus", 20_000, 12_500, -1), ("unknown", 10_200, 10_300, None), ("behind", 90_000, 95_000, 1)]
    df = spark.createDataFrame(
        [("c", min(s, e), max(s, e), (s + e) // 2, g, k) for g, s, e, k in rows],
        "chr string, start bigint, end bigint, mids bigint, gene string, strand_sign int",
    )
    got = {r.gene: r.start for r in R.delete_genes(df, R.Region("c", 10_000, 11_000)).collect()}
    # hit within 2 kb of its start side: dropped; further in: kept; behind the last overlapping gene: moved
    assert got == {"far": 100, "tail": 8_000, "minus": 11_500, "unknown": 10_200, "behind": 89_000}


def test_eigenvector_deletions_may_not_drift(spark):
    e1 = spark.createDataFrame([("c", i, float(i)) for i in range(10)], "chr string, bin bigint, E1 double")
    left, over = R.delete_eigenvector(e1, R.Region("c", 20, 45), 10)
    assert sorted((r.bin, r.E1) for r in left.collect()) == [(i, float(i if i < 2 else i + 2)) for i in range(8)] and over == 5
    with pytest.raises(ValueError):
        R.delete_eigenvector(e1, R.Region("c", 20, 29), 10, leftover=12)


def test_ectopic_scores_match_a_dense_computation(spark):
    rnd = np.random.default_rng(4)
    values = {(i, i + d): float(rnd.normal()) for d in (1, 2, 3) for i in range(60 if d < 3 else 9)}
    df = spark.createDataFrame([("c", i, j, v) for (i, j), v in values.items()], "chr string, contact_st bigint, contact_en bigint, difference double")
    got = {(r.contact_st, r.contact_en): r.z for r in R.ectopic_scores(df).collect()}
    for d in (1, 2):
        diagonal = np.array([v for (i, j), v in values.items() if j - i == d])
        lo, hi = np.percentile(diagonal, [4, 96])
        kept = diagonal[(diagonal > lo) & (diagonal < hi)]
        for (i, j), v in values.items():
            if j - i == d:
                assert got[i, j] == pytest.approx((v - kept.mean()) / kept.std())
    assert all(j - i != 3 for i, j in got)  # fewer than ten usable cells


def test_permutation_keeps_the_number_of_high_cells(spark):
    cells = [("c", i, i + 1, 3.0 if i % 4 == 0 else 0.0) for i in range(40)]
    df = spark.createDataFrame(cells, "chr string, contact_st bigint, contact_en bigint, z double")
    row = R.permutation_test(df, df).first()
    assert row.observed == 10 and 2 <= row.null_median <= 3 and row.z > 2


def test_permutation_null_equals_shuffling():
    rng = np.random.default_rng(3)
    for cells, hits, draws in ((40, 10, 10), (500, 40, 90), (7, 7, 3), (9, 0, 4), (300, 200, 250)):
        marks = np.zeros(cells)
        marks[:hits] = 1
        drawn = [rng.permutation(marks)[:draws].sum() for _ in range(4000)]
        median, deviation = R.hypergeometric(cells, hits, draws)
        assert abs(median - np.median(drawn)) <= 1 and deviation == pytest.approx(np.std(drawn), rel=0.1, abs=1e-9)


def test_scores_of_large_values(spark):
    """Values around 1e9 that vary by 1: squares of such doubles cancel, distances from the middle don't."""
    rnd = np.random.default_rng(5)
    values = 1e9 + rnd.normal(size=400)
    cells = spark.createDataFrame([("c", 5 * i, 5 * i + 10, float(v)) for i, v in enumerate(values)], "chr string, contact_st bigint, contact_en bigint, difference double")
    lo, hi = np.quantile(values, [0.04, 0.96])
    inner = values[(values > lo) & (values < hi)]
    got = {r.contact_st // 5: r.z for r in R.ectopic_scores(cells).collect()}
    assert len(got) == 400
    assert [got[i] for i in range(400)] == pytest.approx(list((values - inner.mean()) / inner.std()), rel=1e-5, abs=1e-6)


def test_aligned_cells_are_computed_once(spark, tmp_path):
    """The factor and the cells are read from a written table."""
    spark.createDataFrame([("c", 0, 10, 2.0), ("c", 10, 20, 4.0)], "chr string, contact_st long, contact_en long, contact_count double").write.parquet(str(tmp_path / "map"))
    cells = spark.read.parquet(str(tmp_path / "map"))
    found = R.depth_matched_difference(cells, cells.withColumn("contact_count", F.col("contact_count") * 3), R.Region("c", 100, 200))
    assert not [f for f in found.inputFiles() if f"{tmp_path}/map" in f]
    assert [r["difference"] for r in found.collect()] == [0.0, 0.0]
