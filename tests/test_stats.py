"""Sparse measures against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.functions import weights as G
from contactloom.operators import differential as D
from contactloom.operators import model as M
from contactloom.operators import stats as V

B = 100_000  # 15 bins reach


@pytest.fixture(scope="module")
def maps(spark):
    rnd = np.random.default_rng(7)
    size = 40
    rows = [
        ("c", int(i) * B, int(j) * B, float(rnd.integers(0, 9)), float(rnd.integers(0, 9)))
        for i in range(2, size)
        for j in range(i, min(size, i + 20))
        if rnd.random() < 0.5
    ]
    df = spark.createDataFrame(rows, "chr string, contact_st bigint, contact_en bigint, contact_count double, predicted double")
    L = max(r[2] for r in rows) // B + 1
    real, pred = np.zeros((L, L)), np.zeros((L, L))
    for _, s, e, a, b in rows:
        i, j = s // B, e // B
        if 2 < j - i < 15:
            real[i, j] = real[j, i] = a
            pred[i, j] = pred[j, i] = b
    return df, real, pred, min(r[1] for r in rows) // B


def smoothed(m, h):
    L = len(m)
    out = np.zeros_like(m)
    for i in range(L):
        for j in range(L):
            if 2 + h < abs(i - j) < 15 - h:
                out[i, j] = m[max(i - h, 0):i + h + 1, max(j - h, 0):j + h + 1].mean()
    return out


@pytest.mark.parametrize("h", [1, 2, 4])
def test_smoothing(maps, h):
    df, real, pred, _ = maps
    got = {(r.i, r.j): (r.real, r.pred) for r in V.smooth(df, B, h).collect()}
    a, b = smoothed(real, h), smoothed(pred, h)
    for i in range(len(a)):
        for j in range(i, len(a)):
            assert got.get((i, j), (0, 0)) == pytest.approx((a[i, j], b[i, j]))


def test_scc_and_errors(maps):
    df, real, pred, lo = maps
    a, b = smoothed(real, 1), smoothed(pred, 1)
    L = len(a)
    num = den = 0.0
    for d in range(1, L - 1 - lo - 2 + 1):
        cells = [(a[i, j], b[i, j]) for i in range(L) for j in range(L) if abs(i - j) == d and (a[i, j] or b[i, j])]
        x, y = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
        if len(set(x)) > 1 and len(set(y)) > 1:
            num += np.corrcoef(x, y)[0, 1] * (len(cells) + 1) / 12
            den += (len(cells) + 1) / 12
    assert V.scc(df, B, 1).first().scc == pytest.approx(num / den)
    mx = L - 1
    cells = [(r, c) for r in range(1, L + 1) for c in range(1, L + 1) if 2 < abs(r - c) <= 15]
    k = sum(1 for r, c in cells if lo < r < mx and lo < c < mx)
    diff = [abs(real[r - 1, c - 1] - pred[r - 1, c - 1]) for r, c in cells]
    row = V.band_errors(df, B).first()
    assert row.rmse == pytest.approx(np.sqrt(sum(x * x for x in diff) / k)) and row.mae == pytest.approx(sum(diff) / k)
    rows = [np.corrcoef(real[t], pred[t])[0, 1] for t in range(L) if real[t].std() > 0 and pred[t].std() > 0]
    assert V.mean_row_correlation(df, B).first()["corr"] == pytest.approx(np.mean(rows))


def test_scc_of_a_map_with_itself_is_one(maps):
    df, *_ = maps
    assert V.scc(df.withColumn("predicted", F.col("contact_count")), B, 2).first().scc == pytest.approx(1.0)


def test_downsampling_keeps_the_depth(spark):
    cells = spark.createDataFrame([("c", 0, 5, 1.0), ("c", 0, 10, 3.0), ("d", 0, 5, 6.0)], "chr string, contact_st bigint, contact_en bigint, contact_count double")
    got = {(r.chr, r.contact_en): r.contact_count for r in V.downsample(cells, 20_000).collect()}
    assert sum(got.values()) == 20_000
    assert got["d", 5] == pytest.approx(12_000, rel=0.03) and got["c", 5] == pytest.approx(2_000, rel=0.1)


def test_tracks_match_the_region_lists(spark):
    rnd = np.random.default_rng(3)
    def table():
        return {(int(i), int(j)): float(rnd.integers(0, 6)) for i in range(12) for j in range(i, min(12, i + 5)) if rnd.random() < 0.6}
    a, b = table(), table()
    da, db = (spark.createDataFrame([("c", i, j, v) for (i, j), v in t.items()], "chr string, i bigint, j bigint, value double") for t in (a, b))

    def metric(region):
        d = [abs(np.log2(a[k]) - np.log2(b[k])) for k in (tuple(sorted(p)) for p in region) if a.get(k, 0) > 0 and b.get(k, 0) > 0]
        return round(sum(d) / len(d), 5) if d else 0

    frame, high = 2, 3
    for r in D.triangle_track(da, db, frame, 1).collect():
        k = r.start
        assert r.metric == pytest.approx(metric([(i, j) for i in range(k - frame, k + frame + 1) for j in range(i, k + frame + 1)]), abs=1e-5)
    for r in D.strip_track(da, db, frame, high, 1).collect():
        k = r.start
        back = [(i, j) for i in range(k - frame, k + 1) for j in range(i - high, i + 1)]
        ahead = [(i, j) for i in range(k, k + frame + 1) for j in range(i, i + high + 1)]
        assert r.metric == pytest.approx(metric(back + ahead), abs=1e-5)


def test_mann_whitney_counts_pairs(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 0.5]
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "comparison string, delta double")
    row = D.mann_whitney(df, [("x", "y")]).first()
    assert row.u == sum((a > b) + 0.5 * (a == b) for a in x for b in y) and (row.n_x, row.n_y) == (4, 3)


def test_promoter_enhancer_band(spark):
    p = spark.createDataFrame([("c", v) for v in (0, 5, 50, 50)] + [("longname", 1)], "chr string, bin bigint")
    e = spark.createDataFrame([("c", v) for v in (2, 3, 14, 45)] + [("longname", 9)], "chr string, bin bigint")
    got = sorted((r.i, r.j) for r in D.promoter_enhancer_pairs(p, e, 10).collect())
    assert got == [(0, 3), (2, 5), (5, 14), (45, 50)]


def test_threshold_weights(spark):
    df = spark.createDataFrame([(0.25,), (1.5,), (8.0,)], "c double")
    got = df.select(G.threshold_weight(F.col("c"), 2, 1, 1).alias("a"), G.threshold_weight(F.col("c"), 2, 1, 1, asymmetric=1).alias("b"), G.threshold_weight(F.col("c"), 1).alias("o")).collect()
    assert [tuple(r) for r in got] == [(-2.0, 1.0, 1.0), (1.0, 1.0, 1.0), (3.0, 3.0, 1.0)]


def test_model_refuses_shared_chromosomes(spark):
    rows = [(f"c{i % 3}", i, i + 60, 60 + i % 7, 1.0 + (i % 7) * 3, float(i % 7)) for i in range(300)]
    table = spark.createDataFrame(rows, "chr string, contact_st bigint, contact_en bigint, contact_dist bigint, contact_count double, x double")
    trained = M.train(table.filter("chr <> 'c2'"), algorithm=M.default_trees(5, 3))
    scored = M.predict(trained, table.filter("chr = 'c2'"))
    assert V.r_squared(scored).first().r2 > 0.9
    top = M.feature_importance(trained, spark).first()
    assert top.importance > 0.3
    with pytest.raises(ValueError):
        M.validate(trained, table)


def test_downsample_keeps_small_counts(spark):
    cells = spark.createDataFrame([("c", i, i, 1 / 2585 if i else 3 / 2585) for i in range(50)], "chr string, contact_st bigint, contact_en bigint, contact_count double")
    drawn = {r.contact_st: r.contact_count for r in V.downsample(cells, 20_000).collect()}
    assert sum(drawn.values()) == 20_000 and len(drawn) == 50
    assert drawn[0] > 2 * max(v for k, v in drawn.items() if k)


def test_totals_of_small_and_bad_values(spark):
    runs = spark.createDataFrame([("c", 0, 10, 1e-7), ("c", 10, 20, 2e-7), ("c", 20, 30, float("nan"))], "chr string, start bigint, end bigint, value double")
    assert [float(r.total) for r in V.signal_bins(runs, 100).collect()] == pytest.approx([3e-6])
    with pytest.raises(Exception, match="infinite"):
        V.signal_bins(runs.withColumn("value", F.lit(float("inf"))), 100).collect()


def test_downsample_of_counts_over_eighteen_orders(spark):
    schema = "chr string, contact_st bigint, contact_en bigint, contact_count double"
    for counts in ([1e-6, 1e6, 1e6], [1e-9, 1e9, 1e9, 1e-9], [1e-300, 1e300, 1e300]):
        # next to each other, then on chromosomes of their own
        for at in (lambda i: ("c", 5 * i), lambda i: (f"c{i}", 10**6 * i)):
            cells = spark.createDataFrame([(at(i)[0], at(i)[1], at(i)[1] + 5, v) for i, v in enumerate(counts)], schema)
            drawn = {(r.chr, r.contact_st): r.contact_count for r in V.downsample(cells, 10_000).collect()}
            assert sum(drawn.values()) == 10_000
            assert set(drawn) == {at(i) for i, v in enumerate(counts) if v >= 1e6}
            assert all(v == pytest.approx(5_000, rel=0.05) for v in drawn.values())
    odd = spark.createDataFrame([("c", 0, 1, float("nan")), ("c", 1, 2, 0.0), ("c", 2, 3, -1.0), ("c", 3, 4, None)], schema)
    assert V.downsample(odd, 100).collect() == [] == V.downsample(odd.limit(0), 100).collect()
    assert sum(r.contact_count for r in V.downsample(odd.fillna(2.0), 100).collect()) == 100
    with pytest.raises(Exception, match="infinite"):
        V.downsample(odd.fillna(float("inf")), 5).collect()


def test_smoothing_search_draws_by_ranges_of_one_hash(spark):
    rnd = np.random.default_rng(6)
    rows = [("c", 5000 * i, 5000 * (i + d), float(rnd.integers(1, 50))) for i in range(150) for d in range(3, 40)]
    same = spark.createDataFrame(rows, "chr string, contact_st bigint, contact_en bigint, contact_count double").withColumn("predicted", F.col("contact_count") * 2)
    got = V.smoothing_search(same, 5000).collect()
    assert [(r.h, r.mean_scc, r.stop) for r in got] == [(0, 1.0, False), (1, 1.0, True)]
    # more rounds than fit next to each other start over
    noisy = same.withColumn("predicted", F.col("contact_count") + F.pmod(F.xxhash64("contact_st", "contact_en"), F.lit(60)))
    few, many = (V.smoothing_search(noisy, 5000, largest=0, rounds=n, share=0.4).first().mean_scc for n in (2, 10))
    assert 0 < few < 1 and few == pytest.approx(many, abs=0.05)


def test_smoothing_shuffles_a_cell_about_once(spark, monkeypatch):
    """Cells are dealt to tiles, not copied for each cell of a square; across tile borders they are summed as within."""
    monkeypatch.setattr(V, "TILE", 8)
    rnd = np.random.default_rng(3)
    rows = [("c", i * B, j * B, float(rnd.integers(1, 9)), float(rnd.random())) for i in range(60) for j in range(i, min(60, i + 25)) if rnd.random() < 0.3]
    df = spark.createDataFrame(rows, "chr string, contact_st bigint, contact_en bigint, contact_count double, predicted double")
    narrow = {(r.i, r.j): (r.real, r.pred) for r in V.smooth(df, B, 3).collect()}
    monkeypatch.setattr(V, "TILE", 256)
    made = V.smooth(df, B, 3)
    wide = {(r.i, r.j): (r.real, r.pred) for r in made.collect()}
    assert narrow.keys() == wide.keys() and all(narrow[k] == pytest.approx(wide[k]) for k in wide)


def test_promoter_enhancer_pairs_are_counted_not_formed(spark, maps, monkeypatch):
    """Bins that are both, copies, bins outside the matrix and cells that are not stored."""
    df, real, pred, lo = maps
    rnd = np.random.default_rng(5)
    p, e = [rnd.integers(0, 45, 30).tolist() for _ in range(2)]
    table = lambda bins: spark.createDataFrame([("c", int(b) * B + 5) for b in bins] + [("none", 7)], "chr string, position bigint")
    monkeypatch.setattr(V, "paired_bins", None)
    got = V.paired_errors(df, table(p), table(e), B).collect()
    hi = len(real) - 1
    pairs = [(i, j) for i in range(lo, hi - 1) for j in range(i + 3, min(i + 15, hi - 1)) if (i in p and j in e) or (i in e and j in p)]
    d = np.array([real[c] - pred[c] for c in pairs])
    some = sum(1 for c in pairs if real[c] or pred[c])
    assert [r.chr for r in got] == ["c"]
    assert got[0].pe_rmse == pytest.approx(np.sqrt((d**2).sum() / len(pairs)))
    assert got[0].pe_mae == pytest.approx(np.abs(d).sum() / some)
