"""Feature families against a plain rewriting of their definitions, with ties, copies and a chromosome without items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.operators import features as X

W, H = 20, 10


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(11)
    contacts = [(c, s, s + d, d, 1.0) for c in ("c1", "c2", "c3") for s in range(0, 300, 10) for d in (30, 40, 90)]
    peaks = []
    for c, n in (("c1", 40), ("c2", 2)):
        for _ in range(n):
            m = rnd.randrange(0, 380)
            w = rnd.randrange(1, 9)
            plus = rnd.choice([0, rnd.randrange(1, 50)])
            peaks.append((c, m - w, m + w, m, float(rnd.randrange(1, 99)), float(plus), float(0 if plus else rnd.randrange(1, 50))))
    peaks += [("c1", 148, 152, 150, 5.0, 3.0, 0.0)] * 20 + [("c1", 148, 152, 150, 5.0, 0.0, 4.0)] * 2
    cdf = spark.createDataFrame(contacts, "chr string, contact_st bigint, contact_en bigint, dist bigint, contact_count double")
    pdf = spark.createDataFrame(peaks, "chr string, start bigint, end bigint, mids bigint, sigVal double, plus_orientation double, minus_orientation double")
    return contacts, peaks, cdf, pdf


def by_key(df):
    return {(r["chr"], r["contact_st"], r["contact_en"]): r for r in df.collect()}


def test_peak_sums(spark, world):
    contacts, peaks, cdf, pdf = world
    got = by_key(X.compute(cdf, [X.PeakSums(pdf, "T", W, 2)]))
    assert len(got) == len(contacts)
    for c, s, e, *_ in contacts:
        own = sorted(p for p in peaks if p[0] == c)
        own.sort(key=lambda p: (p[3], p[1], p[2], p[4]))
        r = got[c, s, e]

        def total(a, b):
            return sum(p[4] for p in own if a <= p[3] <= b)

        assert (r["T_L"], r["T_W"], r["T_R"]) == (total(s - H, s + H), total(s + H, e - H), total(e - H, e + H))
        if not own:
            assert [r[f"T_LDist_{i}"] for i in range(2)] == [0, 0] and [r[f"T_RDist_{i}"] for i in range(2)] == [0, 0]
            continue
        left = [p for p in own if p[3] < s - H][-2:]
        right = [p for p in own if p[3] > e + H][:2]
        pad = right[-1][3] if right else e + H + 1
        assert [r[f"T_LDist_{i}"] for i in range(2)] == [s - p[3] for p in left] + [s] * (2 - len(left))
        assert [r[f"T_RDist_{i}"] for i in range(2)] == [p[3] - e for p in right] + [pad - e] * (2 - len(right))
        assert [r[f"T_LSig_{i}"] for i in range(2)] == [p[4] for p in left] + [0.0] * (2 - len(left))


def test_gene_sums_count_every_touched_window(spark, world):
    contacts, peaks, cdf, pdf = world
    got = by_key(X.compute(cdf, [X.GeneSums(pdf, "G", W, 1)]))
    for c, s, e, *_ in contacts:
        def total(a, b):
            return sum(p[4] for p in peaks if p[0] == c and p[1] <= b and p[2] >= a)

        assert (got[c, s, e]["G_L"], got[c, s, e]["G_W"], got[c, s, e]["G_R"]) == (total(s - H, s + H), total(s + H, e - H), total(e - H, e + H))


def test_orientation_blocks(spark, world):
    contacts, peaks, cdf, pdf = world
    got = by_key(X.compute(cdf, [X.OrientationBlocks(pdf, "T", W)]))
    for c, s, e, *_ in contacts:
        # sites of equal coordinates are taken plus first
        own = sorted((p for p in peaks if p[0] == c), key=lambda p: (p[3], p[1], p[2], p[5] == 0))
        inside = [p for p in own if s + H <= p[3] <= e - H]
        blocks = sum(1 for a, b in zip(inside, inside[1:]) if a[5] != 0 and b[6] != 0)
        plus = sum(p[5] for p in own if s - H <= p[3] <= s + H)
        minus = sum(p[6] for p in own if e - H <= p[3] <= e + H)
        assert (got[c, s, e]["T_OrientBlock_W_NBlocks"], got[c, s, e]["T_OrientBlock_HasDivergOrient"]) == (blocks, plus * minus)


def test_eigenvector_summary(spark, world):
    contacts, _, cdf, _ = world
    rnd = random.Random(2)
    values = {c: [float(rnd.randrange(-3, 4)) for _ in range(25)] for c in ("c1", "c2", "c3")}
    e1 = spark.createDataFrame([(c, i, v) for c, vs in values.items() for i, v in enumerate(vs)], "chr string, bin bigint, E1 double")
    got = by_key(X.compute(cdf, [X.EigenvectorSummary(e1, W, 10)]))
    for c, s, e, *_ in contacts:
        def window(a, b):
            first, count = a // 10, max((b - a) // 10, 1)
            return [values[c][i] if 0 <= i < 25 else 0.0 for i in range(first, first + count)]

        m = window(s + H, e - H)
        flips = sum(1 for a, b in zip(m, m[1:]) if np.sign(a) != np.sign(b))
        r = got[c, s, e]
        assert r["E1_L"] == pytest.approx(np.mean(window(s - H, s + H)))
        assert r["E1_R"] == pytest.approx(np.mean(window(e - H, e + H)))
        assert (r["E1_N_Changes"], r["E1_SD"]) == (flips, pytest.approx(np.std(m), abs=1e-9))


def test_both_join_strategies_agree(spark, world):
    _, _, cdf, pdf = world
    family = X.SiteOrientation(pdf, "T", 2)
    rows = X.cut_lineage(X.contact_anchors(cdf).join(family.anchor_rows(X.contact_anchors(cdf).select("chr", "pos")), ["chr", "pos"]))
    small = X.attach_anchors(cdf, rows, [family.slot])
    spread = X.attach_anchors(cdf, rows, [family.slot], share=20, broadcast_bytes=0)
    assert small.exceptAll(spread).count() == 0 and spread.exceptAll(small).count() == 0


def test_contacts_are_shuffled_once_while_they_are_narrow(spark, world, monkeypatch):
    _, _, cdf, pdf = world
    family = X.SiteOrientation(pdf, "T", 2)
    rows = X.cut_lineage(X.contact_anchors(cdf).join(family.anchor_rows(X.contact_anchors(cdf).select("chr", "pos")), ["chr", "pos"]))
    small = X.attach_anchors(cdf, rows, [family.slot])
    monkeypatch.setattr(X, "STRETCH", 16)
    monkeypatch.setattr(X, "PIECE", 3)
    once = X.attach_anchors(cdf, rows, [family.slot], broadcast_bytes=0)
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(X, "REACH", 0)
    by_end = X.attach_anchors(cdf, rows, [family.slot], share=20, broadcast_bytes=0)
    for other in (once, by_end):
        assert small.exceptAll(other).count() == 0 and other.exceptAll(small).count() == 0


def test_names_must_be_unique(spark, world):
    _, _, cdf, pdf = world
    with pytest.raises(ValueError):
        X.compute(cdf, [X.PeakSums(pdf, "T", W), X.PeakSums(pdf, "T", W)])


def test_assembled_header(spark, world):
    _, _, cdf, pdf = world
    table = X.assemble(cdf, [X.PeakSums(pdf, "T", W, 1)])
    assert table.columns == ["chr", "contact_st", "contact_en", "contact_dist", "contact_count", "T_L", "T_W", "T_R", "T_LSig_0", "T_LDist_0", "T_RSig_0", "T_RDist_0"]


def test_anchor_rows_are_grouped_where_they_were_found(spark, world):
    """Points are shuffled once, by bucket; the answers of an anchor are put together in that task."""
    _, _, cdf, pdf = world
    anchors = X.cut_lineage(X.contact_anchors(cdf).select("chr", "pos"))
    genes = pdf.withColumn("TSS", F.col("mids"))
    for family in (X.PeakSums(pdf, "T", W, 2), X.GeneSums(pdf, "G", W, 2), X.SiteOrientation(pdf, "S", 2), X.ConvergentPair(pdf, "C", W), X.DistanceToTss(genes)):
        plan = family.anchor_rows(anchors)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Window")]
        assert "Exchange" not in above and "Union" not in above


def test_contacts_take_from_an_anchor_only_what_its_end_needs(spark, world):
    _, _, cdf, pdf = world
    family = X.PeakSums(pdf, "T", W, 2)
    anchors = X.contact_anchors(cdf)
    rows = X.cut_lineage(anchors.join(family.anchor_rows(anchors.select("chr", "pos")), ["chr", "pos"]))
    joined = X.attach_anchors(cdf, rows, [family.slot], taken=lambda slot, end: family.taken(end))
    assert [f.name for f in joined.schema["st_" + family.slot].dataType] == list(family.at_start)
    assert [f.name for f in joined.schema["en_" + family.slot].dataType] == list(family.at_end)


@pytest.mark.parametrize("some", ["sums", "sites", "rest", "crowded"])
def test_anchors_surveyed_in_stretches_give_the_same_features(spark, world, monkeypatch, some):
    """Contacts, anchors and items meet in stretches; what is found for an anchor is joined there, not shuffled."""
    _, _, cdf, pdf = world
    odd = [(None, 50, 80, 30, 1.0), ("c1", None, 80, 30, 1.0), ("c2", 40, None, 30, 1.0)]
    # sites between ends that are missing are an error on either way
    cdf = cdf.filter("contact_st < 120 or chr = 'c2'").unionByName(spark.createDataFrame(odd if some != "sites" else [], cdf.schema)).coalesce(1)
    tracks = pdf.withColumn("track", F.when(F.col("mids") % 3 == 0, "a").otherwise("b"))
    e1 = spark.createDataFrame([(c, i, float((i * 7) % 5 - 2)) for c in ("c1", "c2") for i in range(25)], "chr string, bin bigint, E1 double")
    families = {
        "sums": [X.PeakSums(pdf, "T", W, 2), X.TrackSums(tracks, ["b", "a", "none"], W, 2)],
        "sites": [X.GeneSums(pdf, "G", W, 2), X.SiteOrientation(pdf, "S", 2), X.ConvergentPair(pdf, "C", 3)],
        "rest": [X.OrientationBlocks(pdf, "B", W), X.DistanceToTss(pdf.withColumn("TSS", F.col("mids") + 1)), X.EigenvectorSummary(e1, W, 10)],
        "crowded": [X.PeakSums(pdf, "T", W, 2)],
    }[some]
    looked_up = X.compute(cdf, families)
    monkeypatch.setattr(X, "HELD", 0)
    monkeypatch.setattr(X, "STRETCH", 64)
    monkeypatch.setattr(X, "SHARE", 100)
    monkeypatch.setattr(X, "PIECE", 10 if some == "crowded" else 1 << 18)
    met = X.compute(cdf, families)
    assert met.columns == looked_up.columns
    assert sorted(map(repr, met.collect())) == sorted(map(repr, looked_up.collect()))
    if some == "sums":
        assert "ShuffledHashJoin" in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1 << 18, 20])
def test_peak_bins_are_summed_in_stretches(spark, world, monkeypatch, piece):
    contacts, peaks, cdf, pdf = world
    monkeypatch.setattr(X, "STRETCH", 64)
    monkeypatch.setattr(X, "SHARE", 40)
    monkeypatch.setattr(X, "PIECE", piece)
    table = X.compute(cdf, [X.PeakBins(pdf, "T", 120, 20)])
    got = by_key(table)
    assert len(got) == len(contacts)
    for c, s, e, d, _ in contacts:
        st = max(0, s - (120 - d) // 2)
        r = got[c, s, e]
        assert r["Twin_st"] == st
        for i in range(6):
            lo = st + i * 20
            assert r[f"T_bin{i}"] == sum(p[4] for p in peaks if p[0] == c and lo <= p[3] <= lo + 20)
    if piece > 20:
        # neither contacts nor windows are looked up: their bins never leave the task that summed them
        assert "_salt" not in table._jdf.queryExecution().optimizedPlan().toString()
