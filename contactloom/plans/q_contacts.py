"""Queries: contact filters, grids and matrix joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.operators import contacts as C
from contactloom.plans import adapters as A
from contactloom.plans.registry import query


@query(
    "c01_get_contacts",
    """SELECT chr, contact_st, contact_en, contact_count, dist FROM a_contacts
    WHERE chr = 'chr2' AND contact_st >= 1000000 AND contact_st < 6000000 AND contact_en > 1000000
      AND contact_en <= 6000000 AND dist BETWEEN 25001 AND 295000""",
)
def c01(spark, sf):
    return C.get_contacts(A.contacts(spark, sf), "chr2", 1_000_000, 6_000_000, A.MIN_DIST, A.MAX_DIST)


def _wanted(spark, sf):
    loops = A.loops(spark, sf)
    odd = F.when(F.col("id") % 7 == 0, 2500).otherwise(0)
    return loops.select("id", "chr", F.col("x1").alias("start"), (F.col("x1") + (F.col("id") % 70) * 5000 + odd).alias("end"))


@query(
    "c02_find_contacts",
    """SELECT w.id, w.chr, w.start, w."end", w.valid, CASE WHEN w.valid THEN c.contact_count END AS contact_count FROM
    (SELECT id, chr, x1 AS start, x1 + (id % 70) * 5000 + CASE WHEN id % 7 = 0 THEN 2500 ELSE 0 END AS "end",
      (x1 + (id % 70) * 5000 + CASE WHEN id % 7 = 0 THEN 2500 ELSE 0 END) % 5000 = 0
      AND (id % 70) * 5000 + CASE WHEN id % 7 = 0 THEN 2500 ELSE 0 END < 295000 AS valid FROM a_loops) w
    LEFT JOIN a_contacts c ON c.chr = w.chr AND c.contact_st = w.start AND c.contact_en = w."end" """,
)
def c02(spark, sf):
    return C.find_contacts(A.contacts(spark, sf), _wanted(spark, sf), A.BIN, A.MAX_DIST).select(
        "id", "chr", "start", "end", "valid", "contact_count"
    )


@query(
    "c03_position_range",
    """SELECT chr, MIN(contact_st) AS min_position, MAX(contact_en) AS max_position, COUNT(*) AS n_contacts
    FROM a_contacts GROUP BY chr""",
)
def c03(spark, sf):
    return C.position_range(A.contacts(spark, sf))


@query(
    "c04_drop_nan",
    "SELECT chr, contact_st, contact_en, contact_count, dist FROM a_contacts WHERE contact_count % 5 <> 0",
)
def c04(spark, sf):
    count = F.col("contact_count")
    holes = F.when(count % 5 == 0, F.when(count % 10 == 0, F.lit(None)).otherwise(F.lit(float("nan")))).otherwise(count)
    return C.drop_nan(A.contacts(spark, sf).withColumn("contact_count", holes))


@query("c05_select_predictors", "SELECT chr, contact_st, contact_en, dist, predicted FROM a_pred")
def c05(spark, sf):
    table = A.predictions(spark, sf)
    return table.select("chr", "contact_st", "contact_en", *C.select_predictors(table, "^(dist|pred)", keep=True))


@query("c05_discard_predictors", "SELECT chr, contact_st, contact_en, predicted FROM a_pred")
def c05_discard(spark, sf):
    table = A.predictions(spark, sf)
    return table.select("chr", "contact_st", "contact_en", *C.select_predictors(table, "dist", keep=False))


@query(
    "c06_bin_size",
    """SELECT MIN(d) AS bin_size FROM (SELECT contact_en - contact_st AS d FROM a_contacts UNION ALL
    SELECT contact_st - LAG(contact_st) OVER (PARTITION BY chr ORDER BY contact_st)
      FROM (SELECT DISTINCT chr, contact_st FROM a_contacts)) WHERE d > 0""",
)
def c06(spark, sf):
    return C.bin_size(A.contacts(spark, sf))


@query("c07_drop_chr_prefix", "SELECT replace(chr, 'chr', '') AS chr, start, \"end\", gene FROM a_genes")
def c07(spark, sf):
    return C.drop_chr_prefix(A.genes(spark, sf)).select("chr", "start", "end", "gene")


@query("c07_add_chr_prefix", 'SELECT chr, start, "end", gene FROM a_genes')
def c07_add(spark, sf):
    return C.add_chr_prefix(C.drop_chr_prefix(A.genes(spark, sf))).select("chr", "start", "end", "gene")


@query(
    "c08_to_bins",
    """SELECT chr, start, "end", CAST(floor((start - 12345) / 5000) AS BIGINT) AS start_bin,
    CAST(floor(("end" - 12345) / 5000) AS BIGINT) AS end_bin FROM a_genes""",
)
def c08(spark, sf):
    return C.to_bins(A.genes(spark, sf).select("chr", "start", "end"), A.BIN, 12_345, ("start", "end"))


@query(
    "j01_fill_empty_contacts",
    """WITH b AS (SELECT chr, MIN(contact_st) AS lo, MAX(contact_en) AS hi FROM a_contacts GROUP BY chr),
    g AS (SELECT chr, hi, UNNEST(range(lo, hi + 1, 5000)) AS i FROM b),
    p AS (SELECT chr, i, UNNEST(range(i + 15000, LEAST(hi, i + 60000) + 1, 5000)) AS j FROM g)
    SELECT p.chr, i AS contact_st, j AS contact_en, COALESCE(contact_count, 0) AS contact_count, j - i AS dist
    FROM p LEFT JOIN a_contacts c ON c.chr = p.chr AND c.contact_st = i AND c.contact_en = j""",
)
def j01(spark, sf):
    return C.fill_empty(A.contacts(spark, sf), A.BIN, 60_000)


@query(
    "j02_region_contacts",
    """WITH g AS (SELECT id, chr, y2 // 5000 * 5000 AS hi, UNNEST(range((x1 - 1200 + 2500) // 5000 * 5000, y2 // 5000 * 5000 + 1, 5000)) AS st FROM a_loops)
    SELECT chr, id, st AS contact_st, en AS contact_en, CAST(1 AS DOUBLE) AS contact_count, en - st AS dist FROM
    (SELECT chr, id, st, UNNEST(range(st + 10000, LEAST(hi, st + 60000) + 1, 5000)) AS en FROM g)""",
)
def j02(spark, sf):
    regions = A.loops(spark, sf).select("chr", "id", (F.col("x1") + 1300).alias("start"), F.col("y2").alias("end"))
    return C.region_contacts(regions, A.BIN, 10_000, 60_000)


_NEAR = """near_bins AS (SELECT DISTINCT chr, b + d AS pos FROM (SELECT DISTINCT chr, (x1 + x2) // 2 // 5000 * 5000 AS b FROM a_loops), (VALUES (-5000), (0), (5000)) t(d)),
    flagged AS (SELECT c.*, s.pos IS NOT NULL AND e.pos IS NOT NULL AS with_track FROM a_contacts c
    LEFT JOIN near_bins s ON s.chr = c.chr AND s.pos = c.contact_st LEFT JOIN near_bins e ON e.chr = c.chr AND e.pos = c.contact_en
    WHERE dist BETWEEN 10001 AND 295000)"""


def _sparse_track(spark, sf):
    """The left anchors of all loops as a track."""
    return A.loops(spark, sf).select("chr", F.floor((F.col("x1") + F.col("x2")) / 2).alias("mids"))


@query("j15_flag_near_track", f"WITH {_NEAR} SELECT chr, contact_st, contact_en, contact_count, dist, with_track FROM flagged")
def j15(spark, sf):
    return C.flag_near_track(A.contacts(spark, sf), _sparse_track(spark, sf), A.BIN, A.MAX_DIST)


@query(
    "a03_balanced_sample",
    f"""WITH {_NEAR}, n AS (SELECT chr, COUNT(*) * 2 AS size FROM flagged WHERE with_track GROUP BY chr),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chr ORDER BY md5(concat_ws('|', '1', chr, contact_st, contact_en))) AS rn
      FROM flagged WHERE NOT with_track)
    SELECT chr, contact_st, contact_en, contact_count, dist, with_track FROM flagged WHERE with_track UNION ALL
    SELECT r.chr, contact_st, contact_en, contact_count, dist, with_track FROM r JOIN n ON n.chr = r.chr WHERE rn <= size""",
)
def a03(spark, sf):
    return C.balanced_sample(A.contacts(spark, sf), _sparse_track(spark, sf), A.BIN, A.MAX_DIST, 2)


@query(
    "a04_fixed_size_sample",
    """SELECT chr, contact_st, contact_en, contact_count, dist FROM a_contacts
    ORDER BY md5(concat_ws('|', '7', chr, contact_st, contact_en)) LIMIT 5000""",
)
def a04(spark, sf):
    return C.fixed_size_sample(A.contacts(spark, sf), 5_000, 7)


@query(
    "j16_matrix_cells",
    """WITH r AS (SELECT (contact_st - 1000000) // 5000 AS i, (contact_en - 1000000) // 5000 AS j, contact_count AS w FROM a_wt
      WHERE chr = 'chr1' AND contact_st BETWEEN 1000000 AND 4000000 AND contact_en BETWEEN 1000000 AND 4000000),
    m AS (SELECT (contact_st - 1000000) // 5000 AS i, (contact_en - 1000000) // 5000 AS j, contact_count AS w FROM a_mut
      WHERE chr = 'chr1' AND contact_st BETWEEN 1000000 AND 4000000 AND contact_en BETWEEN 1000000 AND 4000000)
    SELECT i, j, w AS value FROM r WHERE i < j UNION ALL SELECT j, i, w FROM m WHERE i < j UNION ALL
    SELECT COALESCE(r.i, m.i), COALESCE(r.j, m.j), COALESCE(m.w, r.w)
      FROM (SELECT * FROM r WHERE i = j) r FULL JOIN (SELECT * FROM m WHERE i = j) m ON r.i = m.i AND r.j = m.j""",
)
def j16(spark, sf):
    return C.matrix_cells(A.wild_type(spark, sf), A.BIN, "chr1", 1_000_000, 4_000_000, A.mutant(spark, sf))


@query(
    "j17_align_matrices",
    """SELECT COALESCE(w.chr, m.chr) AS chr, COALESCE(w.contact_st, m.contact_st) AS contact_st,
    COALESCE(w.contact_en, m.contact_en) AS contact_en, COALESCE(w.contact_count, 0) AS wt, COALESCE(m.contact_count, 0) AS mut
    FROM a_wt w FULL JOIN a_mut m ON w.chr = m.chr AND w.contact_st = m.contact_st AND w.contact_en = m.contact_en""",
)
def j17(spark, sf):
    return C.align_matrices(A.wild_type(spark, sf), A.mutant(spark, sf))


_COVERAGE = """ends AS (SELECT chr, contact_st AS pos, contact_count AS c, 1 AS s FROM a_contacts UNION ALL
    SELECT chr, contact_en, contact_count, 0 FROM a_contacts WHERE contact_en <> contact_st),
    cov AS (SELECT chr, pos, SUM(c) AS total FROM ends GROUP BY chr, pos HAVING MAX(s) = 1),
    rep AS (SELECT chr, AVG(total) AS norm, STDDEV_POP(total) / AVG(total) AS cv, COUNT(*) AS n_loci FROM cov WHERE total <> 0 GROUP BY chr)"""


@query(
    "a02_coverage_normalize",
    f"""WITH {_COVERAGE} SELECT c.chr, contact_st, contact_en, ROUND(contact_count / norm, 9) AS contact_count, dist
    FROM a_contacts c JOIN rep ON rep.chr = c.chr WHERE dist < 200000""",
)
def a02(spark, sf):
    scaled, _ = C.coverage_normalize(A.contacts(spark, sf), 200_000)
    return scaled.withColumn("contact_count", F.round("contact_count", 9))


@query(
    "a02_coverage_report",
    f"WITH {_COVERAGE} SELECT chr, ROUND(norm, 6) AS norm, ROUND(cv, 6) AS cv, n_loci, cv >= 0.2 AS uneven FROM rep",
)
def a02_report(spark, sf):
    _, report = C.coverage_normalize(A.contacts(spark, sf), 200_000)
    return report.select("chr", F.round("norm", 6).alias("norm"), F.round("cv", 6).alias("cv"), "n_loci", "uneven")


_DIAGONAL = """s AS (SELECT chr, (MAX(contact_en) - MIN(contact_st)) // 5000 + 1 AS n_bins FROM a_contacts GROUP BY chr),
    d AS (SELECT chr, dist, SUM(contact_count) AS total FROM a_contacts GROUP BY chr, dist)"""


@query(
    "a05_observed_over_expected",
    f"""WITH {_DIAGONAL} SELECT c.chr, contact_st, contact_en, ROUND(contact_count / (total / (n_bins - c.dist / 5000)), 6) AS oe
    FROM a_contacts c JOIN d ON d.chr = c.chr AND d.dist = c.dist JOIN s ON s.chr = c.chr""",
)
def a05(spark, sf):
    return C.observed_over_expected(A.contacts(spark, sf), A.BIN).select(*C.PAIR, F.round("oe", 6).alias("oe"))


@query(
    "a05_diagonal_share",
    f"""WITH {_DIAGONAL} SELECT c.chr, contact_st, contact_en, ROUND(contact_count / total, 9) AS oe
    FROM a_contacts c JOIN d ON d.chr = c.chr AND d.dist = c.dist""",
)
def a05_sum(spark, sf):
    return C.observed_over_expected(A.contacts(spark, sf), A.BIN, "sum").select(*C.PAIR, F.round("oe", 9).alias("oe"))


@query(
    "a06_oe_to_observed",
    """SELECT c.chr, contact_st, contact_en, ROUND(contact_count * e."E1" / 2585.0, 6) AS observed
    FROM a_contacts c LEFT JOIN a_e1 e ON e.chr = c.chr AND e.bin * 5000 = c.dist""",
)
def a06(spark, sf):
    expected = A.eigenvector(spark, sf).select("chr", (F.col("bin") * A.BIN).alias("dist"), F.col("E1").alias("expected"))
    return C.to_observed(A.contacts(spark, sf), expected, 2585).select(*C.PAIR, F.round("observed", 6).alias("observed"))
