"""Queries: interval tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.operators import features as X
from contactloom.operators import tracks as T
from contactloom.operators.ordered import fixed, window_totals
from contactloom.plans import adapters as A
from contactloom.plans.registry import query


@query(
    "s04_normalize_peaks",
    'SELECT DISTINCT chr, start, "end", sigVal, mids FROM a_peaks',
)
def s04(spark, sf):
    raw = A.peaks(spark, sf).select("chr", "start", "end", "sigVal")
    return T.normalize_peaks(raw.unionByName(raw))


@query(
    "a08_duplicate_positions",
    """SELECT chr, start, "end", COUNT(*) AS copies FROM (SELECT chr, start // 20000 AS start, "end" // 20000 AS "end" FROM a_peaks)
    GROUP BY ALL HAVING COUNT(*) > 1""",
)
def a08(spark, sf):
    coarse = A.peaks(spark, sf).select("chr", F.expr("start div 20000").alias("start"), F.expr("end div 20000").alias("end"))
    return T.duplicate_positions(coarse)


@query(
    "a07_nested_intervals",
    """SELECT chr, COUNT(*) FILTER (start > ps AND "end" < pe) AS nested FROM (SELECT chr, start, "end",
    LAG(start) OVER w AS ps, LAG("end") OVER w AS pe FROM (SELECT DISTINCT chr, start, "end" FROM a_genes)
    WINDOW w AS (PARTITION BY chr ORDER BY start, "end")) GROUP BY chr""",
)
def a07(spark, sf):
    return T.nested_intervals(A.genes(spark, sf))


@query(
    "j03_intersect_intervals",
    """SELECT g.chr, g.gene, p.event_id FROM a_genes g JOIN a_peaks p ON p.chr = g.chr AND g."end" >= p.start AND g.start < p."end" """,
)
def j03(spark, sf):
    pairs = T.intersect(A.genes(spark, sf).select("chr", "start", "end", "gene"), A.peaks(spark, sf).select("chr", "start", "end", "event_id"))
    return pairs.select("chr", F.col("a_gene").alias("gene"), F.col("b_event_id").alias("event_id"))


def _regions(spark, sf):
    return A.loops(spark, sf).select("chr", F.col("x1").alias("start"), F.col("y2").alias("end"), "id")


@query(
    "j04_region_query",
    """SELECT l.id, g.gene FROM a_loops l JOIN a_genes g ON g.chr = l.chr AND g.start <= l.y2 AND g."end" >= l.x1""",
)
def j04(spark, sf):
    genes = A.genes(spark, sf).select("chr", "start", "end", "gene")
    return T.stab(genes, _regions(spark, sf)).select(F.col("b_id").alias("id"), F.col("a_gene").alias("gene"))


@query(
    "j04_region_row_ids",
    """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chr ORDER BY start, "end") - 1 AS rid FROM a_genes)
    SELECT l.id, MIN(rid) AS first_id, MAX(rid) AS last_id FROM a_loops l
    JOIN r ON r.chr = l.chr AND r.start <= l.y2 AND r."end" >= l.x1 GROUP BY l.id""",
)
def j04_ids(spark, sf):
    return T.stab_ids(A.genes(spark, sf), _regions(spark, sf), "id")


@query(
    "j05_genes_in_interval",
    """SELECT l.id, COUNT(g.gene) AS n_genes, CAST(COALESCE(SUM(CAST(g.sigVal AS DECIMAL(18,2))), 0) AS DOUBLE) AS total FROM a_loops l
    LEFT JOIN a_genes g ON g.chr = l.chr AND g.start <= l.y2 AND g."end" >= l.x1 GROUP BY l.id""",
)
def j05(spark, sf):
    genes = A.genes(spark, sf).select("chr", "start", "end", fixed("sigVal").alias("total"), F.lit(1).cast("bigint").alias("n_genes"))
    windows = _regions(spark, sf).withColumnsRenamed({"start": "lo", "end": "hi"})
    sums = window_totals(windows, genes, ["n_genes", "total"], first="start", last="end")
    return sums.select("id", "n_genes", F.col("total").cast("double").alias("total"))


@query(
    "j06_peaks_in_interval",
    """SELECT l.id, p.event_id, p.mids FROM a_loops l JOIN a_peaks p ON p.chr = l.chr AND p.mids BETWEEN l.x1 AND l.y2""",
)
def j06(spark, sf):
    found = T.peaks_in_regions(A.peaks(spark, sf).select("chr", "start", "end", "mids", "event_id"), _regions(spark, sf))
    return found.select(F.col("b_id").alias("id"), F.col("a_event_id").alias("event_id"), F.col("a_mids").alias("mids"))


@query(
    "j06_peak_rank_range",
    """SELECT l.id, COUNT(p.mids) FILTER (p.mids < l.x1) AS first_rank, COUNT(p.mids) FILTER (p.mids <= l.y2) AS end_rank
    FROM a_loops l LEFT JOIN a_peaks p ON p.chr = l.chr GROUP BY l.id""",
)
def j06_ranks(spark, sf):
    return T.region_rank_range(A.peaks(spark, sf), _regions(spark, sf)).select("id", "first_rank", "end_rank")


@query(
    "j07_nearest_peaks",
    """WITH pts AS (SELECT DISTINCT chr, contact_st AS p FROM a_contacts), i AS (SELECT UNNEST(range(0, 4)) AS idx),
    r AS (SELECT chr, mids, sigVal, ROW_NUMBER() OVER (PARTITION BY chr ORDER BY mids, start, "end") AS rn FROM a_peaks),
    k AS (SELECT pts.chr, pts.p, (SELECT COUNT(*) FROM r WHERE r.chr = pts.chr AND r.mids < pts.p) AS lo,
      (SELECT COUNT(*) FROM r WHERE r.chr = pts.chr AND r.mids <= pts.p) AS hi,
      (SELECT COUNT(*) FROM r WHERE r.chr = pts.chr) AS n, (SELECT MAX(mids) FROM r WHERE r.chr = pts.chr) AS last FROM pts)
    SELECT k.chr, p, 'left' AS side, idx, COALESCE(mids, 0) AS mids, COALESCE(sigVal, 0) AS sigVal FROM k CROSS JOIN i
      LEFT JOIN r ON r.chr = k.chr AND r.rn = GREATEST(lo - 4, 0) + idx + 1 AND r.rn <= lo
    UNION ALL SELECT k.chr, p, 'right', idx, COALESCE(mids, CASE WHEN hi = n THEN p + 1 ELSE last END), COALESCE(sigVal, 0) FROM k CROSS JOIN i
      LEFT JOIN r ON r.chr = k.chr AND r.rn = hi + idx + 1""",
)
def j07(spark, sf):
    points = A.contacts(spark, sf).select("chr", F.col("contact_st").alias("p"))
    return X.nearest_peaks(A.peaks(spark, sf), points, 4)


def boundary_sql(regions: str, track: str, n: int, fields: tuple[str, ...] = ("mids", "sigVal")) -> str:
    """Rows (id, boundary, idx, fields) from ordered lists of the items in each region."""
    item = ", ".join(f"{f} := t.{f}" for f in fields)
    pad = ", ".join(f"{f} := {{at}}" if f == "mids" else f"{f} := 0" for f in fields)

    def pads(at: str, count: str) -> str:
        return f"list_transform(range(0, {count}), lambda z: struct_pack({pad.format(at=at)}))"

    return f"""inw AS (SELECT q.id, ANY_VALUE(q.s) AS s, ANY_VALUE(q.e) AS e, COUNT(t.mids) AS n,
      LIST(struct_pack({item}) ORDER BY t.mids, t.start, t."end") FILTER (t.mids IS NOT NULL) AS l
      FROM {regions} q LEFT JOIN {track} t ON t.chr = q.chr AND t.mids BETWEEN q.s AND q.e GROUP BY q.id),
    lists AS (SELECT id, CASE WHEN n <= 1 THEN {pads('s', str(n))} WHEN n >= {2 * n} THEN l[1:{n}]
        ELSE list_concat(l[1:n // 2], {pads('l[n // 2].mids', f'{n} - n // 2')}) END AS first_l,
      CASE WHEN n = 0 THEN {pads('e', str(n))} WHEN n = 1 THEN list_concat(l, {pads('l[1].mids', str(n - 1))})
        WHEN n >= {2 * n} THEN l[n - {n - 1}:n]
        ELSE list_sort(list_concat(l[n // 2 + 1:n], {pads('l[n // 2 + 1].mids', f'{n} - (n - n // 2)')})) END AS last_l FROM inw)"""


@query(
    "j08_boundary_peaks",
    f"""WITH q AS (SELECT id, chr, x1 AS s, y2 AS e FROM a_loops), {boundary_sql('q', 'a_peaks', 4)}, i AS (SELECT UNNEST(range(0, 4)) AS idx)
    SELECT id, 'start' AS boundary, idx, first_l[idx + 1].mids AS mids, CAST(first_l[idx + 1].sigVal AS DOUBLE) AS sigVal FROM lists CROSS JOIN i
    UNION ALL SELECT id, 'end', idx, last_l[idx + 1].mids, CAST(last_l[idx + 1].sigVal AS DOUBLE) FROM lists CROSS JOIN i""",
)
def j08(spark, sf):
    return X.boundary_peaks(A.peaks(spark, sf), _regions(spark, sf), 4)


def oriented(spark, sf):
    peaks = A.peaks(spark, sf).select("chr", "start", "end", "mids", "sigVal", "event_id")
    return T.orient_peaks(peaks, A.motifs(spark, sf))


@query("j09_orient_peaks", "SELECT * FROM a_oriented")
def j09(spark, sf):
    return oriented(spark, sf)


@query("j09b_keep_oriented", "SELECT * FROM a_only_oriented")
def j09b(spark, sf):
    return T.keep_oriented(oriented(spark, sf))


LOOP_HIT = """l.chr = c.chr AND l.x2 >= c.contact_st - 25000 AND l.x1 < c.contact_st + 25000
    AND l.y2 >= c.contact_en - 25000 AND l.y1 < c.contact_en + 25000"""


@query(
    "j10_flag_loops",
    f"""SELECT c.chr, c.contact_st, c.contact_en, c.contact_count, c.dist,
    CASE WHEN EXISTS (SELECT 1 FROM a_loops l WHERE {LOOP_HIT}) THEN 1 ELSE 0 END AS "IsLoop" FROM a_contacts c""",
)
def j10(spark, sf):
    return T.flag_loops(A.contacts(spark, sf), A.loops(spark, sf), A.WINDOW)


@query(
    "j11_loop_anchors",
    """SELECT 'left' AS side, chr, x1 AS start, x2 AS "end", id FROM a_loops UNION ALL SELECT 'right', chr, y1, y2, id FROM a_loops""",
)
def j11(spark, sf):
    left, right = T.loop_anchors(A.loops(spark, sf))
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


@query(
    "a09_binned_sums",
    """WITH b AS (SELECT id, chr, x1, UNNEST(range(x1, y2 - 1, 20000)) AS lo FROM a_loops)
    SELECT b.id, (lo - x1) // 20000 AS bin, lo AS bin_start, CAST(COALESCE(SUM(CAST(p.sigVal AS DECIMAL(18,2))), 0) AS DOUBLE) AS "sigVal"
    FROM b LEFT JOIN a_peaks p ON p.chr = b.chr AND p.mids BETWEEN lo AND lo + 20000 GROUP BY b.id, x1, lo""",
)
def a09(spark, sf):
    sums = T.binned_sums(A.peaks(spark, sf), _regions(spark, sf), 20_000)
    return sums.select("id", F.col("bin").cast("bigint").alias("bin"), "bin_start", "sigVal")


_E1_SIZE = "n AS (SELECT chr, MAX(bin) + 1 AS n FROM a_e1 GROUP BY chr)"


@query(
    "j18_eigenvector_windows",
    f"""WITH {_E1_SIZE}, w AS (SELECT l.id, l.chr, l.x1 // 40000 AS f, GREATEST((y2 - x1) // 40000, 1) AS c
      FROM a_loops l JOIN n ON n.chr = l.chr AND l.x1 // 40000 < n.n),
    s AS (SELECT id, chr, f, UNNEST(range(0, c)) AS k FROM w)
    SELECT id, k, f + k AS bin, COALESCE(e."E1", 0) AS "E1" FROM s LEFT JOIN a_e1 e ON e.chr = s.chr AND e.bin = f + k""",
)
def j18(spark, sf):
    return T.eigenvector_windows(_regions(spark, sf), A.eigenvector(spark, sf), A.E1_BIN).select("id", "k", "bin", "E1")


@query(
    "j18_eigenvector_violations",
    f"""WITH {_E1_SIZE} SELECT g.gene, n.n AS n_bins FROM a_genes g JOIN n ON n.chr = g.chr WHERE g.start // 20000 >= n.n""",
)
def j18_bad(spark, sf):
    genes = A.genes(spark, sf).select("chr", "start", "end", "gene")
    return T.eigenvector_violations(genes, A.eigenvector(spark, sf), 20_000).select("gene", "n_bins")
