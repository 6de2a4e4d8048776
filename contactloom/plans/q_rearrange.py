"""Queries: rearranged coordinates and the comparison of two maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.operators import rearrange as R
from contactloom.plans import adapters as A
from contactloom.plans.q_tracks import oriented
from contactloom.plans.registry import query

REGION = R.Region("chr1", 2_000_000, 2_600_000)
S, E, L = REGION.start, REGION.end, REGION.length
IN_ST = f"(chr = 'chr1' AND contact_st > {S} AND contact_st < {E})"
IN_EN = f"(chr = 'chr1' AND contact_en > {S} AND contact_en < {E})"


def moved_sql(column: str, by: int, test: str = f">= {S}") -> str:
    return f"CASE WHEN chr = 'chr1' AND {column} {test} THEN {column} + ({by}) ELSE {column} END"


_DEL = f"""SELECT chr, {moved_sql('contact_st', -L)} AS contact_st, {moved_sql('contact_en', -L)} AS contact_en, contact_count
    FROM {{t}} WHERE NOT ({IN_ST} OR {IN_EN})"""


@query("r01_delete_contacts", f"SELECT *, contact_en - contact_st AS dist FROM ({_DEL.format(t='a_contacts')})")
def r01(spark, sf):
    return R.delete_contacts(A.contacts(spark, sf), REGION)


_DUP = f"""SELECT chr, {moved_sql('contact_st', L)} AS contact_st, {moved_sql('contact_en', L)} AS contact_en, contact_count FROM a_contacts
    UNION ALL SELECT chr, contact_st + {L}, contact_en + {L}, contact_count FROM a_contacts WHERE {IN_ST} OR {IN_EN}"""


@query("r02_duplicate_contacts", f"SELECT *, contact_en - contact_st AS dist FROM ({_DUP})")
def r02(spark, sf):
    return R.duplicate_contacts(A.contacts(spark, sf), REGION)


def _peaks(spark, sf):
    return A.peaks(spark, sf).select("chr", "start", "end", "mids", "sigVal", "event_id")


def _shift_sql(test: str, by: int, source: str, extra: str) -> str:
    return f"""SELECT chr, CASE WHEN {test} THEN start + ({by}) ELSE start END AS start, CASE WHEN {test} THEN "end" + ({by}) ELSE "end" END AS "end",
    CASE WHEN {test} THEN mids + ({by}) ELSE mids END AS mids, {extra} FROM {source}"""


@query(
    "r03_delete_peaks",
    f"""SELECT * FROM ({_shift_sql(f"chr = 'chr1' AND " + f'"end" > {E}', -L, f"a_peaks WHERE NOT (chr = 'chr1' AND start >= {S} AND " + f'"end" <= {E})', '"sigVal", event_id')})
    WHERE NOT (chr = 'chr1' AND abs(mids - {S}) <= 20000)""",
)
def r03(spark, sf):
    return R.delete_peaks(_peaks(spark, sf), REGION, 20_000)


@query(
    "r04_duplicate_peaks",
    f"""{_shift_sql(f"chr = 'chr1' AND mids > {E}", L, f"a_peaks WHERE NOT (chr = 'chr1' AND start < {S} AND " + f'"end" > {E})', '"sigVal", event_id')}
    UNION ALL SELECT chr, start + {L}, "end" + {L}, mids + {L}, "sigVal", event_id FROM a_peaks WHERE chr = 'chr1' AND start > {S} AND "end" < {E}""",
)
def r04(spark, sf):
    return R.duplicate_peaks(_peaks(spark, sf), REGION)


_STRANDS = "(SELECT CAST(o_orderkey AS VARCHAR) AS gene, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s FROM orders WHERE o_orderstatus <> 'P')"
_GENES = f"""g AS (SELECT a.chr, a.start, a."end", a.mids, a.gene, s.s AS strand_sign FROM a_genes a LEFT JOIN {_STRANDS} s ON s.gene = a.gene),
    m AS (SELECT MAX(start) AS ms FROM g WHERE chr = 'chr1' AND start <= {E} AND "end" >= {S}),
    lst AS (SELECT ms, MAX("end") AS me FROM g JOIN m ON g.start = m.ms WHERE chr = 'chr1' AND "end" >= {S} GROUP BY ms)"""
_LATER = f"""chr = 'chr1' AND (start > (SELECT ms FROM lst) OR (start = (SELECT ms FROM lst) AND "end" > (SELECT me FROM lst)))"""


def _stranded(spark, sf):
    genes = A.genes(spark, sf).select("chr", "start", "end", "mids", "gene")
    strands = A.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("gene"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("Strand")
    )
    return R.annotate_strand(genes, strands)


@query("j14_annotate_strand", f"WITH {_GENES} SELECT * FROM g")
def j14(spark, sf):
    return _stranded(spark, sf)


@query(
    "r05_delete_genes",
    f"""WITH {_GENES} {_shift_sql(_LATER, -L, f'''g WHERE NOT COALESCE(chr = 'chr1' AND ((strand_sign = 1 AND start < {E} AND start + 2000 > {S})
      OR (strand_sign = -1 AND "end" > {S} AND "end" - 2000 < {E})), FALSE)''', 'gene, strand_sign')}""",
)
def r05(spark, sf):
    return R.delete_genes(_stranded(spark, sf), REGION)


@query(
    "r06_duplicate_genes",
    f"""WITH {_GENES} {_shift_sql(_LATER, L, f'''g WHERE NOT COALESCE(chr = 'chr1' AND ((strand_sign = 1 AND start + 2000 > {E} AND start < {E})
      OR (strand_sign = -1 AND "end" - 2000 < {E} AND "end" > {E})), FALSE)''', 'gene, strand_sign')}
    UNION ALL SELECT chr, start + {L}, "end" + {L}, mids + {L}, gene, strand_sign FROM g WHERE chr = 'chr1' AND start > {S} AND "end" < {E}""",
)
def r06(spark, sf):
    return R.duplicate_genes(_stranded(spark, sf), REGION)


@query(
    "r07_delete_eigenvector",
    f"""SELECT chr, CASE WHEN chr = 'chr1' AND bin >= 65 THEN bin - 15 ELSE bin END AS bin, "E1" FROM a_e1
    WHERE NOT (chr = 'chr1' AND bin >= 50 AND bin < 65)""",
)
def r07(spark, sf):
    track, _ = R.delete_eigenvector(A.eigenvector(spark, sf), REGION, A.E1_BIN)
    return track


@query(
    "r08_lift_back_deletion",
    f"""SELECT chr, {moved_sql('contact_st', L)} AS contact_st, {moved_sql('contact_en', L)} AS contact_en, contact_count,
    {moved_sql('contact_en', L)} - {moved_sql('contact_st', L)} AS dist FROM ({_DEL.format(t='a_contacts')})""",
)
def r08(spark, sf):
    return R.lift_back_deletions(R.delete_contacts(A.contacts(spark, sf), REGION), [REGION])


@query(
    "r09_lift_back_duplication",
    f"""SELECT *, contact_en - contact_st AS dist FROM (SELECT chr, {moved_sql('contact_st', -L, f'>= {S + L}')} AS contact_st,
    {moved_sql('contact_en', -L, f'>= {S + L}')} AS contact_en, SUM(contact_count) AS contact_count FROM ({_DUP}) GROUP BY ALL)""",
)
def r09(spark, sf):
    return R.lift_back_duplications(R.duplicate_contacts(A.contacts(spark, sf), REGION), [REGION])


@query(
    "r10_invert_peaks",
    f"""SELECT chr, start, "end", (start + "end") // 2 AS mids, "sigVal", event_id, plus_orientation, minus_orientation FROM (
    SELECT chr, CASE WHEN k THEN {S + E} - "end" ELSE start END AS start, CASE WHEN k THEN {S + E} - start ELSE "end" END AS "end", "sigVal", event_id,
    CASE WHEN k THEN minus_orientation ELSE plus_orientation END AS plus_orientation,
    CASE WHEN k THEN plus_orientation ELSE minus_orientation END AS minus_orientation
    FROM (SELECT *, chr = 'chr1' AND start >= {S} AND "end" <= {E} AS k, chr = 'chr1' AND start < {E} AND "end" > {S} AS o FROM a_oriented) WHERE k OR NOT o)""",
)
def r10(spark, sf):
    return R.invert_peaks(oriented(spark, sf), REGION)


_LOST = f"(chr = 'chr1' AND (contact_st BETWEEN {S} AND {E} OR contact_en BETWEEN {S} AND {E}))"


def aligned_sql(mut: str = "a_mut", p: str = "") -> str:
    return f"""cells{p} AS (SELECT COALESCE(w.chr, m.chr) AS chr, COALESCE(w.contact_st, m.contact_st) AS contact_st,
    COALESCE(w.contact_en, m.contact_en) AS contact_en, COALESCE(w.contact_count, 0) AS wt, COALESCE(m.contact_count, 0) AS mut
    FROM a_wt w FULL JOIN {mut} m ON w.chr = m.chr AND w.contact_st = m.contact_st AND w.contact_en = m.contact_en)"""


def depth_sql(mut: str = "a_mut", p: str = "") -> str:
    return f"""{aligned_sql(mut, p)}, f{p} AS (SELECT SUM(wt) / SUM(mut) AS f FROM cells{p} WHERE NOT {_LOST}),
    diff{p} AS (SELECT chr, contact_st, contact_en, CASE WHEN {_LOST} THEN 0 ELSE wt END AS wt,
      CASE WHEN {_LOST} THEN 0 ELSE mut * f - wt END AS difference FROM cells{p} CROSS JOIN f{p})"""


def difference_sql(mut: str = "a_mut", p: str = "") -> str:
    return f"""{depth_sql(mut, p)},
    n{p} AS (SELECT chr, (MAX(contact_en) - MIN(contact_st)) // 5000 + 1 AS n FROM diff{p} GROUP BY chr),
    d{p} AS (SELECT x.chr, contact_en - contact_st AS dist, SUM(wt) / (ANY_VALUE(n) - (contact_en - contact_st) / 5000) AS m
      FROM diff{p} x JOIN n{p} y ON y.chr = x.chr GROUP BY 1, 2),
    norm{p} AS (SELECT x.chr, contact_st, contact_en, contact_en - contact_st AS dist, wt, difference / m AS difference
      FROM diff{p} x JOIN d{p} y ON y.chr = x.chr AND y.dist = contact_en - contact_st)"""


def scores_sql(mut: str = "a_mut", p: str = "") -> str:
    return f"""{difference_sql(mut, p)}, nz{p} AS (SELECT * FROM norm{p} WHERE difference <> 0),
    q{p} AS (SELECT chr, dist, quantile_cont(difference, 0.04) AS lo, quantile_cont(difference, 0.96) AS hi FROM nz{p} GROUP BY chr, dist),
    t{p} AS (SELECT x.chr, x.dist, AVG(difference) AS m, STDDEV_POP(difference) AS s FROM nz{p} x JOIN q{p} y ON y.chr = x.chr AND y.dist = x.dist
      WHERE difference > lo AND difference < hi GROUP BY x.chr, x.dist HAVING COUNT(*) >= 10),
    z{p} AS (SELECT x.chr, contact_st, contact_en, x.dist, difference, (difference - m) / s AS z
      FROM nz{p} x JOIN t{p} y ON y.chr = x.chr AND y.dist = x.dist)"""


_NOISY = "noisy AS (SELECT chr, contact_st, contact_en, contact_count + (contact_st // 5000) % 7 AS contact_count FROM a_mut)"
_BOTH = f"{scores_sql()}, {_NOISY}, {scores_sql('noisy', 'p')}"


@query(
    "r11_depth_matched_difference",
    f"WITH {depth_sql()} SELECT chr, contact_st, contact_en, wt, ROUND(difference, 6) AS difference FROM diff",
)
def r11(spark, sf):
    cells = R.depth_matched_difference(A.wild_type(spark, sf), A.mutant(spark, sf), REGION)
    return cells.withColumn("difference", F.round("difference", 6))


def _normalized(spark, sf):
    cells = R.depth_matched_difference(A.wild_type(spark, sf), A.mutant(spark, sf), REGION)
    return R.normalize_by_diagonal(cells, A.BIN)


@query(
    "r11_normalized_difference",
    f"WITH {difference_sql()} SELECT chr, contact_st, contact_en, dist, wt, ROUND(difference, 6) AS difference FROM norm",
)
def r11_norm(spark, sf):
    return _normalized(spark, sf).select("chr", "contact_st", "contact_en", "dist", "wt", F.round("difference", 6).alias("difference"))


@query(
    "r12_fold_change",
    f"""WITH {aligned_sql()} SELECT *, NULLIF(CASE WHEN wt = 0 THEN NULL ELSE ROUND(mut / wt, 9) END, 1) AS fold_change FROM cells
    WHERE chr = 'chr2' AND contact_st BETWEEN 1000000 AND 5000000 AND contact_en BETWEEN 1000000 AND 5000000""",
)
def r12(spark, sf):
    cells = R.fold_change(A.wild_type(spark, sf), A.mutant(spark, sf), R.Region("chr2", 1_000_000, 5_000_000))
    return cells.withColumn("fold_change", F.round("fold_change", 9))


@query(
    "r13_ectopic_scores",
    f"WITH {scores_sql()} SELECT chr, contact_st, contact_en, dist, ROUND(difference, 5) AS difference, ROUND(z, 5) AS z FROM z",
)
def r13(spark, sf):
    scores = R.ectopic_scores(_normalized(spark, sf))
    return scores.withColumns({"difference": F.round("difference", 5), "z": F.round("z", 5)})


def _two_scores(spark, sf):
    real = R.ectopic_scores(_normalized(spark, sf))
    # the predicted map: the same comparison with the two conditions exchanged for a noisy copy
    noisy = A.mutant(spark, sf).withColumn("contact_count", F.col("contact_count") + F.floor(F.col("contact_st") / A.BIN) % 7)
    cells = R.depth_matched_difference(A.wild_type(spark, sf), noisy, REGION)
    return real, R.ectopic_scores(R.normalize_by_diagonal(cells, A.BIN))


@query(
    "r14_ectopic_overlap",
    f"""WITH {_BOTH} SELECT COUNT(*) FILTER (z.z > 2) AS n_real, COUNT(*) FILTER (zp.z > 2) AS n_predicted, COUNT(*) FILTER (z.z > 2 AND zp.z > 2) AS n_both
    FROM z FULL JOIN zp ON zp.chr = z.chr AND zp.contact_st = z.contact_st AND zp.contact_en = z.contact_en""",
)
def r14_overlap(spark, sf):
    return R.ectopic_overlap(*_two_scores(spark, sf))


@query(
    "r14_permutation_test",
    f"""WITH {_BOTH}, m AS (SELECT zp.chr, zp.contact_st, zp.contact_en, COALESCE(zp.z > 2, FALSE) AS high, COALESCE(z.z > 2, FALSE) AS hit FROM zp
      LEFT JOIN z ON z.chr = zp.chr AND z.contact_st = zp.contact_st AND z.contact_en = zp.contact_en),
    o AS (SELECT COUNT(*) AS cells, COUNT(*) FILTER (hit) AS hits, COUNT(*) FILTER (high) AS draws, COUNT(*) FILTER (hit AND high) AS observed FROM m),
    k AS (SELECT o.*, UNNEST(range(GREATEST(0, draws + hits - cells), LEAST(hits, draws) + 1)) AS k FROM o),
    p AS (SELECT k, EXP(LGAMMA(hits + 1) - LGAMMA(k + 1) - LGAMMA(hits - k + 1) + LGAMMA(cells - hits + 1) - LGAMMA(draws - k + 1)
      - LGAMMA(cells - hits - draws + k + 1) - LGAMMA(cells + 1) + LGAMMA(draws + 1) + LGAMMA(cells - draws + 1)) AS p FROM k),
    s AS (SELECT k, SUM(p) OVER (ORDER BY k) AS total FROM p),
    nulls AS (SELECT o.observed, (SELECT MIN(k) FROM s WHERE total >= 0.5)::DOUBLE AS null_median,
      SQRT(draws * (hits / cells) * (1 - hits / cells) * (cells - draws) / (cells - 1)) AS null_std FROM o)
    SELECT observed, null_median, ROUND(null_std, 6) AS null_std, ROUND((observed - null_median) / null_std, 6) AS z FROM nulls""",
)
def r14(spark, sf):
    test = R.permutation_test(*_two_scores(spark, sf))
    return test.withColumns({"null_std": F.round("null_std", 6), "z": F.round("z", 6)})
