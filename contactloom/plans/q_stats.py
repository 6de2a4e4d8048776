"""Queries: statistics, validation measures, condition comparison, sequence and signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.operators import differential as D
from contactloom.operators import features as X
from contactloom.operators import sequence as Q
from contactloom.operators import stats as V
from contactloom.operators.contacts import grid_positions
from contactloom.operators.ordered import running_total
from contactloom.plans import adapters as A
from contactloom.plans.registry import query


def rounded(df, digits=6, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "a01_normalization_coefficient",
    """SELECT cell_type, CAST(round_even(AVG(t), 0) AS BIGINT) AS coeff, CAST(round_even(quantile_cont(t, 0.5), 0) AS BIGINT) AS median,
    CAST(round_even(STDDEV_POP(t), 0) AS BIGINT) AS std FROM (SELECT condition AS cell_type, contact_st, SUM(contact_count) AS t FROM a_cond GROUP BY ALL) GROUP BY cell_type""",
)
def a01(spark, sf):
    return V.normalization_coefficient(A.conditions(spark, sf), "condition")


_RUN_BINS = """rb AS (SELECT chr, bin, SUM(CAST(value AS DECIMAL(18,2)) * (LEAST("end", bin * {b} + {b}) - GREATEST(start, bin * {b}))) AS total
    FROM (SELECT *, UNNEST(range(start // {b}, ("end" - 1) // {b} + 1)) AS bin FROM a_runs) GROUP BY chr, bin)"""
_SIZES = 'sz AS (SELECT chr, MAX("end") AS size FROM a_runs GROUP BY chr)'


def _sizes(spark, sf):
    return A.runs(spark, sf).groupBy("chr").agg(F.max("end").alias("size"))


@query(
    "a10_strong_bins",
    f"""WITH {_RUN_BINS.format(b=1000)}, {_SIZES}, allb AS (SELECT chr, UNNEST(range(0, (size - 1 + 999) // 1000)) AS bin FROM sz),
    f AS (SELECT a.chr, a.bin, COALESCE(total, 0)::DOUBLE AS total FROM allb a LEFT JOIN rb ON rb.chr = a.chr AND rb.bin = a.bin),
    c AS (SELECT chr, quantile_cont(total, 0.9) AS cut FROM f GROUP BY chr)
    SELECT f.chr, bin * 1000 AS start, bin * 1000 + 1000 AS "end", total FROM f JOIN c ON c.chr = f.chr WHERE total > cut""",
)
def a10(spark, sf):
    return V.strong_bins(A.runs(spark, sf), _sizes(spark, sf))


@query(
    "a10_strong_bins_small_values",
    f"""WITH {_RUN_BINS.format(b=1000)}, {_SIZES}, allb AS (SELECT chr, UNNEST(range(0, (size - 1 + 999) // 1000)) AS bin FROM sz),
    f AS (SELECT a.chr, a.bin, COALESCE(total, 0)::DOUBLE AS total FROM allb a LEFT JOIN rb ON rb.chr = a.chr AND rb.bin = a.bin),
    c AS (SELECT chr, quantile_cont(total, 0.9) AS cut FROM f GROUP BY chr)
    SELECT f.chr, bin * 1000 AS start, bin * 1000 + 1000 AS "end", ROUND(total, 3) AS scaled FROM f JOIN c ON c.chr = f.chr WHERE total > cut""",
)
def a10_small(spark, sf):
    """The same track times 1e-9, as p-values are."""
    runs = A.runs(spark, sf).withColumn("value", F.col("value") * 1e-9)
    bins = V.strong_bins(runs, _sizes(spark, sf))
    return bins.select("chr", "start", "end", F.round(F.col("total") * 1e9, 3).alias("scaled"))


@query(
    "a11_sparsity_profile",
    f"""WITH {_SIZES}, s AS (SELECT chr, SUM(CASE WHEN start % 5 <> 0 THEN "end" - start ELSE 0 END) AS nonzero,
      SUM(CASE WHEN start % 5 > 1 THEN "end" - start ELSE 0 END) AS finite FROM a_runs WHERE value <> 0 GROUP BY chr)
    SELECT sz.chr, size AS total, nonzero::BIGINT AS nonzero, finite::BIGINT AS finite FROM sz JOIN s ON s.chr = sz.chr""",
)
def a11(spark, sf):
    five = F.col("start") % 5
    runs = A.runs(spark, sf).filter("value <> 0").withColumn(
        "value", F.when(five == 0, 0.0).when(five == 1, float("nan")).otherwise(F.col("value"))
    )
    return V.sparsity_profile(runs, _sizes(spark, sf))


def _genome(spark, sf):
    """The texts as bases, laid end to end on five chromosomes."""
    docs = A.table(spark, sf, "documents").select(
        F.concat(F.lit("chr"), (F.col("doc_id") % 5 + 1).cast("string")).alias("chr"),
        "doc_id",
        F.regexp_replace(F.lower("text"), "[^acgt]", "n").alias("seq"),
    ).withColumn("len", F.length("seq").cast("bigint"))
    placed = running_total(docs, ["chr"], "doc_id", ["doc_id"], "len", "block_start")
    return placed.select("chr", "block_start", "seq")


_GENOME = """gen AS (SELECT chr, seq, COALESCE(SUM(length(seq)) OVER (PARTITION BY chr ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
    FROM (SELECT 'chr' || CAST(doc_id % 5 + 1 AS VARCHAR) AS chr, doc_id, regexp_replace(lower(text), '[^acgt]', 'n', 'g') AS seq FROM documents)),
    gb AS (SELECT chr, bin, substr(seq, GREATEST(bin * 5000 - off, 0) + 1, LEAST(bin * 5000 + 5000 - off, length(seq)) - GREATEST(bin * 5000 - off, 0)) AS piece
      FROM (SELECT *, UNNEST(range(off // 5000, (off + length(seq) - 1) // 5000 + 1)) AS bin FROM gen WHERE length(seq) > 0)),
    codes AS (SELECT chr, bin, SUM(length(replace(replace(replace(piece, 'a', ''), 't', ''), 'g', '')) * 0
      + (length(piece) - length(replace(piece, 't', ''))) + 2 * (length(piece) - length(replace(piece, 'g', '')))
      + 3 * (length(piece) - length(replace(piece, 'c', ''))) + 4 * (length(piece) - length(replace(piece, 'n', ''))))::BIGINT AS total FROM gb GROUP BY chr, bin)"""


@query("a12_base_code_bins", f"WITH {_GENOME} SELECT * FROM codes")
def a12_codes(spark, sf):
    return Q.code_bins(_genome(spark, sf), A.BIN)


_RANKED = """(SELECT *, RANK() OVER (ORDER BY contact) + (COUNT(*) OVER (PARTITION BY contact) - 1) / 2.0 AS rc,
    RANK() OVER (ORDER BY {s}) + (COUNT(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rs FROM w)"""
_CORR = "SELECT '{s}' AS signal, ROUND(corr(contact, {s}), 6) AS pearson, ROUND(corr(rc, rs), 6) AS spearman FROM " + _RANKED


@query(
    "a12_signal_correlation",
    f"""WITH {_RUN_BINS.format(b=5000)}, {_GENOME},
    b AS (SELECT chr, MIN(contact_st) AS lo, MAX(contact_st) AS hi FROM a_contacts GROUP BY chr),
    g AS (SELECT chr, UNNEST(range(lo, hi + 1, 5000)) AS pos FROM b),
    d AS (SELECT * FROM g),
    w AS (SELECT d.chr, d.pos, COALESCE(ANY_VALUE(c.contact_count), 0) AS contact,
      COALESCE((SELECT SUM(total) FROM rb WHERE rb.chr = d.chr AND rb.bin BETWEEN d.pos // 5000 + 1 AND d.pos // 5000 + 4), 0)::DOUBLE AS chip,
      COALESCE((SELECT SUM(total) FROM codes WHERE codes.chr = d.chr AND codes.bin BETWEEN d.pos // 5000 AND d.pos // 5000 + 4), 0)::DOUBLE AS bases
      FROM d LEFT JOIN a_contacts c ON c.chr = d.chr AND c.contact_st = d.pos AND c.contact_en = d.pos + 25000 GROUP BY d.chr, d.pos)
    {_CORR.format(s='chip')} UNION ALL {_CORR.format(s='bases')}""",
)
def a12(spark, sf):
    contacts = A.contacts(spark, sf)
    bounds = contacts.groupBy("chr").agg(F.min("contact_st").alias("lo"), F.max("contact_st").alias("hi"))
    signals = {"chip": V.signal_bins(A.runs(spark, sf), A.BIN), "bases": Q.code_bins(_genome(spark, sf), A.BIN)}
    out = V.signal_correlation(contacts, signals, grid_positions(bounds, A.BIN), A.BIN, 5, skip={"chip": 1})
    return rounded(out, 6, "pearson", "spearman")


@query(
    "a13_gc_content",
    """SELECT chr, ROUND(CASE WHEN length(seq) = 0 THEN NULL ELSE (2 * length(seq) - length(replace(seq, 'g', '')) - length(replace(seq, 'c', ''))) / length(seq) END, 9) AS gc FROM a_seq""",
)
def a13(spark, sf):
    return rounded(Q.gc_content(A.sequences(spark, sf)), 9, "gc")


# ---- validation measures --------------------------------------------------------------------------


@query(
    "v01_r_squared",
    """SELECT chr, ROUND(1 - SUM((predicted - contact_count) ** 2) / (VAR_POP(predicted) * COUNT(*)), 9) AS r2 FROM a_pred GROUP BY chr""",
)
def v01(spark, sf):
    return rounded(V.r_squared(A.predictions(spark, sf)), 9, "r2")


_CELLS = "cl AS (SELECT chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count AS r, predicted AS p FROM a_pred WHERE dist // 5000 > 2 AND dist // 5000 < 300)"
_EXTENT = "ex AS (SELECT chr, MIN(contact_st) // 5000 AS lo, MAX(contact_en) // 5000 AS hi FROM a_pred GROUP BY chr)"


def _smooth_sql(h: int) -> str:
    return f"""{_CELLS}, {_EXTENT}, bo AS (SELECT * FROM cl UNION ALL SELECT chr, j, i, r, p FROM cl),
    sm AS (SELECT chr, i, j, SUM(r) AS r, SUM(p) AS p FROM (SELECT chr, i + di AS i, j + dj AS j, r, p FROM bo CROSS JOIN (SELECT UNNEST(range(-{h}, {h + 1})) AS di)
      CROSS JOIN (SELECT UNNEST(range(-{h}, {h + 1})) AS dj)) WHERE j - i > {2 + h} AND j - i < {300 - h} GROUP BY chr, i, j),
    sd AS (SELECT sm.chr, i, j, r / a AS r, p / a AS p FROM (SELECT sm.*, (LEAST(i + {h}, hi) - GREATEST(i - {h}, 0) + 1) * (LEAST(j + {h}, hi) - GREATEST(j - {h}, 0) + 1) AS a
      FROM sm JOIN ex ON ex.chr = sm.chr WHERE i BETWEEN 0 AND hi AND j BETWEEN 0 AND hi) sm)"""


@query("v02_smoothing", f"WITH {_smooth_sql(2)} SELECT chr, i, j, ROUND(r, 6) AS real, ROUND(p, 6) AS pred FROM sd")
def v02(spark, sf):
    return rounded(V.smooth(A.predictions(spark, sf), A.BIN, 2), 6, "real", "pred")


def _scc_sql(cells: str) -> str:
    return f"""st AS (SELECT {cells}.chr, j - i AS d, corr(r, p) AS c, (2 * COUNT(*) + 1) / 12.0 AS w FROM {cells} JOIN ex ON ex.chr = {cells}.chr
      WHERE j - i <= hi - lo - 2 AND (r <> 0 OR p <> 0) GROUP BY {cells}.chr, j - i HAVING MIN(r) <> MAX(r) AND MIN(p) <> MAX(p))
    SELECT chr, ROUND(SUM(c * w) / SUM(w), 6) AS scc FROM st GROUP BY chr"""


@query("v03_scc", f"WITH {_smooth_sql(2)}, {_scc_sql('sd')}")
def v03(spark, sf):
    return rounded(V.scc(A.predictions(spark, sf), A.BIN, 2), 6, "scc")


@query("v03_scc_unsmoothed", f"WITH {_CELLS}, {_EXTENT}, {_scc_sql('cl')}")
def v03_plain(spark, sf):
    return rounded(V.scc(A.predictions(spark, sf), A.BIN, 0), 6, "scc")


_BAND_ERRORS = f"""WITH {_CELLS}, {_EXTENT}, k AS (SELECT chr, SUM(2 * GREATEST(hi - lo - 1 - d, 0)) AS k FROM ex CROSS JOIN (SELECT UNNEST(range(3, 301)) AS d) GROUP BY chr)
    SELECT cl.chr, ROUND(SQRT(2 * SUM((r - p) ** 2) / ANY_VALUE(k)), 9) AS rmse, ROUND(2 * SUM(ABS(r - p)) / ANY_VALUE(k), 9) AS mae,
    ROUND(SUM(ABS(r - p) / r) FILTER (r <> 0) / COUNT(*) FILTER (r <> 0), 9) AS mape FROM cl JOIN k ON k.chr = cl.chr GROUP BY cl.chr"""


@query("v04_band_errors", _BAND_ERRORS)
def v04(spark, sf):
    return rounded(V.band_errors(A.predictions(spark, sf), A.BIN), 9, "rmse", "mae", "mape")


_PE = """pe AS (SELECT DISTINCT p.chr, LEAST(p.b, e.b) AS i, GREATEST(p.b, e.b) AS j FROM (SELECT DISTINCT chr, TSS // 5000 AS b FROM a_genes) p
    JOIN (SELECT DISTINCT chr, mids // 5000 AS b FROM a_peaks) e ON e.chr = p.chr AND ABS(p.b - e.b) > 2 AND ABS(p.b - e.b) < {r})"""


def _promoters(spark, sf):
    return A.genes(spark, sf).select("chr", F.col("TSS").alias("position"))


def _enhancers(spark, sf):
    return A.peaks(spark, sf).select("chr", F.col("mids").alias("position"))


_PE_ERRORS = f"""{_PE.format(r=300)}, x AS (SELECT pe.chr, COALESCE(r, 0) AS r, COALESCE(p, 0) AS p FROM pe JOIN ex ON ex.chr = pe.chr AND pe.i >= lo AND pe.j + 1 < hi
      LEFT JOIN cl ON cl.chr = pe.chr AND cl.i = pe.i AND cl.j = pe.j)
    SELECT chr, ROUND(SQRT(SUM((r - p) ** 2) / COUNT(*)), 9) AS pe_rmse, ROUND(SUM(ABS(r - p)) / COUNT(*) FILTER (r <> 0 OR p <> 0), 9) AS pe_mae,
    ROUND(SUM(CASE WHEN r <> 0 THEN ABS(r - p) / r ELSE 0 END) / COUNT(*) FILTER (r <> 0 OR p <> 0), 9) AS pe_mape FROM x GROUP BY chr"""


@query("v05_promoter_enhancer_errors", f"WITH {_CELLS}, {_EXTENT}, {_PE_ERRORS}")
def v05(spark, sf):
    out = V.paired_errors(A.predictions(spark, sf), _promoters(spark, sf), _enhancers(spark, sf), A.BIN)
    return rounded(out, 9, "pe_rmse", "pe_mae", "pe_mape")


_ROWS = """rw AS (SELECT chr, row, SUM(r) AS x, SUM(p) AS y, SUM(r * p) AS xy, SUM(r * r) AS xx, SUM(p * p) AS yy FROM
      (SELECT chr, i AS row, r, p FROM cl UNION ALL SELECT chr, j, r, p FROM cl) GROUP BY chr, row)
    SELECT rw.chr, ROUND(AVG((n * xy - x * y) / SQRT((n * xx - x * x) * (n * yy - y * y))), 9) AS corr FROM rw
    JOIN (SELECT chr, hi + 1 AS n FROM ex) e ON e.chr = rw.chr WHERE n * xx - x * x > 0 AND n * yy - y * y > 0 GROUP BY rw.chr"""


@query("v06_mean_row_correlation", f"WITH {_CELLS}, {_EXTENT}, {_ROWS}")
def v06(spark, sf):
    return rounded(V.mean_row_correlation(A.predictions(spark, sf), A.BIN), 9, "corr")


def _search_sql(h: int) -> str:
    cells = f"WITH {_smooth_sql(h)} SELECT chr, i, j, r, p FROM sd" if h else f"WITH {_CELLS} SELECT chr, i, j, r, p FROM cl"
    return f"""m{h} AS (SELECT c.*, UNNEST([substr(md5(concat_ws('|', '1', chr, i, j)), 1, 13), substr(md5(concat_ws('|', '1', chr, i, j)), 14, 13)]) AS x FROM ({cells}) c WHERE r <> 0 OR p <> 0),
    o{h} AS (SELECT *, ('0x' || x)::BIGINT // 450359962737049 AS k FROM m{h}),
    s{h} AS (SELECT k, corr(r, p) AS c, (COUNT(*) + 1) / 12.0 AS w FROM o{h} WHERE k < 10 GROUP BY k, j - i HAVING MIN(r) <> MAX(r) AND MIN(p) <> MAX(p)),
    g{h} AS (SELECT {h} AS h, ROUND(AVG(scc), 4) AS mean_scc FROM (SELECT k, SUM(c * w) / SUM(w) AS scc FROM s{h} GROUP BY k))"""


@query(
    "v07_smoothing_search",
    f"""WITH {', '.join(_search_sql(h) for h in range(11))}, a AS ({' UNION ALL '.join(f'SELECT * FROM g{h}' for h in range(11))}),
    b AS (SELECT h, mean_scc, ROUND(mean_scc - LAG(mean_scc) OVER (ORDER BY h), 6) AS gain FROM a)
    SELECT h, mean_scc, gain, COALESCE(gain < 0.01, FALSE) AS stop FROM b WHERE h <= COALESCE((SELECT MIN(h) FROM b WHERE gain < 0.01), 10)""",
)
def v07(spark, sf):
    return rounded(V.smoothing_search(A.predictions(spark, sf), A.BIN), 6, "gain")


def _downsample_sql(cells: str, size: int) -> str:
    rows = "ROWS UNBOUNDED PRECEDING"
    point = lambda level: f"('0x' || substr(md5(concat_ws('|', '1', '{level}', id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""WITH c AS ({cells}),
    x AS (SELECT *, SUM(w) OVER (PARTITION BY chr, b ORDER BY contact_st, contact_en {rows}) AS hi, SUM(w) OVER (PARTITION BY chr, b) AS whole FROM c),
    bk AS (SELECT chr, b, MAX(hi) AS w FROM x GROUP BY chr, b), bl AS (SELECT *, SUM(w) OVER (PARTITION BY chr ORDER BY b {rows}) AS hi FROM bk),
    ch AS (SELECT chr, MAX(hi) AS w FROM bl GROUP BY chr), cl AS (SELECT *, SUM(w) OVER (ORDER BY chr {rows}) AS hi FROM ch),
    s1 AS (SELECT chr, (hi - w) / (SELECT MAX(hi) FROM cl) AS lo FROM cl), s2 AS (SELECT chr, b, (hi - w) / MAX(hi) OVER (PARTITION BY chr) AS lo FROM bl),
    s3 AS (SELECT chr, b, contact_st, contact_en, COALESCE(LAG(hi) OVER (PARTITION BY chr, b ORDER BY contact_st, contact_en), 0) / MAX(hi) OVER (PARTITION BY chr, b) AS lo FROM x),
    d AS (SELECT {point(1)} AS u1, {point(2)} AS u2, {point(3)} AS u3 FROM (SELECT UNNEST(range(0, {size})) AS id)),
    d1 AS (SELECT s1.chr, u2, u3 FROM d ASOF JOIN s1 ON d.u1 >= s1.lo), d2 AS (SELECT s2.chr, s2.b, u3 FROM d1 ASOF JOIN s2 ON d1.chr = s2.chr AND d1.u2 >= s2.lo)
    SELECT s3.chr, contact_st, contact_en, COUNT(*)::DOUBLE AS contact_count FROM d2 ASOF JOIN s3 ON d2.chr = s3.chr AND d2.b = s3.b AND d2.u3 >= s3.lo GROUP BY ALL"""


@query("v08_downsample", _downsample_sql("SELECT chr, contact_st, contact_en, contact_count AS w, contact_st // 262144 AS b FROM a_contacts", 50_000))
def v08(spark, sf):
    return V.downsample(A.contacts(spark, sf), 50_000)


@query("v08_downsample_normalized", _downsample_sql("SELECT chr, contact_st, contact_en, contact_count / 2585.0 AS w, contact_st // 262144 AS b FROM a_contacts", 20_000))
def v08_normalized(spark, sf):
    """Counts divided by a coefficient."""
    counts = A.contacts(spark, sf).withColumn("contact_count", F.col("contact_count") / 2585.0)
    return V.downsample(counts, 20_000)


@query(
    "v09_diagonal_tiles",
    """WITH e AS (SELECT chr, MIN(contact_st) AS lo, (MAX(contact_en) - MIN(contact_st)) // 5000 + 1 AS len FROM a_pred GROUP BY chr),
    t AS (SELECT chr, lo, UNNEST(range(0, len - 300, 150)) AS s FROM e),
    c AS (SELECT t.chr, s // 150 AS tile, (contact_st - lo) // 5000 - s AS i, (contact_en - lo) // 5000 - s AS j, contact_count, predicted FROM t
      JOIN a_pred p ON p.chr = t.chr AND (contact_st - lo) // 5000 >= s AND (contact_en - lo) // 5000 < s + 300)
    SELECT chr, tile, i AS row, j AS col, contact_count AS value FROM c WHERE i <> j UNION ALL SELECT chr, tile, j, i, predicted FROM c""",
)
def v09(spark, sf):
    return V.diagonal_tiles(A.predictions(spark, sf), A.BIN)


_ALL_MEASURES = {
    "corr": f"WITH {_CELLS}, {_EXTENT}, {_ROWS}",
    "scc": f"WITH {_smooth_sql(2)}, {_scc_sql('sd')}",
    "errors": _BAND_ERRORS,
    "pe": f"WITH {_CELLS}, {_EXTENT}, {_PE_ERRORS}",
}


@query("k05_metrics_row", f"SELECT * FROM {' JOIN '.join(f'({sql}) {n}' + (' USING (chr)' if i else '') for i, (n, sql) in enumerate(_ALL_MEASURES.items()))}")
def k05_row(spark, sf):
    row = V.metrics_row(A.predictions(spark, sf), A.BIN, 2, _promoters(spark, sf), _enhancers(spark, sf))
    row = rounded(row, 9, "corr", "rmse", "mae", "mape", "pe_rmse", "pe_mae", "pe_mape")
    return rounded(row, 6, "scc")


# ---- conditions -----------------------------------------------------------------------------------


def _pairs(spark, sf):
    def bins(df):
        return df.select("chr", F.floor(F.col("position") / A.BIN).alias("bin"))

    return D.promoter_enhancer_pairs(bins(_promoters(spark, sf)), bins(_enhancers(spark, sf)), 60)


@query("j12_promoter_enhancer_pairs", f"WITH {_PE.format(r=60)} SELECT * FROM pe")
def j12(spark, sf):
    return _pairs(spark, sf)


def _values(spark, sf):
    return A.conditions(spark, sf).select(
        "condition", "chr", F.floor(F.col("contact_st") / A.BIN).alias("i"), F.floor(F.col("contact_en") / A.BIN).alias("j"), F.col("contact_count").alias("value")
    )


def _pair_values(spark, sf, condition):
    return _values(spark, sf).filter(F.col("condition") == condition).drop("condition")


_GATHER = """SELECT c0.chr, c0.i, c0.j, c0.v AS v0, c1.v AS v1 FROM pe JOIN cd c0 ON c0.chr = pe.chr AND c0.i = pe.i AND c0.j = pe.j AND c0.condition = 0
    JOIN cd c1 ON c1.chr = pe.chr AND c1.i = pe.i AND c1.j = pe.j AND c1.condition = 1"""
_COND = "cd AS (SELECT condition, chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count AS v FROM a_cond)"


@query(
    "j13_gather_conditions",
    f"""WITH {_PE.format(r=60)}, {_COND}, g AS ({_GATHER}) SELECT chr, i, j, ROUND(log2(v0), 9) AS c0, ROUND(log2(v1), 9) AS c1, ROUND(log2(j - i), 9) AS distance
    FROM g WHERE v0 <> 0 AND v1 <> 0""",
)
def j13(spark, sf):
    return rounded(D.gather_conditions(_pairs(spark, sf), _values(spark, sf), [0, 1]), 9, "c0", "c1", "distance")


_COARSE = 50_000
_SIX = f"""pe AS (SELECT DISTINCT p.chr, LEAST(p.b, e.b) AS i, GREATEST(p.b, e.b) AS j FROM (SELECT DISTINCT chr, TSS // {_COARSE} AS b FROM a_genes) p
      JOIN (SELECT DISTINCT chr, mids // {_COARSE} AS b FROM a_peaks) e ON e.chr = p.chr AND ABS(p.b - e.b) > 2 AND ABS(p.b - e.b) < 60),
    cd AS (SELECT condition, chr, contact_st // {_COARSE} AS i, contact_en // {_COARSE} AS j, SUM(contact_count) AS v FROM a_cond GROUP BY ALL)
    SELECT chr, i, j, {', '.join(f'ROUND(log2(SUM(v) FILTER (condition = {c})), 9) AS c{c}' for c in range(6))}, ROUND(log2(j - i), 9) AS distance
    FROM pe JOIN cd USING (chr, i, j) GROUP BY chr, i, j HAVING COUNT(DISTINCT condition) FILTER (v <> 0) = 6"""


@query("j13_gather_six_conditions", f"WITH {_SIX}")
def j13_six(spark, sf):
    """All six conditions, on bins of 50 kb so that pairs are present in each."""

    def bins(df):
        return df.select("chr", F.floor(F.col("position") / _COARSE).alias("bin"))

    pairs = D.promoter_enhancer_pairs(bins(_promoters(spark, sf)), bins(_enhancers(spark, sf)), 60)
    cells = A.conditions(spark, sf).select(
        "condition", "chr", F.floor(F.col("contact_st") / _COARSE).alias("i"), F.floor(F.col("contact_en") / _COARSE).alias("j"), F.col("contact_count").alias("value")
    )
    return rounded(D.gather_conditions(pairs, cells, list(range(6))), 9, *[f"c{c}" for c in range(6)], "distance")


_WTMUT = """wa AS (SELECT chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count AS v FROM a_wt),
    mu AS (SELECT chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count AS v FROM a_mut),
    lr AS (SELECT wa.chr, wa.i, wa.j, ABS(log2(wa.v) - log2(mu.v)) AS d FROM wa JOIN mu ON mu.chr = wa.chr AND mu.i = wa.i AND mu.j = wa.j WHERE wa.v > 0 AND mu.v > 0),
    ce AS (SELECT DISTINCT chr, UNNEST([i, j]) AS k FROM (SELECT chr, i, j FROM wa UNION ALL SELECT chr, i, j FROM mu))"""


def _two(spark, sf):
    def pairs(df):
        return df.select(
            "chr", F.floor(F.col("contact_st") / A.BIN).alias("i"), F.floor(F.col("contact_en") / A.BIN).alias("j"), F.col("contact_count").alias("value")
        )

    return pairs(A.wild_type(spark, sf)), pairs(A.mutant(spark, sf))


@query("a14_log_ratio_distance", f"WITH {_WTMUT} SELECT ROUND(COALESCE(AVG(d), 0), 9) AS distance, COUNT(*) AS n_cells FROM lr")
def a14(spark, sf):
    return rounded(D.log_ratio_distance(*_two(spark, sf)), 9, "distance")


_TRACK = "SELECT ce.chr, ce.k * 5000 AS start, ce.k * 5000 + 5000 AS \"end\", ROUND(COALESCE(AVG(d), 0), 5) AS metric FROM ce LEFT JOIN {cells} x ON x.chr = ce.chr AND {hit} GROUP BY ce.chr, ce.k"


@query("a15_triangle_track", f"WITH {_WTMUT} {_TRACK.format(cells='lr', hit='x.i >= ce.k - 10 AND x.j <= ce.k + 10')}")
def a15(spark, sf):
    return D.triangle_track(*_two(spark, sf), 10, A.BIN)


@query(
    "a16_strip_track",
    f"""WITH {_WTMUT}, hv AS (SELECT chr, d, j AS lo, j + 10 AS hi FROM lr WHERE j - i <= 15 UNION ALL SELECT chr, d, i - 10, i FROM lr WHERE j - i <= 15)
    {_TRACK.format(cells='hv', hit='ce.k BETWEEN x.lo AND x.hi')}""",
)
def a16(spark, sf):
    return D.strip_track(*_two(spark, sf), 10, 15, A.BIN)


_DELTAS = f"""cd AS (SELECT condition, chr, contact_st, SUM(contact_count) AS v FROM a_cond GROUP BY ALL),
    wd AS (SELECT chr, contact_st, MAX(v) FILTER (condition = 0) AS a, MAX(v) FILTER (condition = 1) AS b, MAX(v) FILTER (condition = 2) AS c,
      MAX(v) FILTER (condition = 3) AS d FROM cd GROUP BY chr, contact_st),
    dl AS (SELECT UNNEST(['conditions', 'model', 'replicates']) AS comparison, UNNEST([ABS(log2(b) - log2(a)), ABS(log2(c) - log2(a)), ABS(log2(d) - log2(c))]) AS delta
      FROM wd WHERE a > 0 AND b > 0 AND c > 0 AND d > 0 AND ABS(log2(b) - log2(a)) > 0.5 AND ABS(log2(d) - log2(c)) < 1)"""


def _deltas(spark, sf):
    by_start = A.conditions(spark, sf).groupBy("chr", "contact_st").pivot("condition", [0, 1, 2, 3]).agg(F.sum("contact_count"))
    wide = by_start.na.drop().select("chr", "contact_st", *[F.log2(str(k)).alias(f"c{k}") for k in range(4)])
    kept = wide.filter(F.abs(F.col("c1") - F.col("c0")) > 0.5)
    comparisons = {"conditions": ("c0", "c1"), "model": ("c0", "c2"), "replicates": ("c2", "c3")}
    return D.differential_pairs(kept, ("c0", "c1"), ("c2", "c3"), comparisons, 0.5), kept, comparisons


@query(
    "a17_differential_medians",
    f"""WITH {_DELTAS.replace('< 1)', '< 0.5)')} SELECT comparison, ROUND(quantile_cont(delta, 0.5), 9) AS median, COUNT(*) AS n FROM dl GROUP BY comparison""",
)
def a17(spark, sf):
    return rounded(D.medians(_deltas(spark, sf)[0]), 9, "median")


@query(
    "a17_mann_whitney",
    f"""WITH {_DELTAS.replace('< 1)', '< 0.5)')}, pr AS (SELECT * FROM (VALUES ('conditions', 'model'), ('conditions', 'replicates'), ('model', 'replicates')) v(x, y)),
    un AS (SELECT x, y, comparison, ROUND(delta, 9) AS delta FROM pr JOIN dl ON comparison IN (x, y)),
    rk AS (SELECT *, RANK() OVER (PARTITION BY x, y ORDER BY delta) + (COUNT(*) OVER (PARTITION BY x, y, delta) - 1) / 2.0 AS r FROM un)
    SELECT x, y, COUNT(*) FILTER (comparison = x) AS n_x, COUNT(*) FILTER (comparison = y) AS n_y,
    SUM(r) FILTER (comparison = x) - COUNT(*) FILTER (comparison = x) * (COUNT(*) FILTER (comparison = x) + 1) / 2.0 AS u FROM rk GROUP BY x, y""",
)
def a17_u(spark, sf):
    deltas = _deltas(spark, sf)[0].withColumn("delta", F.round("delta", 9))
    tests = [("conditions", "model"), ("conditions", "replicates"), ("model", "replicates")]
    return D.mann_whitney(deltas, tests).drop("z")


# ---- sequence and signal ----------------------------------------------------------------------------


@query(
    "s18_sequence_regions",
    """SELECT chr, contact_st AS start, contact_st + 120 AS "end", substr(seq, contact_st + 1, 120) AS seq FROM a_seq_contacts JOIN a_seq USING (chr)
    WHERE length(seq) > contact_st""",
)
def s18_regions(spark, sf):
    regions = A.sequence_contacts(spark, sf).select("chr", F.col("contact_st").alias("start"), (F.col("contact_st") + 120).alias("end"))
    return Q.sequence_regions(Q.split_blocks(A.sequences(spark, sf)), regions)


@query(
    "s19_clip_runs",
    """SELECT l.id, l.chr, GREATEST(l.x1 + 300, r.start) AS start, LEAST(l.y2 - 300, r."end") AS "end", r.value FROM a_loops l
    JOIN a_runs r ON r.chr = l.chr AND r.start < l.y2 - 300 AND r."end" > l.x1 + 300""",
)
def s19_clip(spark, sf):
    regions = A.loops(spark, sf).select("chr", (F.col("x1") + 300).alias("start"), (F.col("y2") - 300).alias("end"), "id")
    return Q.clip_runs(A.runs(spark, sf), regions)


def _anchor_codes_sql(length: int, distance: int) -> str:
    columns = []
    for side, at in (("left", "contact_st"), ("right", "contact_en")):
        for i in range(length):
            inside = f"{at} >= {distance} AND length(seq) >= {at} - {distance} + {length}"
            columns.append(f"CASE WHEN {inside} THEN strpos('atgcn', substr(seq, {at} - {distance} + {i + 1}, 1)) - 1 END AS {side}{i + 1}")
    return f"SELECT chr, contact_st, contact_en, {', '.join(columns)} FROM a_seq_contacts JOIN a_seq USING (chr)"


@query("f13_anchor_sequence", _anchor_codes_sql(20, 5))
def f13(spark, sf):
    contacts = A.sequence_contacts(spark, sf).withColumn("dist", F.col("contact_en") - F.col("contact_st"))
    family = Q.AnchorSequence(Q.split_blocks(A.sequences(spark, sf)), 10, 5, wide=True)
    return X.compute(contacts, [family]).drop("dist")


def _stretch_sql(at: str, side: str) -> str:
    inside = f"{at} >= 20 AND length(seq) >= {at} + 220"
    return f"""CASE WHEN {inside} THEN translate(substr(seq, {at} - 19, 240), 'atgcn', '01234') END AS "{side}\""""


@query(
    "f13_anchor_sequence_arrays",
    f"SELECT chr, contact_st, contact_en, {_stretch_sql('contact_st', 'left')}, {_stretch_sql('contact_en', 'right')} FROM a_seq_contacts JOIN a_seq USING (chr)",
)
def f13_arrays(spark, sf):
    contacts = A.sequence_contacts(spark, sf).withColumn("dist", F.col("contact_en") - F.col("contact_st"))
    family = Q.AnchorSequence(Q.split_blocks(A.sequences(spark, sf)), 200, 20)
    table = X.compute(contacts, [family])
    return table.select(*X.KEY, *[F.array_join(f"SequencePredictor_{side}", "").alias(side) for side in ("left", "right")])
