"""Queries: contact features, one family at a time and assembled."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.operators import contacts as C
from contactloom.operators import features as X
from contactloom.operators import tracks as T
from contactloom.plans import adapters as A
from contactloom.plans.q_tracks import LOOP_HIT, boundary_sql, oriented
from contactloom.plans.registry import query
from contactloom.session import cut_lineage

W, H = A.WINDOW, A.WINDOW // 2
BASE = f"fc AS (SELECT chr, contact_st, contact_en, dist, contact_count FROM a_contacts WHERE dist BETWEEN {A.MIN_DIST} AND {A.MAX_DIST})"
KEYS = "c.chr, c.contact_st, c.contact_en"


def base(spark, sf):
    return C.within_distance(A.contacts(spark, sf), A.MIN_DIST, A.MAX_DIST)


def only_oriented(spark, sf):
    return T.keep_oriented(cut_lineage(oriented(spark, sf)))


def family_rows(spark, sf, family, rounded=()):
    keyed = base(spark, sf).select(*X.KEY, "dist")
    out = X.compute(keyed, [family]).drop("dist")
    return out.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in rounded else F.col(f"`{c}`") for c in out.columns])


# ---- SQL building blocks --------------------------------------------------------------------------


def ranked_sql(p: str, track: str, fields) -> str:
    item = ", ".join(f"{f} := {f}" for f in fields)
    return f"""{p}_r AS (SELECT chr, mids, struct_pack({item}) AS item, ROW_NUMBER() OVER (PARTITION BY chr ORDER BY mids, start, "end") AS rn
      FROM {track}), {p}_k AS (SELECT chr, mids, MAX(rn) AS rn FROM {p}_r GROUP BY chr, mids)"""


def near_sql(p: str, name: str, point: str, side: str, n: int) -> str:
    """CTE ``name`` (chr, p, l): n nearest items strictly left or right of every distinct ``point``."""
    test = "d.p > k.mids" if side == "left" else "d.p >= k.mids"
    ranks = f"q.k - {n - 1} AND q.k" if side == "left" else f"q.k + 1 AND q.k + {n}"
    return f"""{name} AS (SELECT q.chr, q.p, LIST(r.item ORDER BY r.rn) AS l FROM (SELECT d.chr, d.p, COALESCE(k.rn, 0) AS k
      FROM (SELECT DISTINCT chr, {point} AS p FROM fc) d ASOF LEFT JOIN {p}_k k ON k.chr = d.chr AND {test}) q
      JOIN {p}_r r ON r.chr = q.chr AND r.rn BETWEEN {ranks} GROUP BY q.chr, q.p)"""


def item_sql(alias: str, i: int, field: str, pad: str) -> str:
    return f"CASE WHEN {i} < COALESCE(len({alias}.l), 0) THEN {alias}.l[{i + 1}].{field} ELSE {pad} END"


def right_pad_mid(alias: str, point: str) -> str:
    return f"CASE WHEN COALESCE(len({alias}.l), 0) = 0 THEN {point} + 1 ELSE {alias}.l[-1].mids END"


def peak_sums_sql(name: str, track: str, n: int, overlap: bool = False) -> str:
    def total(lo: str, hi: str) -> str:
        hit = f't.start <= {hi} AND t."end" >= {lo}' if overlap else f"t.mids BETWEEN {lo} AND {hi}"
        return f"CAST(COALESCE(SUM(CAST(t.sigVal AS DECIMAL(18,2))) FILTER ({hit}), 0) AS DOUBLE)"

    inside = f't.start <= c.contact_en + {H} AND t."end" >= c.contact_st - {H}' if overlap else f"t.mids BETWEEN c.contact_st - {H} AND c.contact_en + {H}"
    cols = []
    for i in range(n):
        cols.append(f'CAST({item_sql("a", i, "sigVal", "0")} AS DOUBLE) AS "{name}_LSig_{i}"')
        cols.append(f'c.contact_st - {item_sql("a", i, "mids", "0")} AS "{name}_LDist_{i}"')
        cols.append(f'CAST({item_sql("b", i, "sigVal", "0")} AS DOUBLE) AS "{name}_RSig_{i}"')
        cols.append(f'{item_sql("b", i, "mids", right_pad_mid("b", f"c.contact_en + {H}"))} - c.contact_en AS "{name}_RDist_{i}"')
    return f"""WITH {BASE}, {ranked_sql('r', track, ('mids', 'sigVal'))}, {near_sql('r', 'nl', f'contact_st - {H}', 'left', n)},
    {near_sql('r', 'nr', f'contact_en + {H}', 'right', n)},
    s AS (SELECT c.chr, c.contact_st, c.contact_en, {total(f'c.contact_st - {H}', f'c.contact_st + {H}')} AS l,
      {total(f'c.contact_st + {H}', f'c.contact_en - {H}')} AS w, {total(f'c.contact_en - {H}', f'c.contact_en + {H}')} AS r
      FROM fc c LEFT JOIN {track} t ON t.chr = c.chr AND {inside} GROUP BY c.chr, c.contact_st, c.contact_en)
    SELECT {KEYS}, s.l AS "{name}_L", s.w AS "{name}_W", s.r AS "{name}_R", {', '.join(cols)}
    FROM fc c JOIN s USING (chr, contact_st, contact_en) LEFT JOIN nl a ON a.chr = c.chr AND a.p = c.contact_st - {H}
    LEFT JOIN nr b ON b.chr = c.chr AND b.p = c.contact_en + {H}"""


def sites_sql(name: str, track: str, n: int, labels, words, totals: bool) -> str:
    """Both site families: neighbours outside, boundary items inside, optionally totals over the window."""
    fields = ("mids", "sigVal", "plus_orientation", "minus_orientation")
    cols = []

    def block(label, element, distance):
        for i in range(n):
            cols.append(f'CAST({element(i, "plus_orientation")} AS DOUBLE) AS "{name}_{label}_{words[0]}_{i}"')
            cols.append(f'CAST({element(i, "minus_orientation")} AS DOUBLE) AS "{name}_{label}_{words[1]}_{i}"')
            cols.append(f'CAST({element(i, "sigVal")} AS DOUBLE) AS "{name}_{label}_sigVal_{i}"')
            cols.append(f'{distance(element(i, "mids"))} AS "{name}_{label}_dist_{i}"')

    block(labels[0], lambda i, f: item_sql("a", i, f, "0"), lambda m: f"c.contact_st - ({m})")
    block(labels[1], lambda i, f: f"w.first_l[{i + 1}].{f}", lambda m: f"{m} - c.contact_st")
    block(labels[2], lambda i, f: f"w.last_l[{i + 1}].{f}", lambda m: f"c.contact_en - {m}")
    block(
        labels[3],
        lambda i, f: item_sql("b", i, f, right_pad_mid("b", "c.contact_en") if f == "mids" else "0"),
        lambda m: f"{m} - c.contact_en",
    )
    if totals:
        cols += [
            f'CAST(COALESCE(list_sum(list_transform(x.l, lambda z: CAST(z.sigVal AS DECIMAL(18,2)))), 0) AS DOUBLE) AS "{name}_W_sumSigVal"',
            f'len(list_filter(COALESCE(x.l, []), lambda z: z.plus_orientation <> 0)) AS "{name}_W_N+orient"',
            f'len(list_filter(COALESCE(x.l, []), lambda z: z.minus_orientation <> 0)) AS "{name}_W_N-orient"',
        ]
    return f"""WITH {BASE}, {ranked_sql('r', track, fields)}, {near_sql('r', 'nl', 'contact_st', 'left', n)}, {near_sql('r', 'nr', 'contact_en', 'right', n)},
    q AS (SELECT chr || ':' || contact_st || ':' || contact_en AS id, chr, contact_st AS s, contact_en AS e FROM fc),
    {boundary_sql('q', track, n, fields)}
    SELECT {KEYS}, {', '.join(cols)} FROM fc c JOIN lists w ON w.id = c.chr || ':' || c.contact_st || ':' || c.contact_en JOIN inw x ON x.id = w.id
    LEFT JOIN nl a ON a.chr = c.chr AND a.p = c.contact_st LEFT JOIN nr b ON b.chr = c.chr AND b.p = c.contact_en"""


# ---- families -------------------------------------------------------------------------------------


@query(
    "f01_window_frame",
    f"""SELECT chr, contact_st, contact_en, win_st, win_st + 300000 AS win_en, contact_st - win_st AS win_rel_st, contact_en - win_st AS win_rel_en
    FROM (SELECT *, GREATEST(0, contact_st - (300000 - dist) // 2) AS win_st FROM a_contacts)""",
)
def f01(spark, sf):
    return X.window_frame(A.contacts(spark, sf), 300_000).drop("contact_count", "dist")


@query(
    "f02_anchor_frames",
    f"""SELECT chr, contact_st, contact_en, contact_st - {H} AS "L_st", contact_st + {H} AS "L_en", contact_st + {H} AS "M_st",
    contact_en - {H} AS "M_en", contact_en - {H} AS "R_st", contact_en + {H} AS "R_en" FROM a_contacts WHERE dist > {H}""",
)
def f02(spark, sf):
    return X.anchor_frames(A.contacts(spark, sf), W).drop("contact_count", "dist")


def _bins_sql(name: str, size: int, n: int, value: str) -> str:
    frame = f"""(SELECT *, GREATEST(0, contact_st - ({size} - dist) // 2) AS ws FROM fc)"""
    bins = ", ".join(f'MAX(v) FILTER (i = {i}) AS "{name}_bin{i}"' for i in range(n))
    return f"""WITH {BASE}, f AS {frame}, s AS (SELECT DISTINCT chr, ws FROM f), x AS (SELECT chr, ws, UNNEST(range(0, {n})) AS i FROM s),
    v AS ({value}), p AS (SELECT chr, ws, {bins} FROM v GROUP BY chr, ws)
    SELECT f.chr, contact_st, contact_en, f.ws AS "{name}win_st", f.ws + {size} AS "{name}win_en", contact_st - f.ws AS "{name}win_rel_st",
    contact_en - f.ws AS "{name}win_rel_en", p.* EXCLUDE (chr, ws) FROM f JOIN p ON p.chr = f.chr AND p.ws = f.ws"""


@query(
    "f03_chipseq_binned",
    _bins_sql(
        "CTCF",
        300_000,
        12,
        """SELECT x.chr, ws, i, CAST(COALESCE(SUM(CAST(t.sigVal AS DECIMAL(18,2))), 0) AS DOUBLE) AS v FROM x
        LEFT JOIN a_peaks t ON t.chr = x.chr AND t.mids BETWEEN ws + i * 25000 AND ws + i * 25000 + 25000 GROUP BY x.chr, ws, i""",
    ),
)
def f03(spark, sf):
    return family_rows(spark, sf, X.PeakBins(A.peaks(spark, sf), "CTCF", 300_000, 25_000))


F04_SQL = peak_sums_sql("CTCF", "a_peaks", 4)


@query("f04_chipseq_small", F04_SQL)
def f04(spark, sf):
    return family_rows(spark, sf, X.PeakSums(A.peaks(spark, sf), "CTCF", W, 4))


_EVENT_TRACKS = ["click", "error", "purchase", "signup", "view"]
_EVENT_SQL = [peak_sums_sql(t, f"(SELECT * FROM a_peaks WHERE event_type = '{t}')", 2) for t in _EVENT_TRACKS]


@query(
    "f04_many_tracks",
    "SELECT * FROM " + " JOIN ".join(f"({sql}) {t}_{' USING (chr, contact_st, contact_en)' if i else ''}" for i, (t, sql) in enumerate(zip(_EVENT_TRACKS, _EVENT_SQL))),
)
def f04_tracks(spark, sf):
    """One search for all tracks of a table."""
    tracks = A.peaks(spark, sf).withColumn("track", F.col("event_type"))
    return family_rows(spark, sf, X.TrackSums(tracks, _EVENT_TRACKS, W, 2))


F04G_SQL = peak_sums_sql("RNA", "a_genes", 3, overlap=True)


@query("f04_gene_small", F04G_SQL)
def f04_genes(spark, sf):
    return family_rows(spark, sf, X.GeneSums(A.genes(spark, sf), "RNA", W, 3))


@query(
    "f05_eigenvector_binned",
    _bins_sql(
        "E1",
        320_000,
        8,
        """SELECT x.chr, ws, i, COALESCE(t."E1", 0) AS v FROM x LEFT JOIN a_e1 t ON t.chr = x.chr AND t.bin = ws // 40000 + i""",
    ),
)
def f05(spark, sf):
    return family_rows(spark, sf, X.EigenvectorBins(A.eigenvector(spark, sf), 320_000, A.E1_BIN))


F06_SQL = f"""WITH {BASE}, m AS (SELECT *, (contact_st + {H}) // 40000 AS f, GREATEST((contact_en - contact_st - 2 * {H}) // 40000, 1) AS n FROM fc),
    x AS (SELECT chr, contact_st, contact_en, f + UNNEST(range(0, n)) AS bin FROM m),
    y AS (SELECT x.*, COALESCE(t."E1", 0) AS v FROM x LEFT JOIN a_e1 t ON t.chr = x.chr AND t.bin = x.bin),
    z AS (SELECT *, LAG(v) OVER (PARTITION BY chr, contact_st, contact_en ORDER BY bin) AS pv FROM y),
    g AS (SELECT chr, contact_st, contact_en, COUNT(*) FILTER (pv IS NOT NULL AND sign(pv) <> sign(v)) AS ch, STDDEV_POP(v) AS sd FROM z GROUP BY ALL)
    SELECT {KEYS}, COALESCE(l."E1", 0) AS "E1_L", COALESCE(r."E1", 0) AS "E1_R", g.ch AS "E1_N_Changes", ROUND(g.sd, 6) AS "E1_SD"
    FROM fc c JOIN g USING (chr, contact_st, contact_en)
    LEFT JOIN a_e1 l ON l.chr = c.chr AND l.bin = CAST(floor((c.contact_st - {H}) / 40000) AS BIGINT)
    LEFT JOIN a_e1 r ON r.chr = c.chr AND r.bin = CAST(floor((c.contact_en - {H}) / 40000) AS BIGINT)"""


@query("f06_eigenvector_small", F06_SQL)
def f06(spark, sf):
    return family_rows(spark, sf, X.EigenvectorSummary(A.eigenvector(spark, sf), W, A.E1_BIN), ["E1_SD"])


F07_SQL = sites_sql("CTCF_SitesOrient", "a_oriented", 4, ("L", "W_L", "W_R", "R"), ("plus_orientation", "minus_orientation"), True)


@query("f07_site_orientation", F07_SQL)
def f07(spark, sf):
    return family_rows(spark, sf, X.SiteOrientation(cut_lineage(oriented(spark, sf)), "CTCF", 4))


F08_SQL = f"""WITH {BASE}, o AS (SELECT *, LEAD(minus_orientation) OVER w AS nm, LEAD(mids) OVER w AS nx FROM a_only_oriented
      WINDOW w AS (PARTITION BY chr ORDER BY mids, start, "end")),
    b AS (SELECT c.chr, c.contact_st, c.contact_en, COUNT(o.mids) AS n FROM fc c LEFT JOIN o ON o.chr = c.chr AND o.plus_orientation <> 0
      AND o.nm <> 0 AND o.mids >= c.contact_st + {H} AND o.nx <= c.contact_en - {H} GROUP BY c.chr, c.contact_st, c.contact_en),
    a AS (SELECT d.chr, d.p, COALESCE(SUM(plus_orientation), 0) AS plus, COALESCE(SUM(minus_orientation), 0) AS minus
      FROM (SELECT chr, contact_st AS p FROM fc UNION SELECT chr, contact_en FROM fc) d LEFT JOIN a_only_oriented t
      ON t.chr = d.chr AND t.mids BETWEEN d.p - {H} AND d.p + {H} GROUP BY d.chr, d.p)
    SELECT {KEYS}, b.n AS "CTCF_OrientBlock_W_NBlocks", CAST(s.plus * e.minus AS DOUBLE) AS "CTCF_OrientBlock_HasDivergOrient"
    FROM fc c JOIN b USING (chr, contact_st, contact_en) JOIN a s ON s.chr = c.chr AND s.p = c.contact_st
    JOIN a e ON e.chr = c.chr AND e.p = c.contact_en"""


@query("f08_orientation_blocks", F08_SQL)
def f08(spark, sf):
    return family_rows(spark, sf, X.OrientationBlocks(only_oriented(spark, sf), "CTCF", W))


def _convergent_sql(end_strand: str) -> str:
    fields = ("mids", "minus_orientation", "plus_orientation")

    def hit(alias, anchor, strand):
        return f"COALESCE(ABS({alias}.l[1].mids - {anchor}) <= 10000 AND {alias}.l[1].{strand} <> 0, FALSE)"

    return f"""WITH {BASE}, {ranked_sql('r', 'a_only_oriented', fields)}, {near_sql('r', 'sl', 'contact_st', 'left', 1)}, {near_sql('r', 'sr', 'contact_st', 'right', 1)},
    {near_sql('r', 'el', 'contact_en', 'left', 1)}, {near_sql('r', 'er', 'contact_en', 'right', 1)}
    SELECT {KEYS}, CASE WHEN ({hit('sl', 'c.contact_st', 'minus_orientation')} OR {hit('sr', 'c.contact_st', 'minus_orientation')})
      AND ({hit('el', 'c.contact_en', end_strand)} OR {hit('er', 'c.contact_en', end_strand)}) THEN 1 ELSE 0 END AS "CTCF_ConvergentPair_HasConvergentPair"
    FROM fc c LEFT JOIN sl ON sl.chr = c.chr AND sl.p = c.contact_st LEFT JOIN sr ON sr.chr = c.chr AND sr.p = c.contact_st
    LEFT JOIN el ON el.chr = c.chr AND el.p = c.contact_en LEFT JOIN er ON er.chr = c.chr AND er.p = c.contact_en"""


F09_SQL = _convergent_sql("minus_orientation")


@query("f09_convergent_pair", F09_SQL)
def f09(spark, sf):
    return family_rows(spark, sf, X.ConvergentPair(only_oriented(spark, sf), "CTCF", A.BIN))


@query("f09_convergent_pair_strict", _convergent_sql("plus_orientation"))
def f09_strict(spark, sf):
    return family_rows(spark, sf, X.ConvergentPair(only_oriented(spark, sf), "CTCF", A.BIN, strict_convergent=True))


F10_SQL = sites_sql("CTCF_OnlyOrient", "a_only_oriented", 4, ("start_L", "start_R", "end_L", "end_R"), ("+_orient", "-_orient"), False)


@query("f10_only_oriented_sites", F10_SQL)
def f10(spark, sf):
    return family_rows(spark, sf, X.OnlyOrientedSites(only_oriented(spark, sf), "CTCF", 4))


F11_SQL = f"""WITH {BASE}, {ranked_sql('r', 'a_genes', ('mids', 'TSS'))}, {near_sql('r', 'sl', 'contact_st', 'left', 1)}, {near_sql('r', 'sr', 'contact_st', 'right', 1)},
    {near_sql('r', 'el', 'contact_en', 'left', 1)}, {near_sql('r', 'er', 'contact_en', 'right', 1)}
    SELECT {KEYS}, c.contact_st - sl.l[1].TSS AS "_Distance_toTSS_start_L", sr.l[1].TSS - c.contact_st AS "_Distance_toTSS_start_R",
    c.contact_en - el.l[1].TSS AS "_Distance_toTSS_end_L", er.l[1].TSS - c.contact_en AS "_Distance_toTSS_end_R"
    FROM fc c LEFT JOIN sl ON sl.chr = c.chr AND sl.p = c.contact_st LEFT JOIN sr ON sr.chr = c.chr AND sr.p = c.contact_st
    LEFT JOIN el ON el.chr = c.chr AND el.p = c.contact_en LEFT JOIN er ON er.chr = c.chr AND er.p = c.contact_en"""


@query("f11_distance_to_tss", F11_SQL)
def f11(spark, sf):
    return family_rows(spark, sf, X.DistanceToTss(A.genes(spark, sf)))


F12_SQL = f"""WITH {BASE} SELECT {KEYS}, CASE WHEN EXISTS (SELECT 1 FROM a_loops l WHERE {LOOP_HIT}) THEN 1 ELSE 0 END AS "IsLoop" FROM fc c"""


@query("f12_is_loop", F12_SQL)
def f12(spark, sf):
    return family_rows(spark, sf, X.LoopFlag(A.loops(spark, sf), W))


def families(spark, sf):
    """The feature list of a full run."""
    peaks, genes = A.peaks(spark, sf), A.genes(spark, sf)
    with_strand = cut_lineage(oriented(spark, sf))
    one_strand = T.keep_oriented(with_strand)
    return [
        X.SiteOrientation(with_strand, "CTCF", 4),
        X.PeakSums(peaks, "CTCF", W, 4),
        X.OrientationBlocks(one_strand, "CTCF", W),
        X.GeneSums(genes, "RNA", W, 3),
        X.ConvergentPair(one_strand, "CTCF", A.BIN),
        X.DistanceToTss(genes),
        X.EigenvectorSummary(A.eigenvector(spark, sf), W, A.E1_BIN),
        X.LoopFlag(A.loops(spark, sf), W),
    ]


_PARTS = {"f07": F07_SQL, "f04": F04_SQL, "f08": F08_SQL, "f04g": F04G_SQL, "f09": F09_SQL, "f11": F11_SQL, "f06": F06_SQL, "f12": F12_SQL}
F14_SQL = f"""WITH {BASE} SELECT c.chr, c.contact_st, c.contact_en, c.dist AS contact_dist, c.contact_count,
    {', '.join(f'{p}.* EXCLUDE (chr, contact_st, contact_en)' for p in _PARTS)} FROM fc c
    {' '.join(f'JOIN ({sql}) {p} ON {p}.chr = c.chr AND {p}.contact_st = c.contact_st AND {p}.contact_en = c.contact_en' for p, sql in _PARTS.items())}"""


@query("f14_assemble_features", F14_SQL)
def f14(spark, sf):
    table = X.assemble(base(spark, sf), families(spark, sf))
    return table.withColumn("E1_SD", F.round("E1_SD", 6))
