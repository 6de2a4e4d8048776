"""Queries: tables written by the sinks and read back by the readers."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from contactloom.operators import sequence as Q
from contactloom.operators import stats as V
from contactloom.operators.tracks import orient_peaks
from contactloom.plans import adapters as A
from contactloom.plans.parameters import RunParameters
from contactloom.plans.q_features import base
from contactloom.plans.q_stats import _sizes
from contactloom.plans.q_tracks import oriented
from contactloom.plans.registry import query
from contactloom.session import scratch_path
from contactloom.sources import readers as S
from contactloom.sources import writers as K


def write_lines(df, path, group, order):
    """Ordered text lines (column ``value``), one file per value of ``group``."""
    named = df.withColumnRenamed(group, "file")
    named.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.partitionBy("file").text(path)


def _coefficient_file(spark):
    path = scratch_path(spark, "coefficient")
    spark.range(1).selectExpr("'K562' AS cell_type", "2585 AS coeff", "2542 AS median", "419 AS std").coalesce(1).write.csv(path, sep="\t", header=True)
    return path


@query(
    "s01_read_contacts",
    "SELECT chr, contact_st, contact_en, ROUND(contact_count / 2585, 9) AS contact_count, dist FROM a_contacts",
)
def s01(spark, sf):
    path = scratch_path(spark, "contacts")
    K.write_contacts(A.contacts(spark, sf), path, "5000.contacts")
    read = S.read_contacts(spark, path, S.read_norm_coefficient(spark, _coefficient_file(spark)))
    return read.withColumn("contact_count", F.round("contact_count", 9))


@query("s02_read_contacts_multi", "SELECT * FROM a_contacts WHERE contact_count % 5 <> 0")
def s02(spark, sf):
    path = scratch_path(spark, "oe")
    holes = A.contacts(spark, sf).withColumn("contact_count", F.expr("nullif(contact_count, floor(contact_count / 5) * 5)"))
    K.write_contacts(holes, path, "5000.oe")
    return S.read_contacts(spark, [f"{path}/*"], S.read_norm_coefficient(spark, _coefficient_file(spark)))


def _write_peaks(spark, sf, path, track=None):
    peaks = A.peaks(spark, sf) if track is None else track
    full = peaks.select(
        "chr", "start", "end", F.concat(F.lit("peak"), "event_id").alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), "sigVal"
    )
    full.unionByName(full).write.option("compression", "gzip").csv(path, sep="\t")


@query(
    "s03_read_peaks",
    """SELECT DISTINCT chr, start, "end", sigVal, mids, CAST(0 AS DOUBLE) AS plus_orientation, CAST(0 AS DOUBLE) AS minus_orientation FROM a_peaks""",
)
def s03(spark, sf):
    path = scratch_path(spark, "peaks")
    _write_peaks(spark, sf, path)
    return S.read_peaks(spark, path)


def _write_motifs(spark, sf, path):
    motifs = A.motifs(spark, sf)
    motifs.select("chr", "start", "end", F.lit("ctcf").alias("name"), "score", "orientation").write.csv(path, sep="\t")


@query("s05_read_orientation", 'SELECT DISTINCT chr, start, "end", CAST(score AS DOUBLE) AS score, orientation FROM a_motifs')
def s05(spark, sf):
    path = scratch_path(spark, "motifs")
    _write_motifs(spark, sf, path)
    return S.read_orientation(spark, path)


@query("s06_read_genes", 'SELECT chr, start, "end", "sigVal", gene, mids FROM a_genes')
def s06(spark, sf):
    path = scratch_path(spark, "genes")
    names = {"gene": "Gene name", "start": "Gene start (bp)", "end": "Gene end (bp)", "chr": "Chromosome/scaffold name", "sigVal": "FPKM"}
    genes = A.genes(spark, sf).withColumn("chr", F.regexp_replace("chr", "^chr", ""))
    genes.select(*[F.col(c).alias(n) for c, n in names.items()]).write.csv(path, sep="\t", header=True)
    return S.read_genes(spark, path, {n: c for c, n in names.items()})


@query(
    "s07_read_tss",
    """SELECT chr, start, "end", strand, start AS "TSS_start", "end" AS "TSS_end", TSS AS "TSS", mids FROM a_genes""",
)
def s07(spark, sf):
    path = scratch_path(spark, "tss")
    blank = F.lit(".")
    A.genes(spark, sf).select("chr", "start", "end", F.col("gene").alias("g"), blank.alias("s"), "strand", F.col("start").alias("a"), F.col("end").alias("b")).write.csv(path, sep="\t")
    return S.read_tss(spark, path)


@query(
    "s08_read_eigenvector",
    """SELECT chr, bin, CASE WHEN bin % 50 = 0 THEN 0 ELSE "E1" END AS "E1", CAST(40000 AS BIGINT) AS binsize, bin * 40000 + 20000 AS mid FROM a_e1""",
)
def s08(spark, sf):
    path = scratch_path(spark, "e1")
    lines = A.eigenvector(spark, sf).select(
        F.concat("chr", F.lit(".cells.40K.txt")).alias("name"), "bin", F.when(F.col("bin") % 50 == 0, "NaN").otherwise(F.col("E1").cast("string")).alias("value")
    )
    write_lines(lines, path, "name", ["bin"])
    return S.read_eigenvector(spark, path)


@query("s09_read_loops", "SELECT DISTINCT chr, x1, x2, y1, y2 FROM a_loops")
def s09(spark, sf):
    path = scratch_path(spark, "loops")
    loops = A.loops(spark, sf).withColumn("chr", F.regexp_replace("chr", "^chr", ""))
    full = loops.select(F.col("chr").alias("chr1"), "x1", "x2", F.col("chr").alias("chr2"), "y1", "y2", F.lit("0,255,255").alias("color"))
    full.unionByName(full).write.csv(path, sep="\t", header=True)
    return S.read_loops(spark, path).drop("id")


@query(
    "s10_read_tracks",
    'SELECT DISTINCT event_type AS track, chr, start, "end", sigVal, mids FROM a_peaks',
)
def s10(spark, sf):
    folder, listing = scratch_path(spark, "tracks"), scratch_path(spark, "manifest")
    peaks = A.peaks(spark, sf).select(
        F.concat("event_type", F.lit(".narrowPeak")).alias("file"), "chr", "start", "end", F.lit(".").alias("a"), F.lit(0).alias("b"), F.lit(".").alias("c"), "sigVal"
    )
    peaks.write.partitionBy("file").csv(folder, sep="\t")
    names = A.table(spark, sf, "events").select("event_type").distinct()
    rows = names.select("event_type", F.concat(F.lit("file="), "event_type", F.lit(".narrowPeak")), F.lit("none"), F.lit("0"))
    rows.unionAll(spark.range(3).select(*[F.lit(None).cast("string").alias(f"_{i}") for i in range(4)])).coalesce(1).write.csv(listing, sep=";")
    return S.read_tracks(spark, S.read_manifest(spark, listing), folder)


@query(
    "s11_read_norm_coefficient",
    """SELECT cell_type, CAST(round_even(AVG(t), 0) AS BIGINT) AS coeff, CAST(round_even(quantile_cont(t, 0.5), 0) AS BIGINT) AS median,
    CAST(round_even(STDDEV_POP(t), 0) AS BIGINT) AS std FROM (SELECT CAST(condition AS VARCHAR) AS cell_type, contact_st, SUM(contact_count) AS t FROM a_cond GROUP BY ALL) GROUP BY cell_type""",
)
def s11(spark, sf):
    path = scratch_path(spark, "coefficients")
    V.normalization_coefficient(A.conditions(spark, sf), "condition").write.csv(path, sep="\t", header=True)
    return S.read_norm_coefficient(spark, path)


@query(
    "s12_read_expected",
    "SELECT chr, bin * 40000 AS dist, CASE WHEN bin % 7 = 0 THEN 0 ELSE \"E1\" END AS expected FROM a_e1",
)
def s12(spark, sf):
    path = scratch_path(spark, "expected")
    values = A.eigenvector(spark, sf)
    lines = values.select(F.concat("chr", F.lit(".expected.txt")).alias("name"), "bin", F.when(F.col("bin") % 7 == 0, "nan").otherwise(F.col("E1").cast("string")).alias("value"))
    write_lines(lines, path, "name", ["bin"])
    return S.read_expected(spark, path, A.E1_BIN)


@query("s13_read_chrom_sizes", 'SELECT chr, MAX("end") AS size FROM a_runs GROUP BY chr')
def s13(spark, sf):
    path = scratch_path(spark, "sizes")
    _sizes(spark, sf).withColumn("chr", F.regexp_replace("chr", "chr", "NC_")).write.csv(path, sep="\t")
    return S.read_chrom_sizes(spark, path, {f"NC_{k}": f"chr{k}" for k in range(1, 6)})


_PREDICTORS = "SELECT chr, contact_st, contact_en, dist AS contact_dist, contact_count, {x} AS \"CTCF_W\" FROM a_pred WHERE dist BETWEEN 25001 AND 295000"


def _predictor_table(spark, sf, x):
    table = A.predictions(spark, sf).filter(F.col("dist").between(A.MIN_DIST, A.MAX_DIST))
    return table.select("chr", "contact_st", "contact_en", F.col("dist").alias("contact_dist"), "contact_count", x.alias("CTCF_W"))


@query("s14_read_predictors", _PREDICTORS.format(x="CASE WHEN predicted > 20 THEN predicted ELSE 0 END"))
def s14(spark, sf):
    path = scratch_path(spark, "predictors")
    table = _predictor_table(spark, sf, F.when(F.col("predicted") > 20, F.col("predicted")))
    K.write_predictors(table, path, "csv")
    return S.read_predictors(spark, path)


@query("k01_write_predictors", _PREDICTORS.format(x="predicted"))
def k01(spark, sf):
    path = scratch_path(spark, "predictors")
    table = _predictor_table(spark, sf, F.col("predicted"))
    # two runs append to one dataset
    K.write_predictors(table.filter("chr <= 'chr2'"), path)
    K.write_predictors(table.filter("chr > 'chr2'"), path)
    return spark.read.parquet(path)


@query("s15_read_promoters", "SELECT DISTINCT chr, TSS // 5000 AS bin FROM a_genes")
def s15(spark, sf):
    path = scratch_path(spark, "refgene")
    A.genes(spark, sf).select(F.concat_ws("  ", F.lit("0"), "gene", "chr", "strand", "start", "end").alias("value")).write.text(path)
    return S.read_promoters(spark, path, A.BIN)


@query("s15_read_enhancers", "SELECT DISTINCT chr, mids // 5000 AS bin FROM a_peaks")
def s15_enhancers(spark, sf):
    path = scratch_path(spark, "enhancers")
    A.peaks(spark, sf).select(F.concat_ws("\t", "chr", "start", "end").alias("value")).write.text(path)
    return S.read_enhancers(spark, path, A.BIN)


def _pair_lines(spark, sf, path, columns):
    rows = A.predictions(spark, sf)
    # ends swapped, and every pair written twice with different values
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("contact_count", F.col("contact_count") + F.col("again") * 1000)
    lines = twice.withColumn("value", F.concat_ws(" ", "contact_en", "contact_st", *columns)).withColumn("name", F.concat("chr", F.lit(".oe")))
    # ranges of the order, each a part file of its chromosome's folder: file names ascend like the lines
    ranged = lines.repartitionByRange("name", "again", "contact_st", "contact_en").sortWithinPartitions("name", "again", "contact_st", "contact_en")
    ranged.select(F.col("name").alias("file"), "value").write.partitionBy("file").text(path)


@query(
    "s16_read_oe_pairs",
    """SELECT p.chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count AS value FROM a_pred p
    JOIN (SELECT DISTINCT chr, x1 // 5000 AS i FROM a_loops) l ON l.chr = p.chr AND l.i = contact_st // 5000""",
)
def s16(spark, sf):
    path = scratch_path(spark, "oepairs")
    _pair_lines(spark, sf, path, ["contact_count"])
    cells = A.contacts(spark, sf).select("chr", F.floor(F.col("contact_st") / A.BIN).alias("i"), F.floor(F.col("contact_en") / A.BIN).alias("j"))
    starts = A.loops(spark, sf).select("chr", F.floor(F.col("x1") / A.BIN).alias("i")).distinct()
    return S.read_oe_pairs(spark, path, None, A.BIN, cells.join(starts, ["chr", "i"], "left_semi"))


@query(
    "s17_read_model_pairs",
    """SELECT chr, contact_st // 5000 AS i, contact_en // 5000 AS j, contact_count + 1000 AS observed, predicted FROM a_pred""",
)
def s17(spark, sf):
    path = scratch_path(spark, "modelpairs")
    _pair_lines(spark, sf, path, ["contact_count", "predicted"])
    return S.read_model_pairs(spark, path, None, A.BIN)


@query(
    "s17_read_pre",
    """SELECT chr AS chr1, contact_st // 5000 AS i, chr AS chr2, contact_en // 5000 AS j, contact_count * 1000000 AS value FROM a_contacts""",
)
def s17_pre(spark, sf):
    pairs, sizes = scratch_path(spark, "pre"), scratch_path(spark, "presizes")
    K.write_pre_pairs(A.contacts(spark, sf), pairs, sizes)
    return S.read_pre(spark, pairs, A.BIN)


@query(
    "s18_read_fasta",
    """SELECT chr, SUM(length(piece))::BIGINT AS size, COUNT(*) AS n_blocks, MAX(k * 60)::BIGINT AS last_start,
    SUM((k * 60) * (length(piece) - length(replace(piece, 'c', ''))))::BIGINT AS c_positions FROM (SELECT chr, k, substr(seq, k * 60 + 1, 60) AS piece FROM
    (SELECT chr, seq, UNNEST(range(0, (length(seq) + 59) // 60)) AS k FROM a_seq)) GROUP BY chr""",
)
def s18(spark, sf):
    path = scratch_path(spark, "fasta")
    sequences = A.sequences(spark, sf).filter("length(seq) > 0").withColumn("n", F.substring("chr", 4, 20).cast("bigint"))
    parts = sequences.select("chr", "n", "seq", F.explode(F.sequence(F.lit(-1), F.floor((F.length("seq") - 1) / 60))).alias("k"))
    piece = F.substring("seq", (F.col("k") * 60 + 1).cast("int"), F.lit(60))
    value = F.when(F.col("k") == -1, F.concat(F.lit(">"), "chr", F.lit(" some description"))).otherwise(piece)
    lines = parts.select(F.concat(F.lit("part"), F.col("n") % 4, F.lit(".fa")).alias("name"), "n", "k", value.alias("value"))
    write_lines(lines, path, "name", ["n", "k"])
    blocks = Q.sequence_blocks(S.read_lines(spark, path))
    cs = F.length("seq") - F.length(F.translate("seq", "c", ""))
    return blocks.groupBy("chr").agg(
        F.sum(F.length("seq")).alias("size"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.max("block_start").alias("last_start"),
        F.sum(F.col("block_start") * cs).alias("c_positions"),
    )


@query(
    "s19_read_signal",
    """SELECT chr, start, "end", CASE WHEN start % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM a_runs""",
)
def s19(spark, sf):
    path = scratch_path(spark, "signal")
    holes = F.when(F.col("start") % 5 == 0, float("nan")).otherwise(F.col("value"))
    K.write_track(A.runs(spark, sf).withColumn("value", holes), path, ["chr", "start", "end", "value"])
    return S.read_signal(spark, path)


@query(
    "s20_validate_inputs",
    """SELECT 'gene_columns' AS check, FALSE AS passed, 1::BIGINT AS n_bad UNION ALL SELECT 'peak_fields', TRUE, 0::BIGINT
    UNION ALL SELECT 'orientation_fields', COUNT(*) = 0, COUNT(*) FROM a_motifs WHERE score = 50
    UNION ALL SELECT 'both_strands', COUNT(DISTINCT orientation) = 2, 2 - COUNT(DISTINCT orientation) FROM a_motifs WHERE score <> 50""",
)
def s20(spark, sf):
    peaks, motifs = scratch_path(spark, "peaks"), scratch_path(spark, "motifs")
    _write_peaks(spark, sf, peaks)
    broken = F.when(F.col("score") == 50, F.concat_ws("\t", "chr", "start", "end")).otherwise(
        F.concat_ws("\t", "chr", "start", "end", F.lit("ctcf"), "score", "orientation")
    )
    A.motifs(spark, sf).select(broken.alias("value")).write.text(motifs)
    return S.validate_inputs(A.genes(spark, sf).withColumnRenamed("sigVal", "fpkm_"), S.read_lines(spark, peaks), S.read_lines(spark, motifs))


@query(
    "k02_write_orientation_bedgraphs",
    """SELECT 'plus' AS strand, chr, start, "end", CAST(plus_orientation AS DOUBLE) AS value FROM a_oriented UNION ALL
    SELECT 'minus', chr, start, "end", CAST(minus_orientation AS DOUBLE) FROM a_oriented""",
)
def k02(spark, sf):
    path = scratch_path(spark, "orientation")
    K.write_orientation_bedgraphs(oriented(spark, sf), path)
    out = [S.read_signal(spark, f"{path}/strand={s}").withColumn("strand", F.lit(s)) for s in ("plus", "minus")]
    return out[0].unionByName(out[1])


@query("k03_write_chrom_sizes", "SELECT chr, MAX(contact_en) AS size FROM a_contacts GROUP BY chr")
def k03(spark, sf):
    pairs, sizes = scratch_path(spark, "pre"), scratch_path(spark, "presizes")
    K.write_pre_pairs(A.contacts(spark, sf), pairs, sizes)
    return S.read_chrom_sizes(spark, sizes)


@query("k04_write_scc_pairs", 'SELECT contact_st, contact_en, contact_count, predicted AS "0" FROM a_pred')
def k04(spark, sf):
    path = scratch_path(spark, "scc")
    K.write_scc_pairs(A.predictions(spark, sf), path)
    return spark.read.schema("contact_st bigint, contact_en bigint, contact_count double, `0` double").csv(path, sep=" ", header=True)


@query(
    "k05_write_metrics",
    """SELECT chr, ROUND(1 - SUM((predicted - contact_count) ** 2) / (VAR_POP(predicted) * COUNT(*)), 9) AS r2 FROM a_pred GROUP BY chr""",
)
def k05(spark, sf):
    path = scratch_path(spark, "metrics")
    K.write_metrics(V.r_squared(A.predictions(spark, sf)).withColumn("r2", F.round("r2", 9)), path)
    return spark.read.schema("chr string, r2 double").csv(path, sep="\t", header=True)


@query(
    "k07_run_report",
    f"""SELECT 'features' AS output, COUNT(*) AS n_contacts, '{json.dumps(asdict(RunParameters()), sort_keys=True)}' AS parameters, '[]' AS families,
    'chr,contact_st,contact_en,contact_count,dist' AS columns FROM a_contacts WHERE dist BETWEEN {A.MIN_DIST} AND {A.MAX_DIST}""",
)
def k07(spark, sf):
    path = scratch_path(spark, "report")
    K.write_run_report(K.run_report(base(spark, sf), RunParameters(), (), "features"), path)
    return spark.read.json(path)


@query(
    "k08_write_bed",
    """WITH p AS (SELECT chr, bin * 1000 AS start, bin * 1000 + 1000 AS "end", SUM(CAST(value AS DECIMAL(18,2)) * (LEAST("end", bin * 1000 + 1000) - GREATEST(start, bin * 1000))) AS t
    FROM (SELECT *, UNNEST(range(start // 1000, ("end" - 1) // 1000 + 1)) AS bin FROM a_runs) GROUP BY chr, bin) SELECT chr, start, "end" FROM p WHERE t > 50000""",
)
def k08(spark, sf):
    path = scratch_path(spark, "bed")
    bins = V.signal_bins(A.runs(spark, sf), 1_000).filter("total > 50000")
    K.write_bed(bins.select("chr", (F.col("bin") * 1000).alias("start"), ((F.col("bin") + 1) * 1000).alias("end")), path)
    return S.read_positional(spark, path, {0: "chr", 1: "start", 2: "end"}).drop("_metadata")
