"""Sinks.  Text sinks write folders of part files, one folder per output."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: name of the column, and so of the folders, that tells runs apart
RUN = "run_id"


def stored_columns(spark: SparkSession, path: str) -> list[str] | None:
    """Columns of a stored predictor table without its partitions; None if there is none yet."""
    if not exists(spark, path):
        return None
    found = spark.read.parquet(path).columns if _holds_parquet(spark, path) else None
    return found and [c for c in found if c not in ("chr", RUN)]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _holds_parquet(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(x.isDirectory() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def stored_chromosomes(spark: SparkSession, path: str, run: str) -> list[str]:
    """Chromosomes that the run has written to the end; folders only appear there when a write commits."""
    if stored_columns(spark, path) is None:
        return []
    written = spark.read.parquet(path)
    if RUN not in written.columns:
        return []
    return sorted(r["chr"] for r in written.filter(F.col(RUN) == run).select("chr").distinct().collect())


def write_predictors(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", run: str | None = None) -> None:
    """The predictor table, one partition per chromosome; several runs append to one dataset.

    What is there must have the same columns in the same order, whatever the format: a difference is an error.
    With ``run`` (parquet) rows lie below ``run_id=<run>/chr=<chr>``, and writing replaces just the chromosomes of this
    run that ``table`` has: a run repeated after a failure leaves each row once, and those of other runs and chromosomes stay.

    Tab-separated output keeps the chromosome as an ordinary column under a
    header line, so that the reader can type the table by its header.
    """
    spark = table.sparkSession
    if fmt == "parquet":
        own, there = [c for c in table.columns if c not in ("chr", RUN)], stored_columns(spark, path)
        if mode == "append" and there and there != own:
            raise ValueError(f"{path} holds columns {there}, not {own}")
        if run is None:
            table.write.mode(mode).partitionBy("chr").parquet(path)
        else:
            staged = table.withColumn(RUN, F.lit(run))
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN, "chr").parquet(path)
    else:
        if mode == "append" and exists(spark, path):
            there = spark.read.option("recursiveFileLookup", "true").text(path).head(1)
            if there and there[0][0].split("\t") != table.columns:
                raise ValueError(f"{path} holds columns {there[0][0].split(chr(9))}, not {table.columns}")
        table.write.mode(mode).csv(path, sep="\t", header=True)


def write_contacts(contacts: DataFrame, path: str, suffix: str = "contacts") -> None:
    """Triples without a header, one folder ``<chr>.<suffix>`` per chromosome."""
    named = contacts.select(
        F.concat(F.col("chr"), F.lit(f".{suffix}")).alias("file"), "contact_st", "contact_en", "contact_count"
    )
    named.write.partitionBy("file").csv(path, sep="\t")


def write_track(track: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Headerless tab-separated columns."""
    track.select(*columns).write.csv(path, sep="\t")


def write_orientation_bedgraphs(track: DataFrame, path: str) -> None:
    """Plus and minus scores as two bedGraph outputs below ``path``."""
    sides = F.array(
        F.struct(F.lit("plus").alias("strand"), F.col("plus_orientation").alias("score")),
        F.struct(F.lit("minus").alias("strand"), F.col("minus_orientation").alias("score")),
    )
    rows = track.select("chr", "start", "end", F.explode(sides).alias("_s")).select("_s.strand", "chr", "start", "end", "_s.score")
    rows.write.partitionBy("strand").csv(path, sep="\t")


def pre_pairs(contacts: DataFrame) -> DataFrame:
    """Nine-column pair records with counts as whole millionths."""
    zero = F.lit(0)
    return contacts.select(
        zero.alias("str1"),
        F.col("chr").alias("chr1"),
        F.col("contact_st").alias("start1"),
        F.col("contact_st").alias("start2"),
        zero.alias("str2"),
        F.col("chr").alias("chr2"),
        F.col("contact_en").alias("end1"),
        F.col("contact_en").alias("end2"),
        F.bround(F.col("contact_count") * 1_000_000, 0).cast("bigint").alias("exp"),
    )


def chrom_sizes(contacts: DataFrame) -> DataFrame:
    """Largest coordinate per chromosome."""
    return contacts.groupBy("chr").agg(F.max(F.greatest("contact_st", "contact_en")).alias("size"))


def write_pre_pairs(contacts: DataFrame, pairs_path: str, sizes_path: str) -> None:
    pre_pairs(contacts).write.csv(pairs_path, sep=" ")
    chrom_sizes(contacts).write.csv(sizes_path, sep="\t")


def write_scc_pairs(predictions: DataFrame, path: str) -> None:
    """Observed and predicted counts, space separated; the prediction's column is called ``0``."""
    columns = ["contact_st", "contact_en", "contact_count", F.col("predicted").alias("0")]
    if "IsLoop" in predictions.columns:
        columns.append("IsLoop")
    predictions.select(*columns).write.csv(path, sep=" ", header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A table of a few rows of measures, with a header."""
    metrics.coalesce(1).write.csv(path, sep="\t", header=True)


def write_bed(bins: DataFrame, path: str) -> None:
    bins.select("chr", "start", "end").write.csv(path, sep="\t")


def write_feature_importance(importance: DataFrame, path: str) -> None:
    """One row per feature, largest first."""
    importance.coalesce(1).orderBy(F.desc("importance"), "feature").write.csv(path, sep="\t")


def run_report(table: DataFrame, parameters, families: Sequence = (), output: str = "") -> DataFrame:
    """One row describing a run: parameters, feature families, columns, number of rows."""
    settings = asdict(parameters) if is_dataclass(parameters) else dict(parameters)
    described = [{"name": f.name, **f.settings()} for f in families]
    return table.agg(F.count(F.lit(1)).alias("n_contacts")).select(
        F.lit(output).alias("output"),
        "n_contacts",
        F.lit(json.dumps(settings, sort_keys=True)).alias("parameters"),
        F.lit(json.dumps(described, sort_keys=True)).alias("families"),
        F.lit(",".join(table.columns)).alias("columns"),
    )


def write_run_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("append").json(path)
