"""Contact tables and interval tracks derived from the driver's tables.

Every adapter is integer arithmetic over a whole table, so that the same rows
can be produced by SQL in another engine (see ``TABLE_SQL``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.ordered import place_ranks

BIN = 5_000
E1_BIN = 40_000
WINDOW = 25_000
MIN_DIST = 25_001
MAX_DIST = 295_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chr(number: Column) -> Column:
    return F.concat(F.lit("chr"), (number % 5 + 1).cast("string"))


def _cells(lineitem: DataFrame) -> DataFrame:
    start = F.col("l_partkey") * BIN
    return lineitem.select(
        _chr(F.col("l_suppkey")).alias("chr"),
        start.alias("contact_st"),
        (start + (F.col("l_orderkey") % 60) * BIN).alias("contact_en"),
        "l_quantity",
        "l_returnflag",
        "l_linestatus",
    )


def _summed(cells: DataFrame) -> DataFrame:
    return (
        cells.groupBy("chr", "contact_st", "contact_en")
        .agg(F.sum("l_quantity").alias("contact_count"))
        .withColumn("dist", F.col("contact_en") - F.col("contact_st"))
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_cells(table(spark, sf_dir, "lineitem")))


def wild_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_cells(table(spark, sf_dir, "lineitem")).filter("l_linestatus = 'O'"))


def mutant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(_cells(table(spark, sf_dir, "lineitem")).filter("l_linestatus = 'F'"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, chr, contact_st, contact_en, contact_count), condition 0..5."""
    cells = _cells(table(spark, sf_dir, "lineitem")).withColumn(
        "condition",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * 2
        + F.when(F.col("l_linestatus") == "F", 0).otherwise(1),
    )
    return cells.groupBy("condition", "chr", "contact_st", "contact_en").agg(F.sum("l_quantity").alias("contact_count"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, en = F.floor(F.col("contact_st") / BIN), F.floor(F.col("contact_en") / BIN)
    noise = (st * 3 + en) % 7 - 3
    return contacts(spark, sf_dir).withColumn(
        "predicted", F.greatest(F.col("contact_count") + noise, F.lit(0.0)).cast("double")
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    start = F.col("event_id") * 1000 + (F.col("user_id") * 37) % 500
    return events.select(
        _chr(F.col("user_id")).alias("chr"),
        start.alias("start"),
        (start + 200 + (F.col("user_id") * 13) % 900).alias("end"),
        F.col("value").alias("sigVal"),
        "event_id",
        "event_type",
    ).withColumn("mids", F.floor((F.col("start") + F.col("end")) / 2))


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    moved = F.when(e % 4 == 3, 5000).otherwise(0)
    return peaks(spark, sf_dir).select(
        "chr",
        (F.col("start") + 50 - (e % 3) * 200 + moved).alias("start"),
        (F.col("start") + 70 - (e % 3) * 200 + moved).alias("end"),
        ((e * 7) % 100 + 1).alias("score"),
        F.when(e % 2 == 0, "+").otherwise("-").alias("orientation"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = key * 667
    end = start + 1000 + (F.col("o_custkey") % 50) * 400
    return (
        table(spark, sf_dir, "orders")
        .select(
            _chr(F.col("o_custkey")).alias("chr"),
            start.alias("start"),
            end.alias("end"),
            key.cast("string").alias("gene"),
            F.when(key % 2 == 0, "+").otherwise("-").alias("strand"),
            F.when(key % 2 == 0, start).otherwise(end).alias("TSS"),
            F.col("o_totalprice").alias("sigVal"),
        )
        .withColumn("mids", F.floor((F.col("start") + F.col("end")) / 2))
    )


def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        _chr(F.col("c_nationkey")).alias("chr"),
        F.col("c_custkey").alias("mids"),
        (F.col("c_acctbal").cast("decimal(18,2)") - 4500).cast("double").alias("E1"),
    )
    return rows.join(place_ranks(rows, ["chr"]), ["chr", "mids"]).select("chr", F.col("base").alias("bin"), "E1")


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1 = F.col("p_partkey") * BIN
    y1 = x1 + (F.col("p_size") % 40 + 10) * BIN
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        _chr(F.col("p_size")).alias("chr"),
        x1.alias("x1"),
        (x1 + BIN).alias("x2"),
        y1.alias("y1"),
        (y1 + BIN).alias("y2"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chr"),
        F.regexp_replace(F.lower("text"), "[^acgt]", "n").alias("seq"),
    )


def sequence_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor pairs on the sequences: one contact per 1000 characters and text."""
    doc = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chr"), F.length("text").cast("bigint").alias("n")
    )
    return doc.select("chr", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 1000))).alias("k")).select(
        "chr", (F.col("k") * 1000).alias("contact_st"), (F.col("k") * 1000 + 60).alias("contact_en")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(spark, sf_dir).select("chr", "start", "end", F.col("sigVal").alias("value"))


#: The same tables as SQL, for the side-by-side check.
_CELLS = """SELECT 'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS chr, l_partkey * 5000 AS contact_st,
  l_partkey * 5000 + (l_orderkey % 60) * 5000 AS contact_en, l_quantity, l_returnflag, l_linestatus FROM lineitem"""
_SUMMED = """SELECT chr, contact_st, contact_en, SUM(l_quantity) AS contact_count, contact_en - contact_st AS dist
  FROM a_cells{where} GROUP BY chr, contact_st, contact_en"""
TABLE_SQL = {
    "a_cells": _CELLS,
    "a_contacts": _SUMMED.format(where=""),
    "a_wt": _SUMMED.format(where=" WHERE l_linestatus = 'O'"),
    "a_mut": _SUMMED.format(where=" WHERE l_linestatus = 'F'"),
    "a_cond": """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2
  + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS condition, chr, contact_st, contact_en, SUM(l_quantity) AS contact_count
  FROM a_cells GROUP BY ALL""",
    "a_pred": """SELECT *, CAST(GREATEST(contact_count + ((contact_st // 5000 * 3 + contact_en // 5000) % 7) - 3, 0) AS DOUBLE)
  AS predicted FROM a_contacts""",
    "a_peaks": """SELECT 'chr' || CAST(user_id % 5 + 1 AS VARCHAR) AS chr, event_id * 1000 + (user_id * 37) % 500 AS start,
  event_id * 1000 + (user_id * 37) % 500 + 200 + (user_id * 13) % 900 AS "end", value AS sigVal, event_id, event_type,
  (2 * (event_id * 1000 + (user_id * 37) % 500) + 200 + (user_id * 13) % 900) // 2 AS mids FROM events""",
    "a_motifs": """SELECT chr, start + 50 - (event_id % 3) * 200 + CASE WHEN event_id % 4 = 3 THEN 5000 ELSE 0 END AS start,
  start + 70 - (event_id % 3) * 200 + CASE WHEN event_id % 4 = 3 THEN 5000 ELSE 0 END AS "end",
  (event_id * 7) % 100 + 1 AS score, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS orientation FROM a_peaks""",
    "a_genes": """SELECT 'chr' || CAST(o_custkey % 5 + 1 AS VARCHAR) AS chr, o_orderkey * 667 AS start,
  o_orderkey * 667 + 1000 + (o_custkey % 50) * 400 AS "end", CAST(o_orderkey AS VARCHAR) AS gene,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 667 ELSE o_orderkey * 667 + 1000 + (o_custkey % 50) * 400 END AS TSS,
  o_totalprice AS sigVal, (2 * o_orderkey * 667 + 1000 + (o_custkey % 50) * 400) // 2 AS mids FROM orders""",
    "a_e1": """SELECT 'chr' || CAST(c_nationkey % 5 + 1 AS VARCHAR) AS chr,
  ROW_NUMBER() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) - 1 AS bin,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) - 4500 AS DOUBLE) AS E1 FROM customer""",
    "a_loops": """SELECT p_partkey AS id, 'chr' || CAST(p_size % 5 + 1 AS VARCHAR) AS chr, p_partkey * 5000 AS x1,
  p_partkey * 5000 + 5000 AS x2, p_partkey * 5000 + (p_size % 40 + 10) * 5000 AS y1,
  p_partkey * 5000 + (p_size % 40 + 10) * 5000 + 5000 AS y2 FROM part""",
    "a_seq": """SELECT 'doc' || CAST(doc_id AS VARCHAR) AS chr, regexp_replace(lower(text), '[^acgt]', 'n', 'g') AS seq
  FROM documents""",
    "a_seq_contacts": """SELECT chr, k * 1000 AS contact_st, k * 1000 + 60 AS contact_en FROM (SELECT
  'doc' || CAST(doc_id AS VARCHAR) AS chr, UNNEST(range(0, length(text) // 1000 + 1)) AS k FROM documents)""",
    "a_runs": 'SELECT chr, start, "end", sigVal AS value FROM a_peaks',
    # oriented peaks: lowest motif score per strand, 0 where there is none
    "a_oriented": """SELECT p.chr, p.start, p."end", p.mids, p.sigVal, p.event_id,
  COALESCE(MIN(m.score) FILTER (m.orientation = '+'), 0) AS plus_orientation,
  COALESCE(MIN(m.score) FILTER (m.orientation = '-'), 0) AS minus_orientation
  FROM a_peaks p LEFT JOIN a_motifs m ON m.chr = p.chr AND p."end" >= m.start AND p.start < m."end"
  GROUP BY p.chr, p.start, p."end", p.mids, p.sigVal, p.event_id""",
    "a_only_oriented": """SELECT chr, start, "end", mids, sigVal, event_id,
  CASE WHEN plus_orientation > minus_orientation THEN plus_orientation ELSE 0 END AS plus_orientation,
  CASE WHEN minus_orientation > plus_orientation THEN minus_orientation ELSE 0 END AS minus_orientation
  FROM a_oriented WHERE plus_orientation <> minus_orientation""",
}


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the adapter tables it mentions, dependencies first."""
    body = sql.strip()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\ba_[a-z0-9_]+\b", text))):
            if name in TABLE_SQL and name not in needed:
                visit(TABLE_SQL[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    tables = ",\n".join(f"{name} AS ({TABLE_SQL[name]})" for name in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"
