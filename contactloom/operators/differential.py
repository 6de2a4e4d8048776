"""Comparison of conditions over pairs of bins.

Tables of pairs are ``chr, i, j, value`` with bin numbers ``i <= j``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.ordered import BEFORE, UP_TO, average_rank, cumulative_at, exact_quantiles, ordered_counts
from contactloom.operators.stats import paired_bins
from contactloom.session import cut_lineage


def promoter_enhancer_pairs(promoters: DataFrame, enhancers: DataFrame, reach: int) -> DataFrame:
    """Distinct ordered pairs more than 2 and fewer than ``reach`` bins apart, on chromosomes with short names."""
    short = F.length("chr") <= 5
    return paired_bins(promoters.filter(short), enhancers.filter(short), 2, reach)


def gather_conditions(pairs: DataFrame, values: DataFrame, conditions: Sequence[int | str]) -> DataFrame:
    """log2 of each pair's value in every condition and of its distance; pairs absent from any condition are dropped.

    ``values`` is one long table (condition, chr, i, j, value): it is read and shuffled once, however many conditions.
    """
    key = ["chr", "i", "j"]
    wide = (
        values.join(pairs.select(*key), key, "left_semi")
        .groupBy(*key)
        .pivot("condition", list(conditions))
        .agg(F.sum("value"))
        .withColumnsRenamed({str(c): f"c{c}" for c in conditions})
    )
    for c in conditions:
        wide = wide.filter(F.coalesce(F.col(f"c{c}"), F.lit(0.0)) != 0)
    return wide.select(
        *key, *[F.log2(f"c{c}").alias(f"c{c}") for c in conditions], F.log2((F.col("j") - F.col("i")).cast("double")).alias("distance")
    )


def _log_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chr, i, j, d): absolute log2 ratio of cells positive in both tables."""
    key = ["chr", "i", "j"]
    both = a.select(*key, F.col("value").alias("_a")).join(b.select(*key, F.col("value").alias("_b")), key)
    return both.filter("_a > 0 AND _b > 0").select(*key, F.abs(F.log2("_a") - F.log2("_b")).alias("d"))


def log_ratio_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean absolute log2 ratio over cells positive in both tables, 0 if there are none."""
    return _log_ratio(a, b).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("distance"), F.count(F.lit(1)).alias("n_cells"))


def _track(a: DataFrame, b: DataFrame, spans: Column, binsize: int) -> DataFrame:
    """Mean log ratio of the cells whose span of centres covers each bin, at every bin present in either table.

    ``spans`` is an array of (lo, hi) per cell.  A cell enters at ``lo`` and leaves after ``hi``, so it is
    copied twice per span instead of once per centre.
    """
    measured = cut_lineage(_log_ratio(a, b).select(
        "chr", F.col("d").cast("decimal(28,12)").alias("d"), F.lit(1).cast("bigint").alias("n"), F.explode(spans).alias("_s")
    ).filter("_s.lo <= _s.hi"))
    centres = cut_lineage(
        a.select("chr", F.explode(F.array("i", "j")).alias("p"))
        .unionByName(b.select("chr", F.explode(F.array("i", "j")).alias("p")))
        .distinct()
    )
    entered = cumulative_at(centres.withColumn("side", F.lit(UP_TO)), measured.select("chr", F.col("_s.lo").alias("pos"), "d", "n"), ["d", "n"], width=4_096)
    left = cumulative_at(centres.withColumn("side", F.lit(BEFORE)), measured.select("chr", F.col("_s.hi").alias("pos"), "d", "n"), ["d", "n"], width=4_096)
    both = entered.select("chr", "p", F.col("d").alias("d1"), F.col("n").alias("n1")).join(
        left.select("chr", "p", F.col("d").alias("d0"), F.col("n").alias("n0")), ["chr", "p"]
    )
    cells = F.col("n1") - F.col("n0")
    mean = F.when(cells > 0, (F.col("d1") - F.col("d0")).cast("double") / cells).otherwise(0.0)
    return both.select(
        "chr", (F.col("p") * binsize).alias("start"), ((F.col("p") + 1) * binsize).alias("end"), F.round(mean, 5).alias("metric")
    )


def _span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def triangle_track(a: DataFrame, b: DataFrame, frame: int, binsize: int) -> DataFrame:
    """Log-ratio distance of all cells with both ends within ``frame`` bins of each bin."""
    return _track(a, b, F.array(_span(F.col("j") - frame, F.col("i") + frame)), binsize)


def strip_track(a: DataFrame, b: DataFrame, frame: int, high: int, binsize: int) -> DataFrame:
    """Log-ratio distance of a diagonal strip: cells at most ``high`` bins long on either side of each bin.

    Cells reaching back from the ``frame`` bins up to the centre and forward from the ``frame`` bins after it
    both count; the centre's own cell lies in both halves.
    """
    near = F.col("j") - F.col("i") <= high
    spans = F.when(near, F.array(_span(F.col("j"), F.col("j") + frame), _span(F.col("i") - frame, F.col("i")))).otherwise(
        F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    )
    return _track(a, b, spans, binsize)


def differential_pairs(
    wide: DataFrame, change: tuple[str, str], replicate: tuple[str, str], comparisons: dict[str, tuple[str, str]], limit: float = 1.0
) -> DataFrame:
    """(comparison, delta) of pairs changing by more than ``limit`` between conditions and less between replicates."""

    def gap(pair: tuple[str, str]) -> Column:
        return F.abs(F.col(pair[1]) - F.col(pair[0]))

    kept = wide.filter((gap(change) > limit) & (gap(replicate) < limit))
    rows = F.array(*[F.struct(F.lit(n).alias("comparison"), gap(p).alias("delta")) for n, p in comparisons.items()])
    return kept.select(F.explode(rows).alias("_r")).select("_r.comparison", "_r.delta")


def medians(deltas: DataFrame) -> DataFrame:
    return exact_quantiles(deltas, ["comparison"], "delta", {"median": 0.5}).select("comparison", "median", "n")


def mann_whitney(deltas: DataFrame, tests: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, n_x, n_y, u, z): U of the first sample from mean ranks over both, with the tie-corrected normal score."""
    named = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in tests])
    rows = deltas.withColumn("_t", F.explode(named)).select("comparison", "delta", "_t.x", "_t.y")
    rows = rows.filter((F.col("comparison") == F.col("x")) | (F.col("comparison") == F.col("y"))).withColumn(
        "in_x", (F.col("comparison") == F.col("x")).cast("bigint")
    )
    ranked = ordered_counts(rows, ["x", "y"], "delta", sums=["in_x"])
    ties = F.col("cnt").cast("double") ** 3 - F.col("cnt")
    sums = ranked.groupBy("x", "y", "n").agg(
        F.sum(F.col("in_x") * average_rank()).alias("_r"), F.sum("in_x").alias("n_x"), F.sum(ties).alias("_ties")
    )
    n_y = F.col("n") - F.col("n_x")
    u = F.col("_r") - F.col("n_x") * (F.col("n_x") + 1) / 2
    n = F.col("n").cast("double")
    spread = F.sqrt(F.col("n_x") * n_y / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    return sums.select("x", "y", "n_x", n_y.alias("n_y"), u.alias("u"), F.try_divide(u - F.col("n_x") * n_y / 2.0, spread).alias("z"))
