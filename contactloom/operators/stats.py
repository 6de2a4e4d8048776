"""Statistics over contact tables and validation of predicted counts.

Predictions are a table ``chr, contact_st, contact_en, contact_count,
predicted``.  The measures treat each chromosome as a symmetric matrix; cells
that are not stored are zeros and enter only through closed-form counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ordered import (
    SCALE,
    average_rank,
    bucket_of,
    exact_quantiles,
    fixed,
    hash_sample,
    lookup,
    ordered_counts,
    window_totals,
)
from contactloom.operators.contacts import PAIR
from contactloom.session import cut_lineage

#: Largest distance compared, in base pairs.
REACH = 1_500_000


# ---- coefficients and profiles ------------------------------------------------------------------


def normalization_coefficient(contacts: DataFrame, sample: str = "sample") -> DataFrame:
    """Mean, median and deviation over start positions of the summed counts, per sample, in whole numbers."""
    usable = contacts.filter(F.col("contact_count").isNotNull() & ~F.isnan("contact_count"))
    by_start = usable.groupBy(sample, "contact_st").agg(F.sum("contact_count").alias("total"))
    moments = by_start.groupBy(sample).agg(F.avg("total").alias("coeff"), F.stddev_pop("total").alias("std"))
    medians = exact_quantiles(by_start, [sample], "total", {"median": 0.5}).drop("n")
    whole = [F.bround(c, 0).cast("bigint").alias(c) for c in ("coeff", "median", "std")]
    return moments.join(medians, sample).select(F.col(sample).alias("cell_type"), *whole)


def signal_bins(runs: DataFrame, binsize: int) -> DataFrame:
    """(chr, bin, total): base-pair sum of the runs per bin, NaN as 0."""
    clean = runs.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0))).filter(F.col("end") > F.col("start"))
    first, last = F.floor(F.col("start") / binsize), F.floor((F.col("end") - 1) / binsize)
    spread = clean.select("chr", "start", "end", "value", F.explode(F.sequence(first, last)).alias("bin"))
    covered = F.least(F.col("end"), (F.col("bin") + 1) * binsize) - F.greatest(F.col("start"), F.col("bin") * binsize)
    amount = (fixed("value").cast(f"decimal(24,{SCALE})") * covered.cast("decimal(10,0)")).cast(f"decimal(28,{SCALE})")
    return spread.groupBy("chr", "bin").agg(F.sum(amount).alias("total"))


def strong_bins(runs: DataFrame, sizes: DataFrame, binsize: int = 1_000, percentile: float = 0.9) -> DataFrame:
    """Bins whose signal exceeds a percentile over all bins of their chromosome, empty ones included."""
    bins = signal_bins(runs, binsize).select("chr", "bin", F.col("total").cast("double").alias("total"))
    counts = sizes.select("chr", F.ceil((F.col("size") - 1) / binsize).alias("n_bins"))
    inside = lookup(bins, counts, ["chr"], ["n_bins"]).filter(F.col("bin") < F.col("n_bins"))
    stored = inside.groupBy("chr").agg(F.count(F.lit(1)).alias("_k"))
    empty = counts.join(stored, "chr", "left").select(
        "chr", F.lit(0.0).alias("total"), (F.col("n_bins") - F.coalesce("_k", F.lit(0))).alias("w")
    )
    weighted = inside.select("chr", "total", F.lit(1).cast("bigint").alias("w")).unionByName(empty.filter("w > 0"))
    cut = exact_quantiles(weighted, ["chr"], "total", {"cut": percentile}, weight="w").select("chr", "cut")
    return lookup(inside, cut, ["chr"], ["cut"]).filter(F.col("total") > F.col("cut")).select(
        "chr", (F.col("bin") * binsize).alias("start"), ((F.col("bin") + 1) * binsize).alias("end"), "total"
    )


def sparsity_profile(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per chromosome: base pairs in all, with a non-zero value, and with a finite non-zero value."""
    length = F.col("end") - F.col("start")
    value = F.col("value")
    set_ = value.isNotNull() & ((value != 0) | F.isnan(value))
    finite = set_ & ~F.isnan(value) & (F.abs(value) != float("inf"))
    seen = runs.groupBy("chr").agg(
        F.sum(F.when(set_, length).otherwise(0)).alias("nonzero"), F.sum(F.when(finite, length).otherwise(0)).alias("finite")
    )
    return sizes.join(seen, "chr", "left").select(
        "chr", F.col("size").alias("total"), F.coalesce("nonzero", F.lit(0)).alias("nonzero"), F.coalesce("finite", F.lit(0)).alias("finite")
    )


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson and Spearman correlation (ties share their mean rank)."""
    ranks = {
        c: ordered_counts(df, [], c).select(c, average_rank().alias(f"_r_{c}")) for c in (x, y)
    }
    ranked = df.join(ranks[x], x).join(ranks[y], y)
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"))


def window_signals(
    contacts: DataFrame, signals: dict[str, DataFrame], starts: DataFrame, binsize: int, bins: int, skip: dict[str, int]
) -> DataFrame:
    """Contact between both ends of each window ``bins`` long, and the binned signals summed inside.

    ``signals`` are tables (chr, bin, total); ``skip`` leaves out that many bins at the window's start.
    """
    windows = starts.select("chr", F.col("pos").alias("start"), (F.col("pos") + bins * binsize).alias("end"))
    stored = contacts.select("chr", F.col("contact_st").alias("start"), F.col("contact_en").alias("end"), "contact_count")
    out = windows.join(stored, ["chr", "start", "end"], "left").withColumn("contact", F.coalesce("contact_count", F.lit(0.0)))
    out = out.filter(~F.isnan("contact")).drop("contact_count")
    for name, table in signals.items():
        first = F.floor(F.col("start") / binsize)
        frames = windows.select("chr", "start", (first + skip.get(name, 0)).alias("lo"), (first + bins - 1).alias("hi"))
        items = table.select("chr", F.col("bin").alias("pos"), F.col("total").cast(f"decimal(28,{SCALE})").alias("total"))
        sums = window_totals(frames, items, ["total"], width=4_096)
        out = out.join(sums.select("chr", "start", F.col("total").cast("double").alias(name)), ["chr", "start"])
    return out


def signal_correlation(
    contacts: DataFrame,
    signals: dict[str, DataFrame],
    grid: DataFrame,
    binsize: int,
    bins: int,
    sample: int | None = None,
    skip: dict[str, int] | None = None,
    seed: int = 1,
) -> DataFrame:
    """(signal, pearson, spearman) of the contact between the ends of windows with the signals inside.

    All windows of the grid count; with ``sample``, so many of them.
    """
    windows = grid.select("chr", "pos")
    drawn = cut_lineage(windows if sample is None else hash_sample(windows, ["chr", "pos"], sample, (), seed))
    table = cut_lineage(window_signals(contacts, signals, drawn, binsize, bins, skip or {}))
    parts = [rank_correlation(table, "contact", n).select(F.lit(n).alias("signal"), "pearson", "spearman") for n in signals]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- validation ---------------------------------------------------------------------------------


def r_squared(predictions: DataFrame) -> DataFrame:
    """Per chromosome, with the prediction taken as the reference series."""
    error = F.sum((F.col("predicted") - F.col("contact_count")) ** 2)
    spread = F.var_pop("predicted") * F.count(F.lit(1))
    return predictions.groupBy("chr").agg((1 - F.try_divide(error, spread)).alias("r2"))


def _indexed(predictions: DataFrame, binsize: int) -> DataFrame:
    """Cells (chr, i, j, real, pred) of the upper triangle in the compared band."""
    reach = REACH // binsize
    cells = predictions.select(
        "chr",
        F.floor(F.least("contact_st", "contact_en") / binsize).alias("i"),
        F.floor(F.greatest("contact_st", "contact_en") / binsize).alias("j"),
        F.nanvl(F.coalesce("contact_count", F.lit(0.0)), F.lit(0.0)).alias("real"),
        F.nanvl(F.coalesce("predicted", F.lit(0.0)), F.lit(0.0)).alias("pred"),
    )
    return cells.filter((F.col("j") - F.col("i") > 2) & (F.col("j") - F.col("i") < reach))


def _extent(predictions: DataFrame, binsize: int) -> DataFrame:
    """(chr, lo, hi): first and last bin of each chromosome's matrix."""
    return predictions.groupBy("chr").agg(
        F.floor(F.min("contact_st") / binsize).alias("lo"), F.floor(F.max("contact_en") / binsize).alias("hi")
    )


#: Bins on a side of a tile of ``smooth``.
TILE = 256


def _tile_sums(h: int, reach: int):
    """For one tile's cells: the sums of all squares that hold one, a row (chr, i, cells) per matrix row."""
    side = TILE

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        chromosome, ti, tj = (k.as_py() for k in key)
        i, j, real, pred = (table.column(c).to_numpy() for c in ("i", "j", "real", "pred"))
        # the part of the tile that its cells reach, and a margin for the squares around it
        top, left = max(ti * side, i.min() - h), max(tj * side, j.min() - h)
        height = min(ti * side + side - 1, i.max() + h) - top + 1
        width = min(tj * side + side - 1, j.max() + h) - left + 1
        shape = (height + 2 * h, width + 2 * h)
        at = (i - top + h) * shape[1] + (j - left + h)

        def square(weights=None):
            cells = np.bincount(at, weights, shape[0] * shape[1]).reshape(shape)
            rows = sum(cells[k : k + height] for k in range(2 * h + 1))
            return sum(rows[:, k : k + width] for k in range(2 * h + 1))

        gap = (left + np.arange(width))[None, :] - (top + np.arange(height))[:, None]
        x, y = np.nonzero((square() > 0) & (gap > 2 + h) & (gap < reach - h))
        found = pa.StructArray.from_arrays([pa.array(v) for v in (y + left, square(real)[x, y], square(pred)[x, y])], ["j", "real", "pred"])
        rows, starts = np.unique(x, return_index=True)
        cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), found)
        return pa.table({"chr": pa.array([chromosome] * len(rows), pa.string()), "i": pa.array(rows + top, pa.int64()), "cells": cells})

    return sums


def smooth(predictions: DataFrame, binsize: int, h: int) -> DataFrame:
    """Mean over the (2h+1) x (2h+1) neighbourhood, clipped at the matrix border: (chr, i, j, real, pred).

    Only distances ``2 + h < d < reach - h`` are kept.  Cells are merged, then dealt to square tiles, those within
    ``h`` of a border also to the next tile; a tile is summed in its task, so a cell is shuffled about once, whatever ``h``.
    """
    cells = _indexed(predictions, binsize)
    if h == 0:
        return cells
    reach = REACH // binsize
    merged = cells.groupBy("chr", "i", "j").agg(F.sum("real").alias("real"), F.sum("pred").alias("pred"))
    # cells near the diagonal reach neighbourhoods through the mirrored triangle as well
    both = F.array(F.struct("i", "j"), F.when(F.col("j") - F.col("i") <= 2 * h, F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    both = merged.select("chr", F.explode(F.array_compact(both)).alias("_c"), "real", "pred").select("chr", "_c.i", "_c.j", "real", "pred")

    def tiles(axis: str) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(F.col(axis) - h, F.lit(0)) / TILE), F.floor((F.col(axis) + h) / TILE)))

    apart = (F.col("tj") - F.col("ti")) * TILE
    dealt = both.withColumn("ti", tiles("i")).withColumn("tj", tiles("j")).filter((apart + TILE - 1 > 2 + h) & (apart - TILE + 1 < reach - h))
    sums = dealt.groupBy("chr", "ti", "tj").applyInArrow(_tile_sums(h, reach), "chr string, i bigint, cells array<struct<j: bigint, real: double, pred: double>>")
    summed = sums.select("chr", "i", F.inline("cells"))
    sized = lookup(summed, _extent(predictions, binsize).select("chr", "hi"), ["chr"], ["hi"]).filter(
        (F.col("i") <= F.col("hi")) & (F.col("j") <= F.col("hi"))
    )

    def covered(c: str) -> Column:
        return F.least(F.col(c) + h, F.col("hi")) - F.greatest(F.col(c) - h, F.lit(0)) + 1

    area = covered("i") * covered("j")
    return sized.select("chr", "i", "j", (F.col("real") / area).alias("real"), (F.col("pred") / area).alias("pred"))


def _scc(cells: DataFrame, keys: list[str], copies: int) -> DataFrame:
    """Stratum-adjusted correlation of cells (keys, d, real, pred), each standing for ``copies`` matrix cells.

    The stratum weight is n times the variance of {1/n, ..., n/n}, that is (n + 1) / 12: randomly broken
    ties of the rank transform do not change it.
    """
    strata = (
        cells.filter((F.col("real") != 0) | (F.col("pred") != 0))
        .groupBy(*keys, "d")
        .agg(
            F.corr("real", "pred").alias("corr"),
            ((F.count(F.lit(1)) * copies + 1) / 12).alias("weight"),
            (F.min("real") == F.max("real")).alias("flat_real"),
            (F.min("pred") == F.max("pred")).alias("flat_pred"),
        )
        .filter(~F.col("flat_real") & ~F.col("flat_pred"))
    )
    return strata.groupBy(*keys).agg((F.sum(F.col("corr") * F.col("weight")) / F.sum("weight")).alias("scc"))


def scc(predictions: DataFrame, binsize: int, h: int) -> DataFrame:
    """Stratum-adjusted correlation per chromosome after smoothing with ``h``."""
    extent = _extent(predictions, binsize).select("chr", (F.col("hi") - F.col("lo") - 2).alias("_top"))
    cells = smooth(predictions, binsize, h).withColumn("d", F.col("j") - F.col("i"))
    # distances beyond the data are left out; that bound is one number per chromosome
    strata = lookup(cells, extent, ["chr"], ["_top"]).filter((F.col("d") >= 1) & (F.col("d") <= F.col("_top")))
    return _scc(strata, ["chr"], 2)


def smoothing_search(
    predictions: DataFrame, binsize: int, largest: int = 10, rounds: int = 10, share: float = 0.1, seed: int = 1, least_gain: float = 0.01
) -> DataFrame:
    """(h, mean_scc, gain, stop): SCC averaged over random subsamples for each smoothing parameter.

    A cell and its mirror image have one hash each. A round takes those whose hash falls into its range, ``share`` of
    all hashes; ranges follow each other (and start over), so with ``rounds * share`` up to 1 a cell is in one round at most. Nothing
    is counted beforehand, copied for each round or written: a smoothed map is summed as it is made.

    The search ends with the first ``stop``, where the score gains less than ``least_gain``; the parameter
    to use is the one before it.
    """
    span = 1 << 52
    width = int(share * span)
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), "chr", F.col("i").cast("string"), F.col("j").cast("string")))
    rows: list[tuple] = []
    for h in range(largest + 1):
        cells = smooth(predictions, binsize, h).filter((F.col("real") != 0) | (F.col("pred") != 0))
        hashes = F.array(*[F.conv(F.substring(code, at, 13), 16, 10).cast("bigint") for at in (1, 14)])
        taken = F.transform(hashes, lambda u: F.filter(F.sequence(F.lit(1), F.lit(rounds)), lambda k: F.pmod(u - (k - 1) * F.lit(width), F.lit(span)) < width))
        drawn = cells.select((F.col("j") - F.col("i")).alias("d"), "real", "pred", F.explode(F.flatten(taken)).alias("round"))
        scores = _scc(drawn, ["round"], 1)
        mean = scores.agg(F.round(F.avg("scc"), 4)).first()[0]  # one number for each parameter
        before = rows[-1][1] if rows else None
        gain = None if mean is None or before is None else round(mean - before, 6)
        stop = gain is not None and gain < least_gain
        rows.append((h, mean, gain, stop))
        if stop:
            break
    return predictions.sparkSession.createDataFrame(rows, "h int, mean_scc double, gain double, stop boolean")


def _dense_pairs(extent: DataFrame, binsize: int) -> DataFrame:
    """(chr, k): ordered cells of the band whose one-based indices lie strictly between first and last bin."""
    reach = REACH // binsize
    n = F.col("hi") - F.col("lo") - 1
    # sum over d = 3..reach of 2 max(n - d, 0)
    top = F.least(F.lit(reach).cast("bigint"), n)
    terms = F.greatest(top - 2, F.lit(0))
    return extent.select("chr", (2 * (terms * n - (top * (top + 1) / 2 - 3) * (terms > 0).cast("int"))).cast("double").alias("k"))


def band_errors(predictions: DataFrame, binsize: int) -> DataFrame:
    """RMSE, MAE and MAPE per chromosome over the compared band, empty cells included in the first two."""
    error = F.col("real") - F.col("pred")
    sums = _indexed(predictions, binsize).groupBy("chr").agg(
        (2 * F.sum(error * error)).alias("_sq"),
        (2 * F.sum(F.abs(error))).alias("_ab"),
        F.sum(F.when(F.col("real") != 0, F.abs(error / F.col("real")))).alias("_rel"),
        F.count_if(F.col("real") != 0).alias("_n"),
    )
    dense = _dense_pairs(_extent(predictions, binsize), binsize)
    return sums.join(dense, "chr").select(
        "chr",
        F.sqrt(F.try_divide("_sq", "k")).alias("rmse"),
        F.try_divide("_ab", "k").alias("mae"),
        F.try_divide("_rel", "_n").alias("mape"),
    )


def paired_bins(a: DataFrame, b: DataFrame, low: int, high: int) -> DataFrame:
    """Distinct (chr, i, j), i < j, with one bin of ``a`` and one of ``b`` and ``low < j - i < high``.

    Bins of ``a`` are offered to the neighbouring buckets of width ``high``;
    distinct bins bound what meets in a bucket by the band itself.
    """
    left = a.select("chr", "bin").distinct().select(
        "chr", F.col("bin").alias("x"), F.explode(F.array(*[F.floor(F.col("bin") / high) + s for s in (-1, 0, 1)])).alias("_b")
    )
    right = b.select("chr", "bin").distinct().select("chr", F.col("bin").alias("y"), F.floor(F.col("bin") / high).alias("_b"))
    gap = F.abs(F.col("x") - F.col("y"))
    return (
        left.join(right, ["chr", "_b"])
        .filter((gap > low) & (gap < high))
        .select("chr", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        .distinct()
    )


def paired_errors(predictions: DataFrame, promoters: DataFrame, enhancers: DataFrame, binsize: int) -> DataFrame:
    """RMSE, MAE and MAPE per chromosome over promoter-enhancer cells (tables chr, position).

    MAE and MAPE are both divided by the number of cells that are non-zero in either map. Pairs are not
    formed: errors come from stored cells, the number of all pairs from running totals over the bins.
    """
    reach = REACH // binsize

    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select("chr", F.floor(F.col("position") / binsize).alias("bin"), F.lit(1).alias(name)).distinct()

    extent = _extent(predictions, binsize)
    flags = marked(promoters, "is_p").unionByName(marked(enhancers, "is_e"), allowMissingColumns=True)
    flags = flags.groupBy("chr", "bin").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("is_p", "is_e")])
    # one-based indices strictly between the first and the last bin
    inner = lookup(flags, extent, ["chr"], ["lo", "hi"]).filter((F.col("bin") >= F.col("lo")) & (F.col("bin") + 1 < F.col("hi")))
    inner = cut_lineage(inner.select("chr", "bin", "is_p", "is_e", (F.col("is_p") * F.col("is_e")).alias("is_b")))

    windows = inner.withColumns({"lo": F.col("bin") + 3, "hi": F.col("bin") + (reach - 1)})
    items = inner.select("chr", F.col("bin").alias("pos"), *[F.col(f"is_{c}").cast("bigint").alias(f"n_{c}") for c in "peb"])
    ahead = window_totals(windows, items, ["n_p", "n_e", "n_b"], width=4_096)
    # a pair with both marks on both sides is met twice
    met = F.col("is_p") * F.col("n_e") + F.col("is_e") * F.col("n_p") - F.col("is_b") * F.col("n_b")
    counts = ahead.groupBy("chr").agg(F.sum(met).alias("_k")).filter("_k > 0")

    def at(axis: str) -> DataFrame:
        return inner.select("chr", F.col("bin").alias(axis), F.col("is_p").alias(f"p_{axis}"), F.col("is_e").alias(f"e_{axis}"))

    cells = _indexed(predictions, binsize).join(at("i"), ["chr", "i"]).join(at("j"), ["chr", "j"])
    cells = cells.filter("(p_i = 1 AND e_j = 1) OR (e_i = 1 AND p_j = 1)")
    error = F.col("real") - F.col("pred")
    errors = cells.groupBy("chr").agg(
        F.sum(error * error).alias("_sq"),
        F.sum(F.abs(error)).alias("_ab"),
        F.sum(F.when(F.col("real") != 0, F.abs(error / F.col("real"))).otherwise(0.0)).alias("_rel"),
        F.count_if((F.col("real") != 0) | (F.col("pred") != 0)).alias("_m"),
    )
    sums = counts.join(errors, "chr", "left").na.fill(0, ["_sq", "_ab", "_rel", "_m"])
    return sums.select(
        "chr",
        F.sqrt(F.col("_sq") / F.col("_k")).alias("pe_rmse"),
        F.try_divide("_ab", "_m").alias("pe_mae"),
        F.try_divide("_rel", "_m").alias("pe_mape"),
    )


def mean_row_correlation(predictions: DataFrame, binsize: int) -> DataFrame:
    """Mean over matrix rows of the Pearson correlation along the whole row, per chromosome."""
    cells = _indexed(predictions, binsize)
    ends = F.explode(F.array("i", "j")).alias("row")
    sums = cells.select("chr", ends, "real", "pred").groupBy("chr", "row").agg(
        F.sum("real").alias("x"),
        F.sum("pred").alias("y"),
        F.sum(F.col("real") * F.col("pred")).alias("xy"),
        F.sum(F.col("real") * F.col("real")).alias("xx"),
        F.sum(F.col("pred") * F.col("pred")).alias("yy"),
    )
    sized = lookup(sums, _extent(predictions, binsize).select("chr", (F.col("hi") + 1).alias("n")), ["chr"], ["n"])
    vx = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    vy = F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)
    return sized.filter((vx > 0) & (vy > 0)).groupBy("chr").agg(F.avg(corr).alias("corr"))


def metrics_row(predictions: DataFrame, binsize: int, h: int, promoters: DataFrame, enhancers: DataFrame) -> DataFrame:
    """All validation measures, one row per chromosome."""
    row = mean_row_correlation(predictions, binsize)
    for part in (
        scc(predictions, binsize, h),
        band_errors(predictions, binsize),
        paired_errors(predictions, promoters, enhancers, binsize),
    ):
        row = row.join(part, "chr", "left")
    return row


def _lined(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """``children`` (weight ``w``) plus ``lo``, ``hi``, ``whole`` and ``n``: their stretch of the parent's line, its length, its children.

    Sums run in a fixed order, so a rerun gives the same line.
    """
    window = Window.partitionBy(*parent).orderBy(*order)
    upto = children.withColumn("hi", F.sum("w").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = upto.withColumn("lo", F.coalesce(F.lag("hi").over(window), F.lit(0.0)))
    every = Window.partitionBy(*parent)
    return upto.withColumn("whole", F.max("hi").over(every)).withColumn("n", F.count(F.lit(1)).over(every))


def _fall(draws: DataFrame, lined: DataFrame, parent: list[str], level: int, seed: int) -> DataFrame:
    """Each draw falls to one child of the node it has reached, by a hash of its own for the level.

    The line of a node is cut into as many slices as it has children, and at least 64: a draw looks at two children on
    average, and the draws of a heavy node are spread over its slices.
    """
    slices = F.greatest(F.col("n"), F.lit(64))
    cut = lambda at: F.least(F.floor(at * slices), slices - 1)
    shares = lined.withColumn("lo", F.col("lo") / F.col("whole")).withColumn("hi", F.col("hi") / F.col("whole")).filter("lo < hi")
    spread = shares.withColumn("_slice", F.explode(F.sequence(cut(F.col("lo")), cut(F.col("hi"))))).drop("w", "whole", "n")
    sizes = lined.select(*parent, "n").distinct()
    known = draws.join(sizes, parent) if parent else draws.withColumn("n", F.coalesce(sizes.scalar(), F.lit(0)))
    # 52 bits, so every value is a double below 1
    point = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(level)), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    placed = known.withColumn("_u", point).withColumn("_slice", cut(F.col("_u"))).drop("n")
    return placed.join(spread, [*parent, "_slice"]).filter((F.col("lo") <= F.col("_u")) & (F.col("_u") < F.col("hi"))).drop("_slice", "_u", "lo", "hi")


def downsample(contacts: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Redraw ``size`` contacts with replacement, each cell in proportion to its count.

    Every draw falls down a tree: to a chromosome, to a bucket of it, to a cell, each time in proportion to the
    weights below. A share is taken within its own node, so counts of any sizes stand next to each other. Cells with counts of 0
    or NaN are never drawn; an infinite count is an error; without positive counts there are no rows.
    """
    count = F.col("contact_count").cast("double")
    weight = F.when(count == float("inf"), F.raise_error(F.lit("a count is infinite"))).otherwise(count)
    weighed = contacts.filter((count > 0) & ~F.isnan(count)).select(*PAIR, weight.alias("w"), bucket_of("contact_st").alias("_b"))
    cells = cut_lineage(_lined(weighed, ["chr", "_b"], ["contact_st", "contact_en", "w"]))
    buckets = cut_lineage(_lined(cells.groupBy("chr", "_b").agg(F.max("hi").alias("w")), ["chr"], ["_b"]))
    # one row per chromosome
    chromosomes = cut_lineage(_lined(buckets.groupBy("chr").agg(F.max("hi").alias("w")), [], ["chr"]))
    draws = contacts.sparkSession.range(size)
    for level, (lined, parent) in enumerate([(chromosomes, []), (buckets, ["chr"]), (cells, ["chr", "_b"])], 1):
        draws = _fall(draws, lined, parent, level, seed)
    return draws.groupBy(*PAIR).agg(F.count(F.lit(1)).cast("double").alias("contact_count"))


def diagonal_tiles(predictions: DataFrame, binsize: int, length: int = 1_500_000, step: int = 750_000) -> DataFrame:
    """Cells (chr, tile, row, col, value) of square tiles along the diagonal: observed above it, predicted below.

    A tile starts every ``step`` as long as it ends before the matrix does; a
    cell is copied only to the tiles that hold both its ends.
    """
    n, s = length // binsize, step // binsize
    extent = predictions.groupBy("chr").agg(F.min("contact_st").alias("_lo"), F.max("contact_en").alias("_hi"))
    extent = extent.select("chr", "_lo", (F.floor((F.col("_hi") - F.col("_lo")) / binsize) + 1 - n).alias("_limit"))
    cells = lookup(predictions, extent, ["chr"], ["_lo", "_limit"]).select(
        "chr",
        "_limit",
        F.floor((F.col("contact_st") - F.col("_lo")) / binsize).alias("i"),
        F.floor((F.col("contact_en") - F.col("_lo")) / binsize).alias("j"),
        "contact_count",
        "predicted",
    )
    first = F.greatest(F.ceil((F.col("j") - n + 1) / s), F.lit(0))
    last = F.least(F.floor(F.col("i") / s), F.ceil(F.col("_limit") / s) - 1)
    tiles = cells.filter(first <= last).withColumn("tile", F.explode(F.sequence(first, last)))
    at = {c: F.col(c) - F.col("tile") * s for c in ("i", "j")}
    sides = F.array(
        F.struct(at["i"].alias("row"), at["j"].alias("col"), F.col("contact_count").alias("value")),
        F.struct(at["j"].alias("row"), at["i"].alias("col"), F.col("predicted").alias("value")),
    )
    # on the diagonal the prediction stands
    shown = F.when(F.col("i") == F.col("j"), F.slice(sides, 2, 1)).otherwise(sides)
    return tiles.select("chr", "tile", F.explode(shown).alias("_c")).select("chr", "tile", "_c.row", "_c.col", "_c.value")
