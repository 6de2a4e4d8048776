"""Deletions, duplications and inversions of a region, and the comparison of two maps.

Each transform takes and returns a table, so a rearrangement is a chain of
``df.transform`` steps; a region is (chr, start, end).
"""

from __future__ import annotations

import math

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.contacts import PAIR, align_matrices
from contactloom.operators.ordered import lookup, ordered_counts, quantiles_of
from contactloom.session import cut_lineage


class Region(NamedTuple):
    chr: str
    start: int
    end: int

    @property
    def length(self) -> int:
        return self.end - self.start

    def here(self) -> Column:
        return F.col("chr") == self.chr

    def inside(self, column: str) -> Column:
        """Strictly inside."""
        return (F.col(column) > self.start) & (F.col(column) < self.end)


def _shift(columns: Sequence[str], when: Column, by: int) -> dict[str, Column]:
    return {c: F.when(when, F.col(c) + by).otherwise(F.col(c)) for c in columns}


def _with_dist(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.col("contact_en") - F.col("contact_st"))


def delete_contacts(contacts: DataFrame, region: Region) -> DataFrame:
    """Contacts with an end strictly inside vanish; positions from ``start`` on move left."""
    hit = region.here() & (region.inside("contact_st") | region.inside("contact_en"))
    moved = {
        c: F.when(region.here() & (F.col(c) >= region.start), F.col(c) - region.length).otherwise(F.col(c))
        for c in ("contact_st", "contact_en")
    }
    return _with_dist(contacts.filter(~hit).withColumns(moved))


def duplicate_contacts(contacts: DataFrame, region: Region) -> DataFrame:
    """Positions from ``start`` on move right; contacts touching the inside are copied, both ends moved.

    The distance of every row is that of its coordinates.
    """
    touched = region.here() & (region.inside("contact_st") | region.inside("contact_en"))
    ends = ("contact_st", "contact_en")
    copies = contacts.filter(touched).withColumns({c: F.col(c) + region.length for c in ends})
    moved = contacts.withColumns(
        {c: F.when(region.here() & (F.col(c) >= region.start), F.col(c) + region.length).otherwise(F.col(c)) for c in ends}
    )
    return _with_dist(moved.unionByName(copies))


def delete_peaks(track: DataFrame, region: Region, neighbour: int = 0) -> DataFrame:
    """Contained peaks vanish, later ones move left; optionally peaks near the junction vanish too."""
    contained = region.here() & (F.col("start") >= region.start) & (F.col("end") <= region.end)
    later = region.here() & (F.col("end") > region.end)
    kept = track.filter(~contained).withColumns(_shift(("start", "end", "mids"), later, -region.length))
    if neighbour:
        kept = kept.filter(~(region.here() & (F.abs(F.col("mids") - region.start) <= neighbour)))
    return kept


def duplicate_peaks(track: DataFrame, region: Region) -> DataFrame:
    """Peaks spanning the region vanish, strictly contained ones are copied, those past its end move right."""
    coords = ("start", "end", "mids")
    spans = region.here() & (F.col("start") < region.start) & (F.col("end") > region.end)
    within = region.here() & (F.col("start") > region.start) & (F.col("end") < region.end)
    later = region.here() & (F.col("mids") > region.end)
    copies = track.filter(within).withColumns({c: F.col(c) + region.length for c in coords})
    return track.filter(~spans).withColumns(_shift(coords, later, region.length)).unionByName(copies)


def invert_peaks(track: DataFrame, region: Region, swap_orientation: bool = True) -> DataFrame:
    """Contained peaks are mirrored and their strands swapped; peaks cut by a boundary vanish."""
    contained = region.here() & (F.col("start") >= region.start) & (F.col("end") <= region.end)
    overlaps = region.here() & (F.col("start") < region.end) & (F.col("end") > region.start)
    mirror = region.start + region.end
    changed = {
        "start": F.when(contained, mirror - F.col("end")).otherwise(F.col("start")),
        "end": F.when(contained, mirror - F.col("start")).otherwise(F.col("end")),
    }
    if swap_orientation and "plus_orientation" in track.columns:
        plus, minus = F.col("plus_orientation"), F.col("minus_orientation")
        changed["plus_orientation"] = F.when(contained, minus).otherwise(plus)
        changed["minus_orientation"] = F.when(contained, plus).otherwise(minus)
    kept = track.filter(~overlaps | contained).withColumns(changed)
    return kept.withColumn("mids", F.floor((F.col("start") + F.col("end")) / 2))


def annotate_strand(genes: DataFrame, strands: DataFrame) -> DataFrame:
    """Genes with the strand (+1 or -1) of a table (gene, Strand); null where the gene is unknown."""
    return genes.join(strands.select("gene", F.col("Strand").alias("strand_sign")), "gene", "left")


def _after_last_overlap(genes: DataFrame, region: Region) -> Column:
    """Genes sorted behind the last gene that touches the region (or behind its start if none does)."""
    touching = genes.filter(
        region.here() & (F.col("start") <= region.end) & (F.col("end") >= region.start)
    ).agg(F.max(F.struct("start", "end")).alias("last"))
    last = F.coalesce(touching.scalar(), F.struct(F.lit(region.start - 1).cast("bigint").alias("start"), F.lit(2**62).alias("end")))
    return region.here() & (F.struct("start", "end") > last)


def delete_genes(genes: DataFrame, region: Region, promoter: int = 2_000) -> DataFrame:
    """Genes whose promoter side (2 kb from their start) is hit vanish; genes behind the region move left.

    Expects ``strand_sign`` from ``annotate_strand``; genes of unknown strand are never dropped.
    """
    start, end, sign = F.col("start"), F.col("end"), F.col("strand_sign")
    hit = ((sign == 1) & (start < region.end) & (start + promoter > region.start)) | (
        (sign == -1) & (end > region.start) & (end - promoter < region.end)
    )
    moved = _shift(("start", "end", "mids"), _after_last_overlap(genes, region), -region.length)
    return genes.filter(~(region.here() & F.coalesce(hit, F.lit(False)))).withColumns(moved)


def duplicate_genes(genes: DataFrame, region: Region, promoter: int = 2_000) -> DataFrame:
    """Genes whose promoter is cut at the region's end vanish, strictly contained ones are copied, later ones move."""
    start, end, sign = F.col("start"), F.col("end"), F.col("strand_sign")
    cut = ((sign == 1) & (start + promoter > region.end) & (start < region.end)) | (
        (sign == -1) & (end - promoter < region.end) & (end > region.end)
    )
    coords = ("start", "end", "mids")
    within = region.here() & (start > region.start) & (end < region.end)
    copies = genes.filter(within).withColumns({c: F.col(c) + region.length for c in coords})
    moved = _shift(coords, _after_last_overlap(genes, region), region.length)
    return genes.filter(~(region.here() & F.coalesce(cut, F.lit(False)))).withColumns(moved).unionByName(copies)


def delete_eigenvector(track: DataFrame, region: Region, binsize: int, leftover: int = 0) -> tuple[DataFrame, int]:
    """Bins of the region removed and the rest renumbered; returns the track and the base pairs left over.

    The deletion is rounded to whole bins (at least one); repeated deletions
    may not drift by more than one bin.
    """
    first = region.start // binsize
    count = max(region.length // binsize, 1)
    leftover += region.length - count * binsize
    if leftover > binsize:
        raise ValueError("deletions have drifted by more than one eigenvector bin")
    gone = region.here() & (F.col("bin") >= first) & (F.col("bin") < first + count)
    later = region.here() & (F.col("bin") >= first + count)
    return track.filter(~gone).withColumns(_shift(("bin",), later, -count)), leftover


def lift_back_deletions(contacts: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Coordinates of a map with deletions back on the original genome; regions are applied in ascending order."""
    for region in sorted(regions):
        contacts = contacts.withColumns(
            {
                c: F.when(region.here() & (F.col(c) >= region.start), F.col(c) + region.length).otherwise(F.col(c))
                for c in ("contact_st", "contact_en")
            }
        )
    return _with_dist(contacts)


def lift_back_duplications(contacts: DataFrame, regions: Sequence[Region]) -> DataFrame:
    """Second copies are counted with the first ones, and all coordinates return to the original genome."""
    for region in sorted(regions, reverse=True):
        contacts = contacts.withColumns(
            {
                c: F.when(region.here() & (F.col(c) >= region.start + region.length), F.col(c) - region.length).otherwise(F.col(c))
                for c in ("contact_st", "contact_en")
            }
        )
    return _with_dist(contacts.groupBy(*PAIR).agg(F.sum("contact_count").alias("contact_count")))


# ---- comparison of two maps ---------------------------------------------------------------------


def depth_matched_difference(wt: DataFrame, mut: DataFrame, region: Region) -> DataFrame:
    """Mutant counts scaled to the wild-type depth outside the region, minus wild type; 0 in the deleted bins."""
    # read for the factor and for the cells
    cells = cut_lineage(align_matrices(wt, mut))
    lost = region.here() & (
        F.col("contact_st").between(region.start, region.end) | F.col("contact_en").between(region.start, region.end)
    )
    factor = cells.filter(~lost).agg((F.sum("wt") / F.sum("mut")).alias("f")).scalar()
    return cells.withColumn("wt", F.when(lost, 0.0).otherwise(F.col("wt"))).withColumn(
        "difference", F.when(lost, 0.0).otherwise(F.col("mut") * factor - F.col("wt"))
    ).drop("mut")


def normalize_by_diagonal(cells: DataFrame, binsize: int, value: str = "difference", reference: str = "wt") -> DataFrame:
    """Divide ``value`` by the mean of ``reference`` over the whole diagonal, empty cells included."""
    cells = cells.withColumn("dist", F.col("contact_en") - F.col("contact_st"))
    size = cells.groupBy("chr").agg(
        ((F.max("contact_en") - F.min("contact_st")) / binsize + 1).cast("bigint").alias("n_bins")
    )
    means = cells.groupBy("chr", "dist").agg(F.sum(reference).alias("_s")).join(size, "chr")
    means = means.select("chr", "dist", (F.col("_s") / (F.col("n_bins") - F.col("dist") / binsize)).alias("_mean"))
    found = lookup(cells, means, ["chr", "dist"], ["_mean"])
    return found.withColumn(value, F.try_divide(value, "_mean")).drop("_mean")


def fold_change(wt: DataFrame, mut: DataFrame, capture: Region) -> DataFrame:
    """Mutant over wild type inside a capture window; unchanged cells (exactly 1) are null."""
    cells = align_matrices(wt, mut).filter(
        capture.here()
        & F.col("contact_st").between(capture.start, capture.end)
        & F.col("contact_en").between(capture.start, capture.end)
    )
    return cells.withColumn("fold_change", F.nullif(F.try_divide("mut", "wt"), F.lit(1.0)))


def ectopic_scores(cells: DataFrame, value: str = "difference", least: int = 10) -> DataFrame:
    """z-score of each non-zero cell against its diagonal, trimmed strictly between the 4th and 96th percentile.

    Diagonals with fewer than ``least`` cells left after trimming are skipped.
    """
    key = ["chr", "dist"]
    present = cells.withColumn("dist", F.col("contact_en") - F.col("contact_st")).filter((F.col(value) != 0) & ~F.isnan(value))
    present = cut_lineage(present)
    ranked = cut_lineage(ordered_counts(present, key, value))
    limits = quantiles_of(ranked, key, value, {"p4": 0.04, "p96": 0.96}).select(*key, "p4", "p96")
    # the trimmed moments come from the distinct values of each diagonal and their counts
    counted = ranked.join(limits, key)
    inner = counted.filter((F.col(value) > F.col("p4")) & (F.col(value) < F.col("p96")))
    # measured from the middle of the trimmed range, so that squares of large values don't cancel
    weight, middle = F.col("cnt"), F.col("p4") + (F.col("p96") - F.col("p4")) / 2
    off = F.col(value) - middle
    moments = inner.groupBy(*key).agg(
        F.sum(weight).alias("_n"), F.sum(off * weight).alias("_s"), F.sum(off * off * weight).alias("_q"), F.first(middle).alias("_middle")
    )
    mean = F.col("_s") / F.col("_n")
    stats = moments.filter(F.col("_n") >= least).select(
        *key, (F.col("_middle") + mean).alias("_mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("_std")
    )
    found = lookup(present, stats, key, ["_mean", "_std"])
    return found.filter(F.col("_mean").isNotNull()).select(
        *PAIR, "dist", value, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std")).alias("z")
    )


def ectopic_overlap(real: DataFrame, predicted: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """One row: cells above ``cutoff`` in each map and in both."""
    both = real.select(*PAIR, F.col("z").alias("zr")).join(predicted.select(*PAIR, F.col("z").alias("zp")), PAIR, "full_outer")
    r, p = F.coalesce(F.col("zr") > cutoff, F.lit(False)), F.coalesce(F.col("zp") > cutoff, F.lit(False))
    return both.agg(F.count_if(r).alias("n_real"), F.count_if(p).alias("n_predicted"), F.count_if(r & p).alias("n_both"))


def permutation_test(real: DataFrame, predicted: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """Observed overlap against a null in which the predicted values are shuffled over their cells.

    Only which cells end up above the cutoff matters, so the overlap of a shuffle
    is hypergeometric: as many draws as there are high predictions, from all
    predicted cells, of which some are high in the real map.  Its exact median and deviation
    need three counts, where shuffling repeats all cells for every replicate.
    """
    high = real.filter(F.col("z") > cutoff).select(*PAIR, F.lit(1).alias("hit"))
    marked = predicted.select(*PAIR, (F.col("z") > cutoff).alias("high")).join(high, PAIR, "left")
    hit, drawn = F.col("hit").isNotNull(), F.coalesce("high", F.lit(False))
    row = marked.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(hit).alias("hits"), F.count_if(drawn).alias("draws"), F.count_if(hit & drawn).alias("observed")
    ).first()
    median, deviation = hypergeometric(row["cells"], row["hits"], row["draws"])
    z = (row["observed"] - median) / deviation if deviation else None
    return real.sparkSession.createDataFrame(
        [(row["observed"], median, deviation, z)], "observed bigint, null_median double, null_std double, z double"
    )


def hypergeometric(cells: int, hits: int, draws: int) -> tuple[float, float]:
    """Median and deviation of the hits among ``draws`` of ``cells`` of which ``hits`` are hits."""
    if cells < 2:
        return float(min(hits, draws)), 0.0
    share = hits / cells
    deviation = math.sqrt(draws * share * (1 - share) * (cells - draws) / (cells - 1))
    low, high = max(0, draws + hits - cells), min(hits, draws)
    # what lies farther out than twelve deviations doesn't move the median
    first = max(low, math.floor(draws * share - 12 * deviation) - 1)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    whole, total = choose(cells, draws), 0.0
    for k in range(first, high + 1):
        total += math.exp(choose(hits, k) + choose(cells - hits, draws - k) - whole)
        if total >= 0.5:
            return float(k), deviation
    return float(high), deviation
