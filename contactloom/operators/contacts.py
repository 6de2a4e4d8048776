"""Filters, projections, grids, matrix joins and normalisation of contact tables.

A contact table has ``chr, contact_st, contact_en, contact_count, dist``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ordered import hash_order, hash_sample, lookup, previous_row
from contactloom.session import cut_lineage

PAIR = ["chr", "contact_st", "contact_en"]
NOT_FEATURES = ("chr", "contact_st", "contact_en", "contact_count")


def get_contacts(
    contacts: DataFrame, chrom: str, start: int, end: int, mindist: int = 0, maxdist: int | None = None
) -> DataFrame:
    """Contacts of one region: the start bound excludes ``end``, the end bound excludes ``start``."""
    st, en = F.col("contact_st"), F.col("contact_en")
    return contacts.filter(
        (F.col("chr") == chrom)
        & (st >= start)
        & (st < end)
        & (en > start)
        & (en <= end)
        & _distance(mindist, maxdist)
    )


def _distance(mindist: int, maxdist: int | None) -> Column:
    return F.col("dist") >= mindist if maxdist is None else F.col("dist").between(mindist, maxdist)


def within_distance(contacts: DataFrame, mindist: int, maxdist: int | None = None) -> DataFrame:
    return contacts.filter(_distance(mindist, maxdist))


def find_contacts(contacts: DataFrame, wanted: DataFrame, binsize: int, maxdist: int) -> DataFrame:
    """Point lookup for a table (chr, start, end): null where no contact is stored.

    ``valid`` tells whether the request is on the bin grid and shorter than ``maxdist``.
    """
    valid = (F.col("start") % binsize == 0) & (F.col("end") % binsize == 0) & (F.col("end") - F.col("start") < maxdist)
    stored = contacts.select(
        "chr", F.col("contact_st").alias("start"), F.col("contact_en").alias("end"), "contact_count"
    )
    return (
        wanted.withColumn("valid", valid)
        .join(stored, ["chr", "start", "end"], "left")
        .withColumn("contact_count", F.when(F.col("valid"), F.col("contact_count")))
    )


def position_range(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("chr").agg(
        F.min("contact_st").alias("min_position"),
        F.max("contact_en").alias("max_position"),
        F.count(F.lit(1)).alias("n_contacts"),
    )


def drop_nan(contacts: DataFrame, column: str = "contact_count") -> DataFrame:
    return contacts.filter(F.col(column).isNotNull() & ~F.isnan(column))


def feature_names(df: DataFrame) -> list[str]:
    """All columns that may serve as model features (the distance is one of them)."""
    return sorted(c for c in df.columns if c not in NOT_FEATURES)


def select_predictors(df: DataFrame, rule: str, keep: bool = True, names: Sequence[str] | None = None) -> list[str]:
    """Feature names whose regular-expression search agrees with ``keep``."""
    pattern = re.compile(rule)
    return sorted(c for c in (names or feature_names(df)) if (pattern.search(c) is not None) == keep)


def bin_size(contacts: DataFrame) -> DataFrame:
    """One row: smallest non-zero distance between anchors or between neighbouring start positions."""
    places = contacts.select("chr", "contact_st").distinct()
    gaps = previous_row(places, ["chr"], "contact_st", ["contact_st"], []).select(
        (F.col("contact_st") - F.col("prev.contact_st")).alias("d")
    )
    spans = contacts.select((F.col("contact_en") - F.col("contact_st")).alias("d"))
    return gaps.unionByName(spans).filter("d > 0").agg(F.min("d").alias("bin_size"))


def add_chr_prefix(df: DataFrame, column: str = "chr", force: bool = False) -> DataFrame:
    """Prefix chromosome names with ``chr`` unless some name has it already."""
    prefixed = F.concat(F.lit("chr"), F.col(column))
    if force:
        return df.withColumn(column, F.when(F.col(column).startswith("chr"), F.col(column)).otherwise(prefixed))
    already = df.agg(F.coalesce(F.bool_or(F.col(column).startswith("chr")), F.lit(False)).alias("b")).scalar()
    return df.withColumn(column, F.when(already, F.col(column)).otherwise(prefixed))


def drop_chr_prefix(df: DataFrame, column: str = "chr") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, "^chr", ""))


def to_bins(df: DataFrame, binsize: int, origin: int | Column = 0, columns: Sequence[str] = ("contact_st", "contact_en")) -> DataFrame:
    origin = F.lit(origin) if isinstance(origin, int) else origin
    return df.withColumns({f"{c}_bin": F.floor((F.col(c) - origin) / F.lit(binsize)) for c in columns})


def grid_positions(bounds: DataFrame, binsize: int, block: int = 2_048) -> DataFrame:
    """(chr, hi, ..., pos) for every bin of the ranges (chr, lo, hi, ...), produced in blocks spread over the cluster."""
    kept = [c for c in bounds.columns if c != "lo"]
    step = F.lit(binsize * block)
    blocks = bounds.select(*kept, F.explode(F.sequence(F.col("lo"), F.col("hi"), step)).alias("_at"))
    last = F.least(F.col("hi"), F.col("_at") + step - binsize)
    return blocks.repartition("chr", "_at").select(
        *kept, F.explode(F.sequence(F.col("_at"), last, F.lit(binsize))).alias("pos")
    )


def fill_empty(contacts: DataFrame, binsize: int, maxdist: int) -> DataFrame:
    """All bin pairs more than two bins apart and at most ``maxdist``; pairs without a contact count 0."""
    bounds = contacts.groupBy("chr").agg(
        F.least(F.min("contact_st"), F.min("contact_en")).alias("lo"),
        F.greatest(F.max("contact_st"), F.max("contact_en")).alias("hi"),
    )
    near, far = 3 * binsize, maxdist // binsize * binsize
    starts = grid_positions(bounds, binsize).filter(F.col("pos") + near <= F.col("hi"))
    ends = F.sequence(F.col("pos") + near, F.least(F.col("hi"), F.col("pos") + far), F.lit(binsize))
    grid = starts.select("chr", F.col("pos").alias("contact_st"), F.explode(ends).alias("contact_en"))
    return grid.join(contacts.select(*PAIR, "contact_count"), PAIR, "left").select(
        *PAIR,
        F.coalesce("contact_count", F.lit(0.0)).alias("contact_count"),
        (F.col("contact_en") - F.col("contact_st")).alias("dist"),
    )


def region_contacts(regions: DataFrame, binsize: int, mindist: int, maxdist: int) -> DataFrame:
    """Candidate contacts (count 1) between all bins of each region (chr, start, end, ...)."""
    extra = [c for c in regions.columns if c not in ("chr", "start", "end")]

    def snap(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(binsize)) * binsize

    near = -(-mindist // binsize) * binsize
    far = maxdist // binsize * binsize
    bounds = regions.select("chr", *extra, snap("start").alias("lo"), snap("end").alias("hi"))
    starts = grid_positions(bounds, binsize).withColumnRenamed("pos", "contact_st")
    starts = starts.filter(F.col("contact_st") + near <= F.col("hi"))
    ends = F.sequence(F.col("contact_st") + near, F.least(F.col("hi"), F.col("contact_st") + far), F.lit(binsize))
    return starts.select("chr", *extra, "contact_st", F.explode(ends).alias("contact_en")).select(
        "chr",
        *extra,
        "contact_st",
        "contact_en",
        F.lit(1.0).alias("contact_count"),
        (F.col("contact_en") - F.col("contact_st")).alias("dist"),
    )


def flag_near_track(contacts: DataFrame, items: DataFrame, binsize: int, maxdist: int) -> DataFrame:
    """Contacts more than two bins apart with ``with_track``: both anchors in or beside a bin holding an item."""
    home = F.floor(F.col("mids") / F.lit(binsize)) * binsize
    bins = (
        items.select("chr", home.alias("_b"))
        .distinct()
        .select("chr", F.explode(F.array(F.col("_b") - binsize, F.col("_b"), F.col("_b") + binsize)).alias("pos"))
        .distinct()
    )
    kept = within_distance(contacts, 2 * binsize + 1, maxdist)
    at_start = bins.select("chr", F.col("pos").alias("contact_st"), F.lit(True).alias("_s"))
    at_end = bins.select("chr", F.col("pos").alias("contact_en"), F.lit(True).alias("_e"))
    flagged = lookup(kept, at_start, ["chr", "contact_st"], ["_s"])
    flagged = lookup(flagged, at_end, ["chr", "contact_en"], ["_e"])
    return flagged.withColumn("with_track", F.col("_s").isNotNull() & F.col("_e").isNotNull()).drop("_s", "_e")


def balanced_sample(contacts: DataFrame, items: DataFrame, binsize: int, maxdist: int, proportion: int, seed: int = 1) -> DataFrame:
    """All contacts near the track, and ``proportion`` times as many of the others, per chromosome."""
    flagged = cut_lineage(flag_near_track(contacts, items, binsize, maxdist))
    near, rest = flagged.filter("with_track"), flagged.filter("NOT with_track")
    sizes = near.groupBy("chr").agg((F.count(F.lit(1)) * proportion).alias("size"))
    return near.unionByName(hash_sample(rest, PAIR, sizes, ["chr"], seed))


def fixed_size_sample(contacts: DataFrame, size: int, seed: int = 1) -> DataFrame:
    return hash_sample(contacts, PAIR, size, (), seed)


def matrix_cells(upper: DataFrame, binsize: int, chrom: str, start: int, end: int, lower: DataFrame | None = None) -> DataFrame:
    """Cells (i, j, value) of a square region; the lower triangle mirrors ``upper`` or shows ``lower``.

    On the diagonal a value of ``lower`` replaces that of ``upper``.
    """

    def region(df: DataFrame) -> DataFrame:
        inside = df.filter(
            (F.col("chr") == chrom) & F.col("contact_st").between(start, end) & F.col("contact_en").between(start, end)
        )
        binned = to_bins(inside, binsize, start)
        return binned.select(
            F.col("contact_st_bin").alias("i"), F.col("contact_en_bin").alias("j"), F.col("contact_count").alias("value")
        )

    a, b = region(upper), region(upper if lower is None else lower)
    off = a.filter("i < j").unionByName(b.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    diagonal = (
        a.filter("i = j").withColumn("_p", F.lit(0)).unionByName(b.filter("i = j").withColumn("_p", F.lit(1)))
    )
    return off.unionByName(diagonal.groupBy("i", "j").agg(F.max_by("value", "_p").alias("value")))


def align_matrices(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("wt", "mut")) -> DataFrame:
    """Both tables over the union of their cells, 0 where a cell is missing."""
    left = a.select(*PAIR, F.col("contact_count").alias(names[0]))
    right = b.select(*PAIR, F.col("contact_count").alias(names[1]))
    return left.join(right, PAIR, "full_outer").select(
        *PAIR, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]
    )


def coverage_normalize(contacts: DataFrame, maxdist: int, sample: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Divide counts by the mean coverage of start loci; returns (contacts, report per chromosome).

    Coverage is summed before the distance filter; loci with zero coverage are left out of the mean.
    With ``sample``, the mean is that of so many loci per chromosome.
    """
    start_first = F.array_distinct(F.array("contact_st", "contact_en"))
    ends = contacts.select("chr", "contact_st", "contact_count", F.explode(start_first).alias("pos"))
    coverage = ends.groupBy("chr", "pos").agg(
        F.sum("contact_count").alias("total"), F.max((F.col("pos") == F.col("contact_st")).cast("int")).alias("is_start")
    )
    drawn = coverage.filter("is_start = 1")
    if sample is not None:
        draw = Window.partitionBy("chr").orderBy(hash_order(["chr", "pos"], seed))
        drawn = drawn.withColumn("_rn", F.row_number().over(draw)).filter(F.col("_rn") <= sample)
    report = (
        drawn.filter("total <> 0")
        .groupBy("chr")
        .agg(F.avg("total").alias("norm"), (F.stddev_pop("total") / F.avg("total")).alias("cv"), F.count(F.lit(1)).alias("n_loci"))
        .withColumn("uneven", F.col("cv") >= 0.2)
    )
    kept = contacts.filter(F.col("dist") < maxdist)
    scaled = lookup(kept, report.select("chr", "norm"), ["chr"], ["norm"])
    return scaled.withColumn("contact_count", F.col("contact_count") / F.col("norm")).drop("norm"), report


def observed_over_expected(contacts: DataFrame, binsize: int, how: str = "mean", value: str = "contact_count") -> DataFrame:
    """Divide each cell by the mean over its whole diagonal (empty cells included) or by the diagonal's sum."""
    size = contacts.groupBy("chr").agg(
        ((F.max("contact_en") - F.min("contact_st")) / binsize + 1).cast("bigint").alias("n_bins")
    )
    diagonal = contacts.groupBy("chr", "dist").agg(F.sum(value).alias("_sum")).join(size, "chr")
    cells = F.lit(1) if how == "sum" else F.col("n_bins") - F.col("dist") / binsize
    expected = diagonal.select("chr", "dist", (F.col("_sum") / cells).alias("expected"))
    return lookup(contacts, expected, ["chr", "dist"], ["expected"]).withColumn("oe", F.try_divide(value, "expected"))


def to_observed(contacts: DataFrame, expected: DataFrame, coeff: float, value: str = "contact_count") -> DataFrame:
    """Observed/expected values back to counts: times the expected count (chr, dist, expected), over ``coeff``."""
    found = lookup(contacts, expected.select("chr", "dist", "expected"), ["chr", "dist"], ["expected"])
    return found.withColumn("observed", F.col(value) * F.col("expected") / F.lit(float(coeff))).drop("expected")
