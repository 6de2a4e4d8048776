"""Interval tracks: clean-up, overlap, nearest neighbours, orientation, loops, binned sums.

A peak track has ``chr, start, end, sigVal, mids`` and, once oriented,
``plus_orientation, minus_orientation`` (0 where there is no motif).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.ordered import (
    BEFORE,
    UP_TO,
    cumulative_at,
    fixed,
    lookup,
    overlap_pairs,
    place_ranks,
    previous_row,
    window_totals,
)


def midpoint() -> Column:
    return F.floor((F.col("start") + F.col("end")) / 2)


def normalize_peaks(raw: DataFrame) -> DataFrame:
    """Exact duplicates dropped, midpoint added.  Order is a property of sinks, not of the table."""
    return raw.dropDuplicates().withColumn("mids", midpoint())


def duplicate_positions(track: DataFrame, key: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    return track.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def nested_intervals(track: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Per chromosome: intervals starting after and ending before the interval that precedes them.

    Rows are compared in the order (start, end); copies of one interval are merged first, as a
    copy never starts after its twin.
    """
    merged = track.select("chr", F.col(start).alias("start"), F.col(end).alias("end")).distinct()
    seen = previous_row(merged, ["chr"], "start", ["start", "end"], [])
    inside = (F.col("start") > F.col("prev.start")) & (F.col("end") < F.col("prev.end"))
    return seen.groupBy("chr").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("nested"))


def intersect(a: DataFrame, b: DataFrame, merge: bool = True) -> DataFrame:
    """Pairs with ``a.end >= b.start`` and ``a.start < b.end``; columns are prefixed ``a_`` and ``b_``."""
    return _pairs(a, b, (F.col("a_end") >= F.col("b_start")) & (F.col("a_start") < F.col("b_end")), merge)


def stab(track: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs touching on a closed interval (genes or TSS in a region, region queries)."""
    return _pairs(track, regions, (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start")))


def _pairs(a: DataFrame, b: DataFrame, condition: Column, merge: bool = True) -> DataFrame:
    left = a.select("chr", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "chr"])
    right = b.select("chr", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chr"])
    return overlap_pairs(left, right, condition, merge=merge)


def row_ids(track: DataFrame) -> DataFrame:
    """(chr, start, end, first_id, last_id): row numbers in (start, end) order of each distinct interval."""
    by_start = place_ranks(track.select("chr", F.col("start").alias("mids")), ["chr"]).select(
        "chr", F.col("mids").alias("start"), F.col("base").alias("_b1")
    )
    by_end = place_ranks(track.select("chr", "start", F.col("end").alias("mids")), ["chr", "start"])
    ids = by_end.join(by_start, ["chr", "start"])
    first = F.col("_b1") + F.col("base")
    return ids.select("chr", "start", F.col("mids").alias("end"), first.alias("first_id"), (first + F.col("cnt") - 1).alias("last_id"))


def stab_ids(track: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """First and last row number of the intervals touching each region."""
    return stab(row_ids(track), regions).groupBy(f"b_{key}").agg(
        F.min("a_first_id").alias("first_id"), F.max("a_last_id").alias("last_id")
    ).withColumnRenamed(f"b_{key}", key)


def peaks_in_regions(track: DataFrame, regions: DataFrame) -> DataFrame:
    """Peaks whose midpoint lies in a region, both ends included."""
    return _pairs(
        track.withColumn("m", F.col("mids")).withColumnsRenamed({"start": "pstart", "end": "pend"}).withColumns({"start": F.col("m"), "end": F.col("m")}).drop("m"),
        regions,
        F.col("a_mids").between(F.col("b_start"), F.col("b_end")),
    ).drop("a_start", "a_end")


def region_rank_range(track: DataFrame, regions: DataFrame) -> DataFrame:
    """Half-open range of peak ranks (by midpoint) falling in each region, without forming pairs."""
    ends = regions.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("p"), F.lit(BEFORE).alias("side")),
                F.struct(F.col("end").alias("p"), F.lit(UP_TO).alias("side")),
            )
        ).alias("_e"),
    ).select(*regions.columns, "_e.p", "_e.side")
    counted = track.select("chr", F.col("mids").alias("pos"), F.lit(1).cast("bigint").alias("n"))
    at = cumulative_at(ends, counted, ["n"])
    return at.groupBy(*regions.columns).agg(
        F.max(F.when(F.col("side") == BEFORE, F.col("n"))).alias("first_rank"),
        F.max(F.when(F.col("side") == UP_TO, F.col("n"))).alias("end_rank"),
    )


# ---- padding of nearest-neighbour lists ---------------------------------------------------------


def _pad(mids: Column, payload: Sequence[str], count: Column) -> Column:
    """``count`` stand-ins at ``mids``: signal and orientation 0, a transcription start unknown."""
    values = {"mids": mids.cast("bigint"), "TSS": F.lit(None).cast("bigint")}
    item = F.struct(*[values.get(c, F.lit(0.0)).alias(c) for c in payload])
    return F.array_repeat(item, F.greatest(count, F.lit(0)).cast("int"))


def typed_payload(payload: Sequence[str]) -> list[Column]:
    """Payload columns in the types the stand-ins have."""
    whole = ("mids", "TSS")
    return [F.col(c).cast("bigint" if c in whole else "double").alias(c) for c in payload]


def _listed(column: Column, payload: Sequence[str]) -> Column:
    """A neighbour list, empty instead of null."""
    return F.coalesce(column, _pad(F.lit(0), payload, F.lit(0)))


def pad_left(before: Column, n: int, payload: Sequence[str]) -> Column:
    """Nearest items on the left in ascending order, then stand-ins at position 0."""
    real = _listed(before, payload)
    return F.concat(real, _pad(F.lit(0).cast("bigint"), payload, n - F.size(real)))


def pad_right(after: Column, n: int, payload: Sequence[str], point: Column) -> Column:
    """Nearest items on the right, then stand-ins at the last item's midpoint (just past ``point`` if none)."""
    real = _listed(after, payload)
    at = F.when(F.size(real) == 0, point + 1).otherwise(F.element_at(real, -1)["mids"])
    return F.concat(real, _pad(at, payload, n - F.size(real)))


def boundary_lists(
    after_start: Column, before_end: Column, inside: Column, n: int, payload: Sequence[str], start: Column, end: Column
) -> tuple[Column, Column]:
    """The items nearest to each boundary of a window, from the neighbour lists of its two ends.

    ``inside`` is the number of items in the window.  With 2n or more, both
    lists are full.  With fewer they share the items: the first half goes to
    the start list (stand-ins after it, at its last midpoint), the rest to the
    end list (stand-ins at its first midpoint, sorted in).  A single item goes
    to the end list; an empty window gives stand-ins at the boundaries.
    """
    first, last = _listed(after_start, payload), _listed(before_end, payload)
    half = F.floor(inside / 2).cast("int")
    rest = (inside - half).cast("int")
    head = F.slice(first, F.lit(1), F.greatest(half, F.lit(0)))
    tail = F.slice(last, F.greatest(F.size(last) - rest + 1, F.lit(1)), F.greatest(rest, F.lit(0)))
    few_head = F.concat(head, _pad(F.element_at(head, -1)["mids"], payload, n - half))
    few_tail = F.array_sort(F.concat(_pad(F.element_at(tail, 1)["mids"], payload, n - rest), tail))
    only = F.slice(last, F.greatest(F.size(last), F.lit(1)), F.lit(1))
    one_tail = F.concat(only, _pad(F.element_at(only, 1)["mids"], payload, F.lit(n - 1)))
    near_start = (
        F.when(inside <= 1, _pad(start, payload, F.lit(n))).when(inside >= 2 * n, F.slice(first, 1, n)).otherwise(few_head)
    )
    near_end = (
        F.when(inside == 0, _pad(end, payload, F.lit(n)))
        .when(inside == 1, one_tail)
        .when(inside >= 2 * n, last)
        .otherwise(few_tail)
    )
    return near_start, near_end


# ---- orientation --------------------------------------------------------------------------------


def orient_peaks(peaks: DataFrame, motifs: DataFrame) -> DataFrame:
    """Lowest motif score per strand among the motifs overlapping each peak, 0 where there is none."""
    places = peaks.select("chr", "start", "end").distinct()
    # copies are merged here, so the join need not
    best = motifs.groupBy("chr", "start", "end").agg(
        F.min(F.when(F.col("orientation") == "+", F.col("score"))).alias("plus"),
        F.min(F.when(F.col("orientation") == "-", F.col("score"))).alias("minus"),
    )
    scores = (
        intersect(places, best, merge=False)
        .groupBy("chr", F.col("a_start").alias("start"), F.col("a_end").alias("end"))
        .agg(F.min("b_plus").alias("_plus"), F.min("b_minus").alias("_minus"))
    )
    return (
        peaks.join(scores, ["chr", "start", "end"], "left")
        .withColumn("plus_orientation", F.coalesce("_plus", F.lit(0)))
        .withColumn("minus_orientation", F.coalesce("_minus", F.lit(0)))
        .drop("_plus", "_minus")
    )


def keep_oriented(track: DataFrame) -> DataFrame:
    """Only the stronger strand of each peak survives; peaks with neither (or a tie) are dropped."""
    plus, minus = F.col("plus_orientation"), F.col("minus_orientation")
    return track.withColumns(
        {
            "plus_orientation": F.when(plus > minus, plus).otherwise(0),
            "minus_orientation": F.when(minus > plus, minus).otherwise(0),
        }
    ).filter((F.col("plus_orientation") != 0) | (F.col("minus_orientation") != 0))


# ---- loops --------------------------------------------------------------------------------------


def loop_anchors(loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = loops.select("chr", F.col("x1").alias("start"), F.col("x2").alias("end"), "id")
    right = loops.select("chr", F.col("y1").alias("start"), F.col("y2").alias("end"), "id")
    return left, right


def flag_loops(contacts: DataFrame, loops: DataFrame, window: int, width: int = 131_072) -> DataFrame:
    """``IsLoop`` is 1 where both anchors (+- ``window``) meet the two anchors of one loop.

    Both anchors are placed on a two-dimensional bucket grid: a contact falls
    into one cell, a loop covers the few cells around its corner, and a cell
    carries its loops as an array.  The contacts are read once, whatever joins
    they come from; hot start bins are divided by their end bin.
    """
    st, en = F.col("contact_st"), F.col("contact_en")

    def cover(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(lo) - window) / width), F.floor((F.col(hi) + window) / width)))

    corner = F.struct("x1", "x2", "y1", "y2")
    cells = (
        loops.select("chr", "x1", "x2", "y1", "y2")
        .distinct()
        .withColumn("_bx", cover("x1", "x2"))
        .withColumn("_by", cover("y1", "y2"))
        .groupBy("chr", "_bx", "_by")
        .agg(F.collect_list(corner).alias("_loops"))
    )

    def hit(loop: Column) -> Column:
        return (loop["x2"] >= st - window) & (loop["x1"] < st + window) & (loop["y2"] >= en - window) & (loop["y1"] < en + window)

    placed = contacts.withColumns({"_bx": F.floor(st / width), "_by": F.floor(en / width)})
    found = lookup(placed, cells, ["chr", "_bx", "_by"], ["_loops"])
    flag = F.coalesce(F.exists("_loops", hit).cast("int"), F.lit(0))
    return found.withColumn("IsLoop", flag).select(*contacts.columns, "IsLoop")


# ---- binned sums --------------------------------------------------------------------------------


def binned_sums(track: DataFrame, regions: DataFrame, binsize: int) -> DataFrame:
    """Sum of ``sigVal`` per fixed bin of each region; a midpoint on an inner bin edge counts on both sides.

    Bins start at ``start, start + binsize, ...`` below ``end - 1``.  Each distinct bin is summed once
    however many regions share it.
    """
    starts = F.sequence(F.col("start"), F.col("end") - 2, F.lit(binsize))
    bins = regions.filter(F.col("end") - 2 >= F.col("start")).select("*", F.posexplode(starts).alias("bin", "lo"))
    windows = bins.select("chr", "lo").distinct().withColumn("hi", F.col("lo") + binsize)
    items = track.select("chr", F.col("mids").alias("pos"), fixed("sigVal").alias("sigVal"))
    sums = window_totals(windows, items, ["sigVal"]).select("chr", "lo", F.col("sigVal").cast("double").alias("sigVal"))
    # the planner doesn't see that regions became many bins and would broadcast them all
    return bins.hint("merge").join(sums, ["chr", "lo"]).withColumnRenamed("lo", "bin_start")


# ---- eigenvector track --------------------------------------------------------------------------


def eigenvector_windows(regions: DataFrame, track: DataFrame, binsize: int) -> DataFrame:
    """Eigenvector bins of each region (chr, start, end, ...): ``len // binsize`` of them, at least one.

    Bins past the end of the chromosome are 0.  Regions starting past the end
    are left out here and reported by ``eigenvector_violations``.
    """
    first = F.floor(F.col("start") / binsize)
    count = F.greatest(F.floor((F.col("end") - F.col("start")) / binsize), F.lit(1))
    sizes = track.groupBy("chr").agg((F.max("bin") + 1).alias("_n"))
    kept = lookup(regions, sizes, ["chr"], ["_n"]).filter(first < F.col("_n")).drop("_n")
    spread = kept.select(
        "*", first.alias("_first"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("k")
    ).withColumn("bin", F.col("_first") + F.col("k"))
    return spread.drop("_first").join(track.select("chr", "bin", "E1"), ["chr", "bin"], "left").withColumn("E1", F.coalesce("E1", F.lit(0.0)))


def eigenvector_violations(regions: DataFrame, track: DataFrame, binsize: int) -> DataFrame:
    """Regions that start past the end of the eigenvector track of their chromosome."""
    sizes = track.groupBy("chr").agg((F.max("bin") + 1).alias("n_bins"))
    return (
        lookup(regions, sizes, ["chr"], ["n_bins"])
        .withColumn("n_bins", F.coalesce("n_bins", F.lit(0)))
        .filter(F.floor(F.col("start") / binsize) >= F.col("n_bins"))
    )
