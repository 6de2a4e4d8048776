"""Order-dependent primitives that never sort a whole chromosome in one task.

A chromosome is a very coarse key, so nothing here partitions by it alone.
Positions are cut into fixed-width buckets; each bucket is handled on its own
and the buckets are stitched together through a small per-bucket table whose
running totals are themselves computed in two levels.  Rows that share a
position are aggregated before any shuffle by bucket, so a pile-up of copies
at one place cannot make a bucket large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import cut_lineage, held_bytes, planned_bytes

#: Width of a position bucket in base pairs.
BUCKET = 262_144
#: Width of the narrowest bins of the interval hierarchy, and the number of its levels, each four times as wide.
NARROWEST, LEVELS = 256, 24

#: ``side`` of a query point: items strictly before it, or items up to and including it.
BEFORE, UP_TO = 0, 2
_ITEM = 1


#: decimals of fixed-point values: tracks of p-values keep theirs, totals up to 1e16 fit
SCALE = 12


def fixed(column: Column | str) -> Column:
    """Fixed-point form of a value column.

    Running sums are subtracted from each other, so they are kept exact: the
    result does not depend on the order in which tasks deliver their rows.
    NaN counts as 0; an infinite or too large value is an error.
    """
    column = F.col(column) if isinstance(column, str) else column
    value = F.nanvl(column.cast("double"), F.lit(0.0))
    return F.when(F.abs(value) >= 1e16, F.raise_error(F.lit("a value is infinite or too large to be summed exactly"))).otherwise(value).cast(f"decimal(28,{SCALE})")


def bucket_of(position: Column | str, width: int = BUCKET) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(width))


def running_before(table: DataFrame, keys: Sequence[str], bucket: str, aggs: Mapping[str, str]) -> DataFrame:
    """For a table with one row per (keys, bucket): aggregate of all earlier buckets.

    ``aggs`` maps a column to ``sum`` or ``max`` (``max`` carries "last seen"
    values, the columns being increasing in bucket order).  The window holds
    one row per bucket, so its size is the length of the chromosome over the
    bucket width - a thousand rows for a human chromosome - and does not grow
    with the number of items or contacts.
    """
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    folded = {
        c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) if how == "sum" else F.max(c).over(earlier) for c, how in aggs.items()
    }
    return table.select(*keys, bucket, *[column.alias(c) for c, column in folded.items()])


#: Bucket of what lies before all items of a chromosome.
_NOWHERE = -(1 << 40)


def cumulative_at(
    points: DataFrame,
    items: DataFrame,
    sums: Sequence[str],
    keys: Sequence[str] = ("chr",),
    width: int = BUCKET,
) -> DataFrame:
    """Totals of ``sums`` over all items lying before each query point.

    ``points`` has the keys, ``p``, ``side`` (``BEFORE`` or ``UP_TO``) and any
    further columns, which are passed through.  ``items`` has the keys,
    ``pos`` and the value columns.
    """
    return survey(points, items, sums, keys=keys, width=width).drop("_b")


def survey(
    points: DataFrame,
    items: DataFrame,
    sums: Sequence[str],
    near: DataFrame | None = None,
    keys: Sequence[str] = ("chr",),
    width: int = BUCKET,
    home: str = "p",
    reach: tuple[int, int] = (0, 0),
    ask: Column | None = None,
    tasks: int | None = None,
    apart: Sequence[str] = (),
) -> DataFrame:
    """``cumulative_at`` for points that stay in the bucket ``_b`` of their column ``home``.

    ``p`` lies between ``home + reach[0]`` and ``home + reach[1]``, and a bucket also gets the items within reach
    of it.  All points of one home come out of one task, so they can be grouped by (keys, ``_b``, home) without
    another shuffle.  With ``near``, a table made by ``gap_lists``, points also get ``before`` and ``after``; the lists
    travel with the items, of which there are usually fewer than points.

    With ``ask``, an array of structs (tag, p, side) over the columns of ``points``, a row of ``points`` stands for all these
    points and is shuffled once for them. ``tasks`` fixes the number of parts of that shuffle. ``apart`` names kinds of items,
    told by their column ``_t``: a point only sees those of the kind that its struct names in a field ``_t``, all in the same tasks.
    """
    shared, keys, sums, lists = list(keys), [*keys, *(["_t"] if apart else [])], list(sums), ["near"] if near is not None else []
    extra = [c for c in points.columns if c not in (*keys, "p", "side")]
    if ask is None:
        at = points.select(*keys, "p", F.col("side").cast("int").alias("side"), *extra, bucket_of(home, width).alias("_b"))
    else:
        at = points.select(*shared, *extra, bucket_of(home, width).alias("_b"))
    own = bucket_of(F.col("pos") - reach[0], width)
    place = items.groupBy(*keys, "pos").agg(*[F.sum(c).alias(c) for c in sums]) if sums else None
    if lists:
        listed = near.filter("pos is not null")
        place = listed if place is None else place.unionByName(listed, allowMissingColumns=True)
    within = F.explode(F.sequence(bucket_of(F.col("pos") - reach[1], width), own)) if reach != (0, 0) else own
    placed = place.select(*keys, F.col("pos").alias("p"), F.lit(_ITEM).alias("side"), *sums, *lists, within.alias("_b"))
    stacked = at.unionByName(placed, allowMissingColumns=True)
    if tasks is not None:
        stacked = stacked.repartition(tasks, *shared, "_b")
    elif ask is not None:
        stacked = stacked.repartition(*shared, "_b")
    if ask is not None:
        parts = ["tag", "p", "side", *(["_t"] if apart else [])]
        own_point = F.array(F.struct(F.lit(None).cast("string").alias("tag"), *parts[1:]))
        asked = F.explode(F.when(F.col("side").isNull(), ask).otherwise(own_point)).alias("_q")
        stacked = stacked.select(*shared, *extra, "_b", *sums, *lists, asked).select(*shared, *extra, "_b", *sums, *lists, *[f"_q.{c}" for c in parts])
        extra = [*extra, "tag"]
    frame = (
        Window.partitionBy(*keys, "_b").orderBy("p", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = stacked.select(
        *keys, "p", "side", *extra, "_b",
        *[F.sum(c).over(frame).alias(f"_in_{c}") for c in sums],
        *[F.last(c, ignorenulls=True).over(frame).alias(f"_in_{c}") for c in lists],
    ).filter(F.col("side") != _ITEM)
    # one row per bucket: what its own items add up to, and its last lists
    totals = at.select(*shared, "_b")
    if apart:
        totals = totals.select(*shared, F.explode(F.array(*[F.lit(t) for t in apart])).alias("_t"), "_b")
    if sums:
        totals = totals.unionByName(items.select(*keys, own.alias("_b"), *sums), allowMissingColumns=True)
    if lists:
        # lists before the first item count as those of a bucket before all others
        last = F.struct(F.coalesce("pos", F.lit(_NOWHERE)).alias("pos"), "near").alias("_last")
        totals = totals.unionByName(near.select(*keys, F.coalesce(own, F.lit(_NOWHERE)).alias("_b"), last), allowMissingColumns=True)
    hows = {**{c: "sum" for c in sums}, **({"_last": "max"} if lists else {})}
    totals = totals.groupBy(*keys, "_b").agg(*[(F.sum(c) if how == "sum" else F.max(c)).alias(c) for c, how in hows.items()])
    offsets = running_before(totals, keys, "_b", hows)
    found = inside.join(offsets, [*keys, "_b"])
    if lists:
        found = found.withColumn("_near", F.coalesce("_in_near", "_last.near"))
    return found.select(
        *keys,
        "p",
        "side",
        *extra,
        "_b",
        *[(F.coalesce(f"_in_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c) for c in sums],
        *([F.col("_near.before").alias("before"), F.col("_near.after").alias("after")] if lists else []),
    )


def window_totals(
    windows: DataFrame,
    items: DataFrame,
    sums: Sequence[str],
    keys: Sequence[str] = ("chr",),
    first: str = "pos",
    last: str = "pos",
    width: int = BUCKET,
) -> DataFrame:
    """Totals over all items touching each closed window ``[lo, hi]``.

    With ``first == last`` the items are points.  For intervals, those that
    touch ``[lo, hi]`` are the ones starting at or before ``hi`` less the ones
    ending before ``lo``; no pair of window and interval is ever formed.
    ``windows`` has the keys, ``lo``, ``hi`` and columns to pass through.
    """
    keys, sums = list(keys), list(sums)
    ids = [c for c in windows.columns if c not in (*keys, "lo", "hi")]
    ends = windows.select(
        *keys,
        "lo",
        "hi",
        *ids,
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("p"), F.lit(UP_TO).alias("side"), F.lit(1).alias("sign")),
                F.struct(F.col("lo").alias("p"), F.lit(BEFORE).alias("side"), F.lit(-1).alias("sign")),
            )
        ).alias("_e"),
    ).select(*keys, "lo", "hi", *ids, "_e.p", "_e.side", "_e.sign")
    if first == last:
        cum = cumulative_at(ends, items.withColumnRenamed(first, "pos"), sums, keys, width)
    else:
        upper = cumulative_at(
            ends.filter("sign = 1"), items.select(*keys, F.col(first).alias("pos"), *sums), sums, keys, width
        )
        lower = cumulative_at(
            ends.filter("sign = -1"), items.select(*keys, F.col(last).alias("pos"), *sums), sums, keys, width
        )
        cum = upper.unionByName(lower)
    return cum.groupBy(*keys, "lo", "hi", *ids).agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in sums])


def previous_row(
    rows: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], carry: Sequence[str], width: int = BUCKET
) -> DataFrame:
    """``rows`` plus ``prev``, a struct of ``carry`` of the preceding row in ``order`` within ``keys``.

    ``order`` starts with ``position``; the last row of the nearest earlier
    bucket stands in at bucket borders.
    """
    keys = list(keys)
    rest = [c for c in carry if c not in order]
    packed = F.struct(*order, *rest)
    bucketed = rows.withColumn("_b", bucket_of(position, width))
    frame = Window.partitionBy(*keys, "_b").orderBy(*order)
    inner = bucketed.withColumn("_lag", F.lag(packed).over(frame))
    tails = bucketed.groupBy(*keys, "_b").agg(F.max(packed).alias("_last"))
    before = running_before(tails, keys, "_b", {"_last": "max"})
    return (
        inner.join(before, [*keys, "_b"])
        .withColumn("prev", F.coalesce("_lag", "_last"))
        .drop("_b", "_lag", "_last")
    )


def last_seen(rows: DataFrame, keys: Sequence[str], position: str, marked: Column, carry: Sequence[str], width: int = BUCKET) -> DataFrame:
    """``rows`` plus ``seen``, a struct (position, carry) of the latest marked row up to and including each row."""
    keys = list(keys)
    mark = F.when(marked, F.struct(position, *[c for c in carry if c != position]))
    bucketed = rows.withColumn("_b", bucket_of(position, width)).withColumn("_mark", mark)
    frame = Window.partitionBy(*keys, "_b").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = bucketed.withColumn("_in", F.last("_mark", ignorenulls=True).over(frame))
    ends = bucketed.groupBy(*keys, "_b").agg(F.max("_mark").alias("_last"))
    before = running_before(ends, keys, "_b", {"_last": "max"})
    return inside.join(before, [*keys, "_b"]).withColumn("seen", F.coalesce("_in", "_last")).drop("_b", "_mark", "_in", "_last")


def place_ranks(items: DataFrame, keys: Sequence[str], width: int = BUCKET) -> DataFrame:
    """(keys, mids, cnt, base): how many items lie at and before each distinct midpoint."""
    keys = list(keys)
    places = items.groupBy(*keys, "mids").agg(F.count(F.lit(1)).alias("cnt")).withColumn("_b", bucket_of("mids", width))
    frame = Window.partitionBy(*keys, "_b").orderBy("mids").rowsBetween(Window.unboundedPreceding, -1)
    inside = places.withColumn("_in", F.coalesce(F.sum("cnt").over(frame), F.lit(0)))
    totals = items.groupBy(*keys, bucket_of("mids", width).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return inside.join(running_before(totals, keys, "_b", {"n": "sum"}), [*keys, "_b"]).select(
        *keys, "mids", "cnt", (F.col("_in") + F.col("n")).alias("base")
    )


#: Ranks in a block of ``gap_lists``.
RANKS = 4_096


def gap_lists(items: DataFrame, payload: Sequence[str], n: int, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """(keys, pos, near) for the gap after every distinct midpoint ``pos``, and with a null ``pos`` for the gap before the first.

    ``near.before`` holds the last ``n`` items up to the gap in ascending order, ``near.after`` the next ``n``.
    Of the items sharing one midpoint only the first and last ``n`` can appear, so the others are dropped
    map-side by the row-number limit.  Items are dealt to blocks of consecutive ranks; those within ``n`` of a
    border also stand in the next block.
    """
    keys, payload = list(keys), list(payload)
    order = ["start", "end", *[c for c in payload if c not in ("start", "end", "mids")]]
    kept = list(dict.fromkeys([*keys, "mids", *order]))
    base = items.select(*kept)
    at_place = Window.partitionBy(*keys, "mids")

    def first(window) -> DataFrame:
        return base.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)

    heads = first(at_place.orderBy(*order)).withColumn("_head", F.lit(True))
    tails = first(at_place.orderBy(*[F.desc(c) for c in order])).withColumn("_head", F.lit(False))
    backwards = F.col("cnt") - F.col("_rn") + 1
    at = F.when(F.col("_head"), F.col("_rn")).otherwise(backwards)
    # a tail that is a head as well counts once
    ranked = (
        heads.unionByName(tails)
        .join(place_ranks(items, keys), [*keys, "mids"])
        .filter(F.col("_head") | (backwards > n))
        .select(*keys, F.col("mids").alias("pos"), (F.col("base") + at).alias("_rank"), (at == F.col("cnt")).alias("_ends"), F.struct(*payload).alias("item"))
    )
    block = bucket_of("_rank", RANKS)
    around = F.explode(F.sequence(bucket_of(F.col("_rank") - n, RANKS), bucket_of(F.col("_rank") + n, RANKS))).alias("_block")
    frame = Window.partitionBy(*keys, "_block").orderBy("_rank")
    listed = ranked.select("*", around).select(
        *keys, "pos", "_rank", "_ends", "_block", "item",
        F.collect_list("item").over(frame.rowsBetween(-(n - 1), 0)).alias("before"),
        F.collect_list("item").over(frame.rowsBetween(1, n)).alias("after"),
    ).filter(F.col("_block") == block)
    here = F.when(F.col("_ends"), F.struct("pos", F.struct("before", "after").alias("near")))
    head = F.slice(F.concat(F.array("item"), "after"), 1, n)
    nothing = F.slice("after", 1, 0)
    start = F.when(F.col("_rank") == 1, F.struct(F.lit(None).cast("bigint").alias("pos"), F.struct(nothing.alias("before"), head.alias("after")).alias("near")))
    rows = listed.select(*keys, F.explode(F.array_compact(F.array(here, start))).alias("_g"))
    return rows.select(*keys, "_g.pos", "_g.near")


def locate(
    points: DataFrame,
    items: DataFrame,
    payload: Sequence[str] = (),
    n: int = 0,
    sums: Sequence[str] = (),
    keys: Sequence[str] = ("chr",),
) -> DataFrame:
    """As-of search: ``cnt`` items (and totals of ``sums``) before each point, with its ``n`` neighbours.

    With ``side`` ``BEFORE`` the point itself belongs to ``after``; with
    ``UP_TO`` it belongs to ``before``.
    """
    counted = items.withColumn("cnt", F.lit(1).cast("bigint")).withColumn("pos", F.col("mids"))
    near = gap_lists(items, payload, n, keys) if n else None
    return survey(points, counted, ["cnt", *sums], near, keys).drop("_b")


def level_of(length: Column, narrowest: int = NARROWEST) -> Column:
    """Level of an interval: the first whose bins, ``narrowest * 4 ** level`` wide, are as long as it is."""
    level = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        level = F.when(length <= narrowest * 4**k, k).otherwise(level)
    return level.cast("int")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    condition: Column,
    keys: Sequence[str] = ("chr",),
    left_span: tuple[str, str] = ("a_start", "a_end"),
    right_span: tuple[str, str] = ("b_start", "b_end"),
    narrowest: int = NARROWEST,
    merge: bool = True,
) -> DataFrame:
    """Pairs of intervals that meet, by equi-join on bins of a hierarchy of widths and the exact ``condition``.

    An interval stands in the one or two bins that it covers at the level of its length, however long it
    is. It visits the bins that it covers at the wider levels where the other side has intervals. A pair meets at the
    level of the longer one, in the bin with the later of the two starts, so it is found once. Two intervals only share
    a bin if their distance is less than a few lengths of the longer one: what a bin holds is bounded by what it yields.

    With ``merge`` equal intervals of a side are joined as one and their rows attached afterwards, by
    coordinates; without it both sides must hold distinct intervals, or few copies. Non-key column names of the two sides must differ.
    """
    keys, home = list(keys), F.col("_level")

    def level(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        spans = df.select(*keys, *span).distinct() if merge else df
        return spans.withColumn("_level", level_of(F.abs(F.col(span[1]) - F.col(span[0])), narrowest))

    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        """One row for each bin that an interval covers at ``_at``."""
        width = F.lit(narrowest) * F.pow(F.lit(4.0), F.col("_at")).cast("bigint")
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor(F.col(span[1]) / width)))).withColumn("_w", width)

    def placed(df: DataFrame, other: DataFrame, span: tuple[str, str], side: int) -> DataFrame:
        # levels at which the other side has intervals: a few numbers, read as a scalar subquery
        there = other.agg(F.sort_array(F.collect_set("_level")).alias("l")).scalar()
        wider = F.filter("_there", lambda x: (x >= F.col("_level")) if side else (x > F.col("_level")))
        visits = df.withColumn("_there", there).withColumn("_at", F.explode(wider)).drop("_there").withColumn("_side", F.lit(1 - side))
        return binned(df.withColumn("_at", home).withColumn("_side", F.lit(side)).unionByName(visits), span).drop("_level")

    a, b = level(left, left_span), level(right, right_span)
    met = placed(a, b, left_span, 1).drop("_w").join(placed(b, a, right_span, 0), [*keys, "_side", "_at", "_b"])
    later_start = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    touch = (F.greatest(*left_span) >= F.least(*right_span)) & (F.least(*left_span) <= F.greatest(*right_span))
    once = met.filter(touch & (F.col("_b") == F.floor(later_start / F.col("_w")))).drop("_side", "_at", "_b", "_w")
    if merge:
        once = once.join(left, [*keys, *left_span]).join(right, [*keys, *right_span])
        once = once.select(*left.columns, *[c for c in right.columns if c not in keys])
    return once.filter(condition)


#: Groups up to this size are ordered in one piece.
ONE_PIECE = 200_000
#: Even parts between two neighbouring quantiles of a large group.
EVEN = 64


def ordered_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, sums: Sequence[str] = (), splits: int = 64
) -> DataFrame:
    """(keys, value, cnt, below, n, sums): distinct values of each group with the number of rows below them.

    Equal values are merged first; those of a large group are divided at
    approximate quantiles and evenly in between, so the group is ordered in up
    to ``splits * EVEN`` pieces.  The split points only steer the work - the
    counts are exact.  ``weight`` makes a row count several times.
    """
    keys, sums = list(keys), list(sums)
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    count = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = present.groupBy(*keys, value).agg(count.alias("cnt"), *[F.sum(c).alias(c) for c in sums])
    probabilities = F.array(*[F.lit(k / splits) for k in range(1, splits)])
    cuts = present.groupBy(*keys).agg(
        F.concat(
            F.array(F.min(value)), F.percentile_approx(value, probabilities, F.lit(20 * splits)), F.array(F.max(value))
        ).alias("_cuts"),
        count.alias("n"),
        F.count(F.lit(1)).alias("_rows"),
    )
    if keys:
        placed = lookup(distinct, cuts, keys, ["_cuts", "n", "_rows"])
    else:
        # a single row, read as a scalar subquery
        placed = distinct.withColumn("_one", cuts.select(F.struct("_cuts", "n", "_rows")).scalar()).select(
            *distinct.columns, "_one._cuts", "_one.n", "_one._rows"
        )
    large = F.col("_rows") > ONE_PIECE
    placed = placed.withColumn("_p", F.when(large, F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(0))
    low = F.get("_cuts", F.col("_p") - 1).cast("double")
    high = F.get("_cuts", F.col("_p")).cast("double")
    part = F.floor(F.try_divide(F.col(value).cast("double") - low, high - low) * EVEN)
    part = F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(EVEN - 1))
    placed = placed.withColumn("_b", F.col("_p") * EVEN + F.when(F.col("_p") > 0, part).otherwise(0)).drop("_cuts", "_rows", "_p")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per_piece = placed.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_tot"))
    # at most `splits * EVEN` rows per group reach this window
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(*keys, "_b", F.coalesce(F.sum("_tot").over(across), F.lit(0)).alias("_off"))
    return (
        placed.withColumn("_in", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_b"])
        .select(*keys, value, "cnt", (F.col("_in") + F.col("_off")).alias("below"), "n", *sums)
    )


def quantiles_of(ranked: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles from a table made by ``ordered_counts``."""

    def order_statistic(index: Column) -> Column:
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("cnt")), F.col(value).cast("double")))

    aggs, out = [], []
    for name, p in wanted.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        aggs += [order_statistic(F.floor(h)).alias(f"_lo_{name}"), order_statistic(F.ceil(h)).alias(f"_hi_{name}")]
        out.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name)
        )
    return ranked.groupBy(*keys, "n").agg(*aggs).select(*keys, "n", *out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``wanted``."""
    return quantiles_of(ordered_counts(df, keys, value, weight), keys, value, wanted)


def average_rank() -> Column:
    """Rank of a row of ``ordered_counts``, ties sharing their mean rank (from 1)."""
    return F.col("below") + (F.col("cnt") + 1) / F.lit(2.0)


def running_total(
    rows: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], value: str, name: str, width: int = BUCKET
) -> DataFrame:
    """``rows`` plus the total of ``value`` over all earlier rows in ``order`` (which starts with ``position``)."""
    keys = list(keys)
    bucketed = rows.withColumn("_b", bucket_of(position, width))
    frame = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.withColumn("_in", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum(value).alias("_off"))
    offsets = running_before(totals, keys, "_b", {"_off": "sum"})
    return inside.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_in") + F.col("_off")).drop("_b", "_in", "_off")


def hash_order(key_columns: Sequence[str], seed: int | Column) -> Column:
    """Reproducible pseudo-random sort key of a row."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", seed, *[F.col(c).cast("string") for c in key_columns]))


def hash_sample(
    df: DataFrame, key_columns: Sequence[str], sizes: DataFrame | int, keys: Sequence[str] = (), seed: int = 1
) -> DataFrame:
    """Exactly the first ``size`` rows of each group in the order of a hash of the row key.

    The hash range is cut into 65536 equal parts, whose row counts tell in
    which part the sample ends.  Rows of earlier parts are taken as they are;
    only the part with the cut is ordered.  ``sizes`` is a number, or a table
    (keys, size).
    """
    keys = list(keys)
    hashed = df.withColumn("_h", hash_order(key_columns, seed)).withColumn("_part", F.substring("_h", 1, 4))
    per_part = hashed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most 65536 rows per group reach this window
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    if isinstance(sizes, int):
        parts = parts.withColumn("size", F.lit(sizes).cast("bigint"))
    elif keys:
        parts = lookup(parts, sizes, keys, ["size"])
    else:
        parts = parts.withColumn("size", sizes.select("size").scalar())
    reached = parts.filter((F.col("size") > 0) & (F.col("_before") < F.col("size")))
    cut = reached.groupBy(*keys).agg(F.max(F.struct("_part", (F.col("size") - F.col("_before")).alias("left"))).alias("_cut"))
    found = lookup(hashed, cut, keys, ["_cut"]) if keys else hashed.withColumn("_cut", cut.scalar())
    whole = found.filter(F.col("_part") < F.col("_cut._part"))
    last = (
        found.filter(F.col("_part") == F.col("_cut._part"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h")))
        .filter(F.col("_rn") <= F.col("_cut.left"))
    )
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def require_unique(table: DataFrame, keys: Sequence[str]) -> None:
    """Raise if two rows of ``table`` share their keys: a join with it would repeat rows without a word."""
    twice = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys).head(1)
    if twice:
        raise ValueError(f"lookup table has several rows for {twice[0].asDict()}")


#: A lookup table up to this size on disk, and no more than eight times as large in memory, is broadcast.
BROADCAST_BYTES = 8 << 20


#: Hash classes in which ``lookup`` looks for hot keys.
HASH_CLASSES = 1 << 16


def broadcastable(table: DataFrame, limit: int) -> bool:
    """Whether a written table is within ``limit`` on disk, and within eight times as much (but not over 64 MB) in memory."""
    return planned_bytes(table) <= limit and held_bytes(table) <= min(8 * limit, 64 << 20)


def lookup(
    big: DataFrame, small: DataFrame, keys: Sequence[str], payload: Sequence[str], hot: DataFrame | None = None, share: int = 1000
) -> DataFrame:
    """Left join of ``big`` to ``small`` (unique on ``keys``) that survives hot keys in ``big``.

    ``small`` is written out first, which settles its size: up to
    ``BROADCAST_BYTES`` it is broadcast, and ``big`` is neither shuffled nor
    computed twice.  Beyond that, keys holding more than 1/``share`` of all
    rows are served by broadcast - there are fewer than ``share`` of them,
    whatever the data size - and their rows are spread evenly over the shuffle
    used for all other keys.  Rows and widths count as well as files, see ``broadcastable``.  ``big`` is written then, as it is read
    again for its hot keys: those in hash classes with that many rows, so that only the rows of such classes are counted by key.  A caller that has
    counted the keys already passes ``hot``, the rows of the (written) ``small`` with hot keys.
    """
    keys, payload = list(keys), list(payload)
    if hot is None:
        small = cut_lineage(small.select(*keys, *payload))
        require_unique(small, keys)
        if broadcastable(small, BROADCAST_BYTES):
            return big.join(F.broadcast(small), keys, "left").select(*big.columns, *payload)
        big = cut_lineage(big)
        limit = big.count() / share
        classed = big.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(HASH_CLASSES)).alias("_class"))
        many = F.col("_cnt") > limit
        # fewer than ``share`` classes, and fewer keys
        full = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("_cnt")).filter(many).select("_class")
        counts = classed.join(F.broadcast(full), "_class", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
        hot = small.join(F.broadcast(counts.filter(many)), keys).select(*keys, *payload)
    packed = F.struct(*payload)
    # the salt only spreads rows that need no partner in the shuffle, so any value is right
    salt = 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    tagged = big.join(F.broadcast(hot.select(*keys, packed.alias("_hot"))), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(F.lit(0)).cast("bigint")
    )
    cold = small.select(*keys, F.lit(0).cast("bigint").alias("_salt"), packed.alias("_cold"))
    found = tagged.join(cold, [*keys, "_salt"], "left")
    chosen = F.coalesce("_hot", "_cold")
    return found.select(*big.columns, *[chosen[c].alias(c) for c in payload])
