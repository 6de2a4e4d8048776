"""Contact features.

A feature of a contact is a function of its two anchors.  Each family states
which positions around an anchor it needs (``Request``); those are located
once per distinct anchor, and a contact then picks up two anchor rows, one
for its start and one for its end.  However many families are used, the
contact table itself is joined twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.ordered import (
    BEFORE,
    BUCKET,
    UP_TO,
    broadcastable,
    bucket_of,
    SCALE,
    fixed,
    gap_lists,
    locate,
    lookup,
    previous_row,
    survey,
    window_totals,
)
from contactloom.operators.tracks import boundary_lists, flag_loops, pad_left, pad_right, typed_payload
from contactloom.session import cut_lineage

KEY = ["chr", "contact_st", "contact_en"]
ANCHOR = ["chr", "pos"]

#: Gives the column of an anchor row for a request tag.
Pick = Callable[[str], Column]
Step = Callable[[DataFrame], DataFrame]


# ---- window frames ------------------------------------------------------------------------------


def window_frame(contacts: DataFrame, size: int) -> DataFrame:
    """Window of fixed ``size`` centred on the contact, and the anchors relative to it."""
    start = F.greatest(F.lit(0).cast("bigint"), F.col("contact_st") - F.floor((F.lit(size) - F.col("dist")) / 2))
    return contacts.withColumn("win_st", start).withColumns(
        {
            "win_en": F.col("win_st") + size,
            "win_rel_st": F.col("contact_st") - F.col("win_st"),
            "win_rel_en": F.col("contact_en") - F.col("win_st"),
        }
    )


def anchor_frames(contacts: DataFrame, window: int) -> DataFrame:
    """Intervals around the left anchor, between the anchors, around the right anchor."""
    h = window // 2
    st, en = F.col("contact_st"), F.col("contact_en")
    return contacts.filter(en - st > h).withColumns(
        {"L_st": st - h, "L_en": st + h, "M_st": st + h, "M_en": en - h, "R_st": en - h, "R_en": en + h}
    )


# ---- anchor rows --------------------------------------------------------------------------------


def contact_anchors(contacts: DataFrame) -> DataFrame:
    """Distinct anchor positions with the number of contacts starting and ending there."""
    ends = contacts.select(
        "chr",
        F.explode(
            F.array(
                F.struct(F.col("contact_st").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct(F.col("contact_en").alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("_a"),
    )
    return ends.groupBy("chr", F.col("_a.pos").alias("pos")).agg(F.sum("_a.s").alias("n_st"), F.sum("_a.e").alias("n_en"))


@dataclass(frozen=True)
class Request:
    """A position ``offset`` away from an anchor, and whether items at that very position count as before it."""

    tag: str
    offset: int
    side: int


@dataclass(frozen=True)
class Places:
    """Where anchors are looked up: in buckets of the column ``home``, which they lie ``lo`` to ``hi`` away from, by ``tasks`` tasks."""

    home: str = "pos"
    lo: int = 0
    hi: int = 0
    width: int = BUCKET
    tasks: int | None = None

    @property
    def key(self) -> list[str]:
        """Columns of an anchor row: an anchor of stretches stands in several of them."""
        return ANCHOR if self.home == "pos" else ["chr", "_b", "pos"]


def asked(requests: Sequence[Request]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(r.tag).alias("tag"), (F.col("pos") + r.offset).alias("p"), F.lit(r.side).alias("side"))
            for r in requests
        ]
    )


def surveyed(
    anchors: DataFrame,
    requests: Sequence[Request],
    items: DataFrame,
    sums: Sequence[str],
    payload: Sequence[str] = (),
    n: int = 0,
    neighbours: DataFrame | None = None,
    places: Places = Places(),
) -> DataFrame:
    """Answers to the requests of all anchors: totals of ``sums`` over ``items`` (chr, pos), and the ``n`` neighbours of ``neighbours``."""
    offsets = [r.offset for r in requests]
    near = gap_lists(neighbours, payload, n) if n else None
    reach = (min(offsets) + places.lo, max(offsets) + places.hi)
    return survey(anchors, items, sums, near, width=places.width, home=places.home, reach=reach, ask=asked(requests), tasks=places.tasks)


def one_sided(located: DataFrame, left: str, right: str) -> DataFrame:
    """Only the lists that are used travel on: items before request ``left``, items after request ``right``."""
    return located.withColumns(
        {"before": F.when(F.col("tag") == left, F.col("before")), "after": F.when(F.col("tag") == right, F.col("after"))}
    )


#: Fields of a slot, each made on demand, as only those that an end takes are worked out.
Fields = dict[str, Callable[[], Column]]


def needed(requests: Sequence[Request], finish: Callable[[Pick], Fields], names: Sequence[str]) -> list[Request]:
    """The requests whose answers the fields ``names`` are made from."""
    used = set()

    def at(tag: str) -> Column:
        used.add(tag)
        return F.col("_m")[tag]

    made = finish(at)
    for name in names or made:
        made[name]()
    return [r for r in requests if r.tag in used]


def by_anchor(
    located: DataFrame,
    requests: Sequence[Request],
    fields: Sequence[str],
    slot: str,
    finish: Callable[[Pick], Fields],
    names: Sequence[str] = (),
    key: Sequence[str] = ANCHOR,
) -> DataFrame:
    """One row per anchor; ``finish`` turns the answers to the requests into the fields ``names`` (all, if empty) of the struct ``slot``.

    ``located`` comes from ``surveyed``: an anchor's answers are in one task already.
    """
    order, answer = sorted(r.tag for r in requests), F.struct(*fields)
    own = Window.partitionBy("chr", "_b", "pos").orderBy("tag")
    # an anchor has one answer to each request, so they stand in the order of tags behind its first
    answers = located.select(*key, "tag", *[(F.lead(answer, i).over(own) if i else answer).alias(f"_{i}") for i in range(len(order))])
    answers = answers.filter(F.col("tag") == order[0])
    place = {tag: f"_{i}" for i, tag in enumerate(order)}
    done = finish(lambda tag: F.col(place[tag]))
    return answers.select(*key, F.struct(*[done[name]().alias(name) for name in names or done]).alias(slot))


#: Both anchors of a contact are met in one stretch of the chromosome, this wide or as wide as contacts reach, if they reach no farther than ``REACH``.
STRETCH, REACH = 1 << 20, 1 << 24
#: Contacts of a stretch that are met in one piece, and about the contacts of a task.
PIECE = 1 << 18


def attach_anchors(
    contacts: DataFrame,
    rows: DataFrame,
    slots: Sequence[str],
    share: int = 1000,
    broadcast_bytes: int = 64 << 20,
    taken: Callable[[str, str], Column] = lambda slot, end: F.col(slot),
    plain: DataFrame | None = None,
) -> DataFrame:
    """Contacts with ``st_<slot>`` and ``en_<slot>``, from a materialised table of anchor rows.

    ``taken(slot, end)`` is the part of a slot that an end needs: contacts carry no more than that.

    A table within ``broadcast_bytes`` on disk (and 64 MB in memory) is broadcast, and the contacts
    are not shuffled at all.  Beyond that, contacts are shuffled once, by stretches, while they are narrow, see ``_met_in_stretches``;
    where they reach too far for that, each end is looked up on its own and only the anchors holding over
    1/``share`` of the contacts are broadcast, see ``lookup``. ``plain`` are the same contacts from a written table, if there is one.
    """
    if broadcastable(rows, broadcast_bytes):
        out = contacts
        for end, column in (("st", "contact_st"), ("en", "contact_en")):
            named = [taken(s, end).alias(f"{end}_{s}") for s in slots]
            out = out.join(F.broadcast(rows.select("chr", F.col("pos").alias(column), *named)), ["chr", column], "left")
        return out.select(*contacts.columns, *[f"{end}_{s}" for end in ("st", "en") for s in slots])
    plain = contacts if plain is None else plain
    dist = F.col("contact_en") - F.col("contact_st")
    extent = plain.agg(F.min(dist).alias("lo"), F.max(dist).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if extent["lo"] is not None and max(abs(extent["lo"]), abs(extent["hi"])) <= REACH:
        return _met_in_stretches(contacts, rows, slots, taken, plain, extent)
    limit = F.lit(extent["n"] / share)
    out = contacts
    for end, column in (("st", "contact_st"), ("en", "contact_en")):
        named = [taken(s, end).alias(f"{end}_{s}") for s in slots]
        small = rows.select("chr", F.col("pos").alias(column), *named)
        hot = rows.filter(F.col(f"n_{end}") > limit).select("chr", F.col("pos").alias(column), *named)
        out = lookup(out, small, ["chr", column], [f"{end}_{s}" for s in slots], hot)
    return out


def _met_in_stretches(contacts: DataFrame, rows: DataFrame, slots: Sequence[str], taken: Callable[[str, str], Column], plain: DataFrame, extent) -> DataFrame:
    """``attach_anchors`` by one shuffle of the contacts, before they carry anything.

    A contact goes to the stretch of its start. An anchor goes to its own stretch for the contacts that start there, and to the one to three
    stretches from which contacts can end there; contacts and anchors stand in one order of positions, first by start and then by end, and a
    contact takes the anchor before it. A stretch with many contacts is cut into pieces that all get its anchors; it holds a bounded number of
    positions, its pieces about ``PIECE`` contacts each.
    """
    width, place = max(STRETCH, abs(extent["lo"]), abs(extent["hi"])), ["chr", "_b", "_piece"]
    tasks = max(1, -(-extent["n"] // PIECE))
    at = bucket_of("contact_st", width).alias("_b")
    sizes = plain.select("chr", at).groupBy("chr", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # fewer rows than contacts / PIECE
    busy = cut_lineage(sizes.filter(F.col("_n") > PIECE).select("chr", "_b", F.ceil(F.col("_n") / PIECE).alias("_pieces")))

    def cut(df: DataFrame, piece: Callable[[Column], Column]) -> DataFrame:
        known = df.join(F.broadcast(busy), ["chr", "_b"], "left")
        return known.withColumn("_piece", piece(F.coalesce("_pieces", F.lit(1).cast("bigint")))).drop("_pieces")

    # any piece is right
    stacked = cut(contacts.select("*", at, F.lit(True).alias("_contact")), lambda k: F.pmod(F.xxhash64(F.monotonically_increasing_id()), k))
    reached = F.sequence(bucket_of(F.col("pos") - extent["hi"], width), bucket_of(F.col("pos") - extent["lo"], width))
    ends = {"st": ("contact_st", F.array(bucket_of("pos", width))), "en": ("contact_en", reached)}
    for end, (column, stretches) in ends.items():
        row = F.struct("pos", *[taken(s, end).alias(s) for s in slots]).alias(f"_{end}")
        known = rows.filter((F.col(f"n_{end}") > 0) & F.col("pos").isNotNull() & F.col("chr").isNotNull())
        spread = known.select("chr", F.col("pos").alias(column), row, F.lit(False).alias("_contact"), F.explode(stretches).alias("_b"))
        pieces = cut(spread, lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
        stacked = stacked.unionByName(pieces, allowMissingColumns=True)
    stacked = stacked.repartition(tasks, *place)
    for end, (column, _) in ends.items():
        frame = Window.partitionBy(*place).orderBy(column, "_contact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stacked = stacked.withColumn(f"_at_{end}", F.last(f"_{end}", ignorenulls=True).over(frame)).drop(f"_{end}")
        # the anchors of this end have served
        stacked = stacked.filter(F.col("_contact") | F.col("_en").isNotNull()) if end == "st" else stacked.filter("_contact")
    found = [F.when(F.col(f"_at_{end}.pos") == F.col(column), F.col(f"_at_{end}")[s]).alias(f"{end}_{s}") for end, (column, _) in ends.items() for s in slots]
    return stacked.select(*contacts.columns, *found)


#: Contacts of a task that meets them with anchors found in the same stretches.
SHARE = 1 << 17
#: Anchor rows up to this size in memory are written and broadcast.
HELD = 64 << 20


def by_crowding(contacts: DataFrame, column: str, width: int) -> tuple[Step, Step | None]:
    """Two filters of tables with (chr, ``column``): all but the stretches that hold too many contacts for one task, and those; none if there are none."""
    at = bucket_of(column, width).alias("_s")
    # fewer rows than contacts / PIECE
    full = contacts.groupBy("chr", at).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PIECE)
    full = cut_lineage(full.filter(F.col("chr").isNotNull() & F.col("_s").isNotNull()).select("chr", "_s"))

    def those(how: str) -> Step:
        return lambda df: df.withColumn("_s", at).join(F.broadcast(full), ["chr", "_s"], how).select(*df.columns)

    return those("left_anti"), None if full.isEmpty() else those("left_semi")


def _joined_in_stretches(contacts: DataFrame, anchors: DataFrame, families: Sequence[AnchorFamily], extent) -> DataFrame:
    """Contacts with ``st_<slot>`` and ``en_<slot>``: anchors are surveyed in the stretches of the contacts that take them.

    Contacts, anchors and items are shuffled by stretches while they are narrow, all into the same tasks; what is found for an anchor is
    joined there and never shuffled or written. An end only asks for what it takes. A task holds the anchors of about ``SHARE`` contacts.
    """
    # rows dealt by stretches are joined by stretch and position where they are
    contacts.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    lo, hi = extent["lo"], extent["hi"]
    width, tasks = max(STRETCH, abs(lo), abs(hi)), max(1, -(-extent["n"] // SHARE))
    # in order, so that neighbouring rows of what is stored take the same anchors
    # a contact without a start is where its end is first looked for
    home = bucket_of(F.coalesce(F.col("contact_st"), F.col("contact_en") - hi), width)
    out = contacts.withColumn("_b", home).repartition(tasks, "chr", "_b").sortWithinPartitions(*KEY)
    reached = F.sequence(bucket_of(F.col("pos") - hi, width), bucket_of(F.col("pos") - lo, width))
    ends = {
        "st": ("contact_st", F.array(bucket_of("pos", width)), Places("_home", 0, 0, width, tasks)),
        "en": ("contact_en", reached, Places("_home", lo, hi, width, tasks)),
    }
    for end, (column, stretches, places) in ends.items():
        known = anchors.filter((F.col(f"n_{end}") > 0) & F.col("pos").isNotNull() & F.col("chr").isNotNull())
        own = known.select(*ANCHOR, F.explode(stretches).alias("_home")).withColumn("_home", F.col("_home") * width)
        rows = None
        for family in families:
            found = family.anchor_rows(own, places, end).withColumnRenamed(family.slot, f"{end}_{family.slot}")
            rows = found if rows is None else rows.join(found.hint("shuffle_hash"), places.key)
        rows = rows.withColumnRenamed("pos", column)
        out = out.join(rows.hint("shuffle_hash"), ["chr", "_b", column], "left")
    return out.select(*contacts.columns, *[f"{end}_{f.slot}" for end in ends for f in families])


# ---- nearest items of free-standing points and regions --------------------------------------------


def _items(track: DataFrame, payload: Sequence[str], *more: Column) -> DataFrame:
    """Track columns needed for a neighbour search over ``payload``."""
    return track.select("chr", "start", "end", *typed_payload(payload), *more)


def nearest_peaks(track: DataFrame, points: DataFrame, n: int, payload: Sequence[str] = ("mids", "sigVal")) -> DataFrame:
    """(chr, p, side, idx, payload): ``n`` nearest items on each side of every distinct point, padded."""
    sides = F.explode(F.array(F.lit(BEFORE), F.lit(UP_TO)))
    at = points.select("chr", "p").distinct().select("chr", "p", sides.alias("side"))
    located = locate(at, _items(track, payload), payload, n)
    listed = F.when(F.col("side") == BEFORE, pad_left(F.col("before"), n, payload)).otherwise(
        pad_right(F.col("after"), n, payload, F.col("p"))
    )
    name = F.when(F.col("side") == BEFORE, "left").otherwise("right")
    return located.select("chr", "p", name.alias("side"), F.posexplode(listed).alias("idx", "_i")).select(
        "chr", "p", "side", "idx", *[F.col("_i")[c].alias(c) for c in payload]
    )


def boundary_peaks(
    track: DataFrame, regions: DataFrame, n: int, key: str = "id", payload: Sequence[str] = ("mids", "sigVal")
) -> DataFrame:
    """(key, boundary, idx, payload): the ``n`` items inside each region nearest to its start and to its end."""
    ends = F.explode(
        F.array(
            F.struct(F.col("start").alias("p"), F.lit(BEFORE).alias("side")),
            F.struct(F.col("end").alias("p"), F.lit(UP_TO).alias("side")),
        )
    )
    points = regions.select("chr", "start", "end", key, ends.alias("_e")).select("chr", "start", "end", key, "_e.p", "_e.side")
    renamed = points.withColumnsRenamed({"start": "_st", "end": "_en"})
    located = locate(renamed, _items(track, payload), payload, n)

    def at(side: int, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    both = located.groupBy("chr", key, "_st", "_en").agg(
        at(BEFORE, "cnt").alias("_c0"),
        at(UP_TO, "cnt").alias("_c1"),
        F.first(F.when(F.col("side") == BEFORE, F.col("after")), ignorenulls=True).alias("_after"),
        F.first(F.when(F.col("side") == UP_TO, F.col("before")), ignorenulls=True).alias("_before"),
    )
    first, last = boundary_lists(
        F.col("_after"), F.col("_before"), F.col("_c1") - F.col("_c0"), n, payload, F.col("_st"), F.col("_en")
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("start").alias("boundary"), first.alias("items")),
            F.struct(F.lit("end").alias("boundary"), last.alias("items")),
        )
    )
    return (
        both.select(key, sides.alias("_s"))
        .select(key, "_s.boundary", F.posexplode("_s.items").alias("idx", "_i"))
        .select(key, "boundary", "idx", *[F.col("_i")[c].alias(c) for c in payload])
    )


# ---- families -----------------------------------------------------------------------------------


class AnchorFamily:
    """Features computed from anchor rows.

    ``anchor_rows`` holds whatever depends on one anchor only, ready to use;
    ``at_start`` and ``at_end`` name the fields that a contact takes from its two anchors (all, if empty);
    ``shared`` names values of the contact that several columns take items
    from; ``columns`` lists the features.
    """

    name: str
    at_start: tuple[str, ...] = ()
    at_end: tuple[str, ...] = ()

    def taken(self, end: str) -> Column:
        """What a contact takes from the anchor at its ``st`` or ``en``."""
        return self._fields(F.col(self.slot), end)

    def _fields(self, row: Column, end: str) -> Column:
        names = self.at_start if end == "st" else self.at_end
        return F.struct(*[row[f].alias(f) for f in names]) if names else row

    @property
    def slot(self) -> str:
        return "f_" + "".join(c if c.isalnum() else "_" for c in self.name)

    #: Whether ``anchor_rows`` knows stretches: ``places``, and the ``end`` (``st`` or ``en``) whose fields are wanted.
    in_stretches = False

    def anchor_rows(self, anchors: DataFrame) -> DataFrame:
        """(chr, pos, <slot>) for distinct anchors (chr, pos)."""
        raise NotImplementedError

    def names(self, end: str | None) -> tuple[str, ...]:
        """The fields that ``end`` takes; none stands for all."""
        return {"st": self.at_start, "en": self.at_end, None: ()}[end]

    def shared(self, st: Pick, en: Pick) -> dict[str, Column]:
        return {}

    def columns(self, st: Pick, en: Pick) -> list[Column]:
        """Aliased feature columns of a contact."""
        raise NotImplementedError

    def settings(self) -> dict:
        return {k: v for k, v in vars(self).items() if isinstance(v, (int, float, str))}


class PeakSums(AnchorFamily):
    """Signal around both anchors and between them, and the N nearest items outside."""

    payload = ("mids", "sigVal")
    at_start = ("around", "hi_in", "left_sig", "left_dist")
    at_end = ("around", "lo_in", "right_sig", "right_dist")

    def __init__(self, track: DataFrame, name: str, window: int, n: int = 4):
        self.track, self.name, self.window, self.n = track, name, window, n

    def _requests(self):
        h = self.window // 2
        return [
            Request("lo_out", -h, BEFORE),
            Request("lo_in", -h, UP_TO),
            Request("hi_in", h, BEFORE),
            Request("hi_out", h, UP_TO),
        ]

    in_stretches = True

    def _located(self, anchors: DataFrame, requests: Sequence[Request], places: Places) -> DataFrame:
        values = self.track.select("chr", F.col("mids").alias("pos"), fixed("sigVal").alias("total"))
        return surveyed(anchors, requests, values, ["total"], self.payload, self.n, _items(self.track, self.payload), places)

    def finish(self, at: Pick) -> Fields:
        h, n = self.window // 2, self.n

        def left() -> Column:
            return pad_left(at("lo_out")["before"], n, self.payload)

        def right() -> Column:
            return pad_right(at("hi_out")["after"], n, self.payload, F.col("pos") + h)

        def distances(items: Column, side: int, absent: Column) -> Column:
            # there is a (possibly empty) list at every position of a chromosome, unless it has no items at all
            away = F.transform(items, lambda e: (e["mids"] - F.col("pos")) * side)
            return F.when(absent, F.array_repeat(F.lit(0).cast("bigint"), n)).otherwise(away)

        return {
            "around": lambda: (at("hi_out")["total"] - at("lo_out")["total"]).cast("double"),
            "lo_in": lambda: at("lo_in")["total"],
            "hi_in": lambda: at("hi_in")["total"],
            "left_sig": lambda: F.transform(left(), lambda e: e["sigVal"]),
            "left_dist": lambda: distances(left(), -1, at("lo_out")["before"].isNull()),
            "right_sig": lambda: F.transform(right(), lambda e: e["sigVal"]),
            "right_dist": lambda: distances(right(), 1, at("hi_out")["after"].isNull()),
        }

    def anchor_rows(self, anchors, places=Places(), end=None):
        names = self.names(end)
        requests = needed(self._requests(), self.finish, names)
        located = one_sided(self._located(anchors, requests, places), "lo_out" if end != "en" else "", "hi_out" if end != "st" else "")
        return by_anchor(located, requests, ["total", "before", "after"], self.slot, self.finish, names, places.key)

    def columns(self, st, en):
        name, n = self.name, self.n
        totals = {
            "L": st("around"),
            "W": (en("lo_in") - st("hi_in")).cast("double"),
            "R": en("around"),
        }
        out = [F.coalesce(v, F.lit(0.0)).alias(f"{name}_{part}") for part, v in totals.items()]
        for label, values in (
            ("LSig", st("left_sig")),
            ("LDist", st("left_dist")),
            ("RSig", en("right_sig")),
            ("RDist", en("right_dist")),
        ):
            out += [values[i].alias(f"{name}_{label}_{i}") for i in range(n)]
        return out


class TrackSums(AnchorFamily):
    """``PeakSums`` of many tracks of one table (with a column ``track``), found by a single search.

    A track on a chromosome takes the place of a chromosome in that search; its answers are put side by side
    at the end. ``names`` are the tracks in order of their columns, as a manifest lists them.
    """

    SEPARATOR = "\x1f"

    def __init__(self, tracks: DataFrame, names: Sequence[str], window: int, n: int = 4, name: str = "tracks"):
        self.names, self.window, self.n, self.name = list(names), window, n, name
        self._tracks = tracks.filter(F.col("track").isin(self.names))
        keyed = self._tracks.withColumn("chr", F.concat_ws(self.SEPARATOR, "chr", "track"))
        self._search = PeakSums(keyed, name, window, n)
        self._families = [PeakSums(tracks, track, window, n) for track in self.names]

    def settings(self) -> dict:
        return {"tracks": ",".join(self.names), "window": self.window, "n": self.n}

    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        if places.home != "pos":
            return self._in_stretches(anchors, places, end)
        track = F.explode(F.array(*[F.lit(t) for t in self.names]))
        # without a chromosome there is no key of both
        keyed = anchors.filter(F.col("chr").isNotNull()).select(*ANCHOR, track.alias("_t")).select(F.concat_ws(self.SEPARATOR, "chr", "_t").alias("chr"), "pos")
        parts = F.split("chr", self.SEPARATOR)
        rows = self._search.anchor_rows(keyed).select(parts[0].alias("chr"), parts[1].alias("_t"), "pos", F.col(self._search.slot).alias("_s"))
        sides = rows.groupBy(*ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_s"))).alias("_m"))
        fields = [F.col("_m")[t].alias(f"t{i}") for i, t in enumerate(self.names)]
        return sides.select(*ANCHOR, F.struct(*fields).alias(self.slot))

    def _in_stretches(self, anchors: DataFrame, places: Places, end: str) -> DataFrame:
        """All tracks of a stretch are looked up in one task, in the order of their names, and put side by side there."""
        search = self._search
        wanted = needed(search._requests(), search.finish, search.names(end))
        kept = self._tracks.withColumn("_t", F.col("track"))
        values = kept.select("chr", "_t", F.col("mids").alias("pos"), fixed("sigVal").alias("total"))
        near = gap_lists(kept.select("chr", "_t", "start", "end", *typed_payload(search.payload)), search.payload, search.n, ("chr", "_t"))
        tags = {(i, r.tag): f"{i}{self.SEPARATOR}{r.tag}" for i in range(len(self.names)) for r in wanted}
        points = [
            F.struct(F.lit(tags[i, r.tag]).alias("tag"), (F.col("pos") + r.offset).alias("p"), F.lit(r.side).alias("side"), F.lit(t).alias("_t"))
            for i, t in enumerate(self.names)
            for r in wanted
        ]
        offsets = [r.offset for r in wanted]
        reach = (min(offsets) + places.lo, max(offsets) + places.hi)
        located = survey(
            anchors, values, ["total"], near, width=places.width, home=places.home, reach=reach, ask=F.array(*points), tasks=places.tasks, apart=self.names
        )
        located = located.withColumns(
            {
                "before": F.when(F.col("tag").endswith(self.SEPARATOR + "lo_out"), F.col("before")) if end == "st" else F.lit(None).cast(located.schema["before"].dataType),
                "after": F.when(F.col("tag").endswith(self.SEPARATOR + "hi_out"), F.col("after")) if end == "en" else F.lit(None).cast(located.schema["after"].dataType),
            }
        )

        def finish(at: Pick) -> Fields:
            def one(i: int) -> Callable[[], Column]:
                made = search.finish(lambda tag: at(tags[i, tag]))
                return lambda: F.struct(*[made[name]().alias(name) for name in search.names(end)])

            return {f"t{i}": one(i) for i in range(len(self.names))}

        requests = [Request(tag, 0, UP_TO) for tag in tags.values()]
        return by_anchor(located, requests, ["total", "before", "after"], self.slot, finish, (), places.key)

    def _fields(self, row, end):
        return F.struct(*[family._fields(row[f"t{i}"], end).alias(f"t{i}") for i, family in enumerate(self._families)])

    def columns(self, st, en):
        out = []
        for i, family in enumerate(self._families):
            out += family.columns(*((lambda tag, pick=pick, i=i: pick(f"t{i}")[tag]) for pick in (st, en)))
        return out


class GeneSums(PeakSums):
    """As ``PeakSums``, but a gene counts in every window its body touches (closed ends)."""

    def _located(self, anchors, requests, places):
        # touching [lo, hi]: started at or before hi, less those that ended before lo
        none = F.lit(None).cast(f"decimal(28,{SCALE})")
        value = fixed("sigVal")
        at_start = self.track.select("chr", F.col("start").alias("pos"), value.alias("started"), none.alias("ended"))
        at_end = self.track.select("chr", F.col("end").alias("pos"), none.alias("started"), value.alias("ended"))
        found = surveyed(
            anchors, requests, at_start.unionByName(at_end), ["started", "ended"], self.payload, self.n, _items(self.track, self.payload), places
        )
        return found.withColumn("total", F.when(F.col("side") == UP_TO, F.col("started")).otherwise(F.col("ended")))


class SiteOrientation(AnchorFamily):
    """Nearest oriented sites outside and inside the contact on both sides, with totals over it."""

    payload = ("mids", "sigVal", "plus_orientation", "minus_orientation")
    words = ("plus_orientation", "minus_orientation")
    labels = ("L", "W_L", "W_R", "R")
    suffix = "_SitesOrient"
    with_totals = True
    at_start = ("left", "from_here", "cnt_before", "total_before", "n_plus_before", "n_minus_before")
    at_end = ("right", "up_to_here", "cnt_up_to", "total_up_to", "n_plus_up_to", "n_minus_up_to")

    def __init__(self, track: DataFrame, name: str, n: int = 4):
        self.track, self.name, self.n = track, name + self.suffix, n

    _requests = (Request("before", 0, BEFORE), Request("up_to", 0, UP_TO))
    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        values = self.track.select(
            "chr",
            F.col("mids").alias("pos"),
            F.lit(1).cast("bigint").alias("cnt"),
            fixed("sigVal").alias("total"),
            (F.col("plus_orientation") != 0).cast("bigint").alias("n_plus"),
            (F.col("minus_orientation") != 0).cast("bigint").alias("n_minus"),
        )
        sums = ["total", "n_plus", "n_minus"] if self.with_totals else []

        def finish(at: Pick) -> Fields:
            return {
                "left": lambda: pad_left(at("before")["before"], self.n, self.payload),
                "from_here": lambda: at("before")["after"],
                "up_to_here": lambda: at("up_to")["before"],
                "right": lambda: pad_right(at("up_to")["after"], self.n, self.payload, F.col("pos")),
                **{f"{c}_before": lambda c=c: at("before")[c] for c in ("cnt", *sums)},
                **{f"{c}_up_to": lambda c=c: at("up_to")[c] for c in ("cnt", *sums)},
            }

        names = self.names(end)
        requests = needed(self._requests, finish, names)
        located = surveyed(anchors, requests, values, ["cnt", *sums], self.payload, self.n, _items(self.track, self.payload), places)
        return by_anchor(located, requests, [*sums, "cnt", "before", "after"], self.slot, finish, names, places.key)

    def shared(self, st, en):
        start, end = F.col("contact_st"), F.col("contact_en")
        inside = en("cnt_up_to") - st("cnt_before")
        first, last = boundary_lists(st("from_here"), en("up_to_here"), inside, self.n, self.payload, start, end)
        return {"left": st("left"), "first": first, "last": last, "right": en("right")}

    def _shared(self, key: str) -> Column:
        return F.col(f"{self.slot}__{key}")

    def columns(self, st, en):
        start, end = F.col("contact_st"), F.col("contact_en")
        away = {
            "left": lambda m: start - m,
            "first": lambda m: m - start,
            "last": lambda m: end - m,
            "right": lambda m: m - end,
        }
        out = []
        for label, key in zip(self.labels, away):
            items = self._shared(key)
            for metric, value in (
                (self.words[0], lambda e: e["plus_orientation"]),
                (self.words[1], lambda e: e["minus_orientation"]),
                ("sigVal", lambda e: e["sigVal"]),
                ("dist", lambda e, key=key: away[key](e["mids"])),
            ):
                out += [value(items[i]).alias(f"{self.name}_{label}_{metric}_{i}") for i in range(self.n)]
        if self.with_totals:
            total = (en("total_up_to") - st("total_before")).cast("double")
            out.append(total.alias(f"{self.name}_W_sumSigVal"))
            out.append((en("n_plus_up_to") - st("n_plus_before")).alias(f"{self.name}_W_N+orient"))
            out.append((en("n_minus_up_to") - st("n_minus_before")).alias(f"{self.name}_W_N-orient"))
        return out


class OnlySitesOrientation(SiteOrientation):
    """The same over an oriented-only track, under its own name."""

    suffix = "_OnlySitesOrient"


class OnlyOrientedSites(SiteOrientation):
    """Nearest sites of an oriented-only track on both sides of both anchors, without totals."""

    suffix = "_OnlyOrient"
    words = ("+_orient", "-_orient")
    labels = ("start_L", "start_R", "end_L", "end_R")
    with_totals = False
    at_start = ("left", "from_here", "cnt_before")
    at_end = ("right", "up_to_here", "cnt_up_to")


class OrientationBlocks(AnchorFamily):
    """Number of neighbouring (plus, then minus) sites between the anchors; plus at the start times minus at the end.

    Expects an oriented-only track.  Sites with equal coordinates are taken
    plus first, so they reduce to one row before any ordering.
    """

    at_start = ("opened", "plus")
    at_end = ("closed", "minus")

    def __init__(self, track: DataFrame, name: str, window: int):
        self.track, self.name, self.window = track, name + "_OrientBlock", window

    def _marks(self) -> DataFrame:
        """(chr, pos, closed, opened, plus, minus): counts attributed to positions."""
        sites = self.track.groupBy("chr", "mids", "start", "end").agg(
            F.bool_or(F.col("plus_orientation") != 0).alias("has_plus"),
            F.bool_or(F.col("minus_orientation") != 0).alias("has_minus"),
            F.sum(fixed("plus_orientation")).alias("plus"),
            F.sum(fixed("minus_orientation")).alias("minus"),
        )
        linked = previous_row(sites, ["chr"], "mids", ["mids", "start", "end"], ["has_plus", "has_minus"])
        # the preceding site ends in plus when it has no minus; this one begins with minus when it has no plus
        joint = F.col("prev.has_plus") & ~F.col("prev.has_minus") & F.col("has_minus") & ~F.col("has_plus")
        joint = F.coalesce(joint, F.lit(False)).cast("bigint")
        within = (F.col("has_plus") & F.col("has_minus")).cast("bigint")
        none = F.lit(0).cast("bigint")
        no_value = F.lit(0).cast(f"decimal(38,{SCALE})")
        here = F.struct(
            F.col("mids").alias("pos"), (joint + within).alias("closed"), within.alias("opened"), F.col("plus"), F.col("minus")
        )
        earlier = F.struct(
            F.coalesce("prev.mids", "mids").alias("pos"), none.alias("closed"), joint.alias("opened"), no_value.alias("plus"), no_value.alias("minus")
        )
        return linked.select("chr", F.explode(F.array(here, earlier)).alias("_m")).select("chr", "_m.*")

    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        h = self.window // 2
        requests = [
            Request("lo_before", -h, BEFORE),
            Request("lo_up_to", -h, UP_TO),
            Request("hi_before", h, BEFORE),
            Request("hi_up_to", h, UP_TO),
        ]
        fields = ["closed", "opened", "plus", "minus"]
        marks = self._marks().withColumns({c: F.col(c).cast(f"decimal(28,{SCALE})") for c in ("plus", "minus")})

        def finish(at: Pick) -> Fields:
            return {
                "closed": lambda: at("lo_up_to")["closed"],
                "opened": lambda: at("hi_before")["opened"],
                "plus": lambda: (at("hi_up_to")["plus"] - at("lo_before")["plus"]).cast("double"),
                "minus": lambda: (at("hi_up_to")["minus"] - at("lo_before")["minus"]).cast("double"),
            }

        names = self.names(end)
        requests = needed(requests, finish, names)
        found = surveyed(anchors, requests, marks, fields, places=places)
        return by_anchor(found, requests, fields, self.slot, finish, names, places.key)

    def columns(self, st, en):
        # pairs closed by the right limit, less pairs opened before the left limit; a pair spanning an
        # empty window would count -1
        blocks = F.greatest(en("closed") - st("opened"), F.lit(0))
        return [blocks.alias(f"{self.name}_W_NBlocks"), (st("plus") * en("minus")).alias(f"{self.name}_HasDivergOrient")]


class ConvergentPair(AnchorFamily):
    """1 when an oriented site lies within two bins beside both anchors.

    Only the minus score is tested, on all four sides; with ``strict_convergent``
    the start needs a minus and the end a plus site.
    """

    payload = ("mids", "plus_orientation", "minus_orientation")

    def __init__(self, track: DataFrame, name: str, binsize: int, strict_convergent: bool = False):
        self.track, self.name, self.binsize = track, name + "_ConvergentPair", binsize
        self.strict_convergent = strict_convergent

    _requests = (Request("before", 0, BEFORE), Request("up_to", 0, UP_TO))

    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        def finish(at: Pick) -> Fields:
            def beside(strand: str) -> Column:
                def close(items: Column) -> Column:
                    item = F.try_element_at(items, F.lit(1))
                    near = F.abs(item["mids"] - F.col("pos")) <= 2 * self.binsize
                    return F.coalesce(near & (item[strand] != 0), F.lit(False))

                return close(at("before")["before"]) | close(at("up_to")["after"])

            return {"plus": lambda: beside("plus_orientation"), "minus": lambda: beside("minus_orientation")}

        located = surveyed(anchors, self._requests, self.track, [], self.payload, 1, _items(self.track, self.payload), places)
        located = one_sided(located, "before", "up_to")
        return by_anchor(located, self._requests, ["before", "after"], self.slot, finish, self.names(end), places.key)

    def columns(self, st, en):
        both = st("minus") & (en("plus") if self.strict_convergent else en("minus"))
        return [both.cast("int").alias(f"{self.name}_HasConvergentPair")]


class DistanceToTss(AnchorFamily):
    """Signed distance from each anchor to the start site of the gene with the nearest midpoint on each side."""

    payload = ("mids", "TSS")

    def __init__(self, track: DataFrame, name: str = "_Distance_toTSS"):
        self.track, self.name = track, name

    _requests = (Request("before", 0, BEFORE), Request("up_to", 0, UP_TO))

    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        def finish(at: Pick) -> Fields:
            return {
                "L": lambda: F.col("pos") - F.try_element_at(at("before")["before"], F.lit(1))["TSS"],
                "R": lambda: F.try_element_at(at("up_to")["after"], F.lit(1))["TSS"] - F.col("pos"),
            }

        located = surveyed(anchors, self._requests, self.track, [], self.payload, 1, _items(self.track, self.payload), places)
        located = one_sided(located, "before", "up_to")
        return by_anchor(located, self._requests, ["before", "after"], self.slot, finish, self.names(end), places.key)

    def columns(self, st, en):
        return [
            pick(side).alias(f"{self.name}_{label}_{side}") for label, pick in (("start", st), ("end", en)) for side in ("L", "R")
        ]


class EigenvectorSummary(AnchorFamily):
    """Mean eigenvector at both anchors; sign changes and population deviation between them.

    Bins past the end of the track (or before position 0) are 0.
    """

    #: Bins per bucket; a bucket also holds the anchors lying in these bins.
    bucket = 1_024
    at_start = ("mean", "m_lo", "m_at")
    at_end = ("mean", "e2", "e1", "e0")

    def __init__(self, track: DataFrame, window: int, binsize: int, name: str = "E1"):
        self.track, self.window, self.binsize, self.name = track, window, binsize, name

    def _steps(self) -> DataFrame:
        """(chr, pos, v, v2, flips) per bin; one more row past the end carries the step into the padding."""
        square = fixed(F.col("E1") * F.col("E1"))
        track = self.track.select("chr", "bin", fixed("E1").alias("v"), square.alias("v2"), "E1")
        linked = previous_row(track, ["chr"], "bin", ["bin"], ["E1"], self.bucket)
        flip = F.col("prev").isNotNull() & (F.signum("E1") != F.signum("prev.E1"))
        steps = linked.select("chr", F.col("bin").alias("pos"), "v", "v2", flip.cast("bigint").alias("flips"))
        ends = self.track.groupBy("chr").agg(
            (F.max("bin") + 1).alias("pos"), (F.max_by("E1", "bin") != 0).cast("bigint").alias("flips")
        )
        return steps.unionByName(ends, allowMissingColumns=True)

    in_stretches = True

    def anchor_rows(self, anchors, places=Places(), end=None):
        b, h = self.binsize, self.window // 2
        count = max(2 * h // b, 1)
        # the interval around the anchor begins at pos - h, where the middle interval ends for a right anchor;
        # the middle interval of a left anchor begins at pos + h
        low, high = F.floor((F.col("pos") - h) / b), F.floor((F.col("pos") + h) / b)
        bins = {"a_lo": low - 1, "a_hi": low + count - 1, "m_lo": high - 1, "m_at": high, "e2": low - 2, "e1": low - 1, "e0": low}

        def finish(at: Pick) -> Fields:
            return {
                "mean": lambda: (at("a_hi")["v"] - at("a_lo")["v"]).cast("double") / count,
                "m_lo": lambda: at("m_lo"),
                "m_at": lambda: at("m_at")["flips"],
                **{e: lambda e=e: at(e) for e in ("e2", "e1", "e0")},
            }

        names, sums = self.names(end), ["v", "v2", "flips"]
        requests = needed([Request(t, 0, UP_TO) for t in bins], finish, names)
        # a bin stands at its first position
        wanted = F.array(*[F.struct(F.lit(r.tag).alias("tag"), (bins[r.tag] * b).alias("p"), F.lit(UP_TO).alias("side")) for r in requests])
        steps = self._steps().withColumn("pos", F.col("pos") * b)
        reach = (places.lo - h - 3 * b, places.hi + max(h, count * b - h))
        width = places.width if places.home != "pos" else self.bucket * b
        found = survey(anchors, steps, sums, width=width, home=places.home, reach=reach, ask=wanted, tasks=places.tasks)
        return by_anchor(found, requests, sums, self.slot, finish, names, places.key)

    def columns(self, st, en):
        b, h, name = self.binsize, self.window // 2, self.name
        start, end = F.col("contact_st"), F.col("contact_en")
        bins = F.greatest(F.floor((end - start - 2 * h) / b), F.lit(1))
        # one past the last bin of the middle interval, relative to the bin where that interval ends
        gap = F.floor((start + h) / b) + bins - F.floor((end - h) / b)
        upto = F.when(gap == -1, en("e2")).when(gap == 0, en("e1")).otherwise(en("e0"))
        total = (upto["v"] - st("m_lo")["v"]).cast("double")
        squares = (upto["v2"] - st("m_lo")["v2"]).cast("double")
        variance = squares / bins - (total / bins) * (total / bins)
        flips = F.greatest(upto["flips"] - st("m_at"), F.lit(0))
        deviation = F.when(bins == 1, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))
        return [
            st("mean").alias(f"{name}_L"),
            en("mean").alias(f"{name}_R"),
            flips.alias(f"{name}_N_Changes"),
            deviation.alias(f"{name}_SD"),
        ]


# ---- families that need more than two anchor rows -------------------------------------------------


class ContactFamily:
    """Features added to the whole contact table at once; subclasses fill in ``add``."""

    name: str

    def header(self) -> list[str]:
        raise NotImplementedError

    def add(self, contacts: DataFrame) -> DataFrame:
        raise NotImplementedError

    settings = AnchorFamily.settings


class LoopFlag(ContactFamily):
    def __init__(self, loops: DataFrame, window: int, name: str = "Loop"):
        self.loops, self.window, self.name = loops, window, name

    def header(self):
        return ["IsLoop"]

    def add(self, contacts):
        return flag_loops(contacts, self.loops, self.window)


class _Binned(ContactFamily):
    """Values per bin of a window centred on the contact; computed once per distinct window start."""

    name: str
    size: int
    n_bins: int

    def header(self):
        return [f"{self.name}{c}" for c in ("win_st", "win_en", "win_rel_st", "win_rel_en")] + [
            f"{self.name}_bin{i}" for i in range(self.n_bins)
        ]

    def bins(self, starts: DataFrame) -> DataFrame:
        """(chr, win_st, i, value) for distinct window starts."""
        raise NotImplementedError

    def add(self, contacts):
        framed = window_frame(contacts, self.size)
        starts = framed.select("chr", "win_st").distinct()
        rows = self.bins(starts).groupBy("chr", "win_st").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("_m"))
        found = lookup(framed, rows, ["chr", "win_st"], ["_m"])
        frame = ["win_st", "win_en", "win_rel_st", "win_rel_en"]
        return found.select(
            *contacts.columns,
            *[F.col(c).alias(f"{self.name}{c}") for c in frame],
            *[F.coalesce(F.col("_m")[i], F.lit(0.0)).alias(f"{self.name}_bin{i}") for i in range(self.n_bins)],
        )


class PeakBins(_Binned):
    def __init__(self, track: DataFrame, name: str, size: int, binsize: int):
        self.track, self.name, self.size, self.binsize = track, name, size, binsize
        self.n_bins = size // binsize

    def add(self, contacts):
        """Contacts, windows and items go to stretches once; shared bins are summed there and contacts take their window's."""
        contacts = cut_lineage(contacts)
        framed, width = window_frame(contacts, self.size), max(STRETCH, self.size)
        tasks = max(1, -(-contacts.count() // SHARE))
        calm, crowded = by_crowding(framed, "win_st", width)
        contacts.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        place, n = ["chr", "_b"], self.n_bins
        starts = framed.filter(F.col("chr").isNotNull()).select("chr", "win_st").distinct()
        windows = starts.withColumn("_b", bucket_of("win_st", width)).repartition(tasks, *place)
        edges = F.posexplode(F.array(*[F.col("win_st") + i * self.binsize for i in range(n)])).alias("_i", "lo")
        spread = windows.select(*place, "win_st", edges)
        bins = spread.select("chr", "lo", (F.col("_b") * width).alias("_home")).distinct()
        items = self.track.select("chr", F.col("mids").alias("pos"), fixed("sigVal").alias("total"))
        ends = {"lo": (F.col("lo"), BEFORE), "hi": (F.col("lo") + self.binsize, UP_TO)}
        asks = F.array(*[F.struct(F.lit(t).alias("tag"), p.alias("p"), F.lit(side).alias("side")) for t, (p, side) in ends.items()])
        found = survey(bins, items, ["total"], width=width, home="_home", reach=(0, self.size), ask=asks, tasks=tasks)
        signed = F.when(F.col("tag") == "hi", F.col("total")).otherwise(-F.col("total"))
        sums = found.groupBy(*place, "lo").agg(F.sum(signed).cast("double").alias("value"))
        listed = [F.max(F.when(F.col("_i") == i, F.col("value"))).alias(f"_bin{i}") for i in range(n)]
        rows = spread.join(sums.hint("shuffle_hash"), [*place, "lo"]).groupBy(*place, "win_st").agg(*listed)
        dealt = (framed if crowded is None else calm(framed)).withColumn("_b", bucket_of("win_st", width)).repartition(tasks, *place)
        joined = dealt.sortWithinPartitions("chr", "win_st").join(rows.hint("shuffle_hash"), [*place, "win_st"], "left")
        done = joined.select(
            *contacts.columns,
            *[F.col(c).alias(f"{self.name}{c}") for c in ("win_st", "win_en", "win_rel_st", "win_rel_en")],
            *[F.coalesce(f"_bin{i}", F.lit(0.0)).alias(f"{self.name}_bin{i}") for i in range(n)],
        )
        return done if crowded is None else done.unionByName(super().add(crowded(framed).select(*contacts.columns)))

    def bins(self, starts):
        windows = starts.select(
            "chr", "win_st", F.posexplode(F.array(*[F.col("win_st") + i * self.binsize for i in range(self.n_bins)])).alias("i", "lo")
        )
        places = windows.select("chr", "lo").distinct().withColumn("hi", F.col("lo") + self.binsize)
        items = self.track.select("chr", F.col("mids").alias("pos"), fixed("sigVal").alias("total"))
        sums = window_totals(places, items, ["total"]).select("chr", "lo", F.col("total").cast("double").alias("value"))
        return windows.join(sums, ["chr", "lo"]).select("chr", "win_st", "i", "value")


class EigenvectorBins(_Binned):
    def __init__(self, track: DataFrame, size: int, binsize: int, name: str = "E1"):
        self.track, self.name, self.size, self.binsize = track, name, size, binsize
        self.n_bins = size // binsize

    def bins(self, starts):
        first = F.floor(F.col("win_st") / self.binsize)
        spread = starts.select("chr", "win_st", F.posexplode(F.array(*[first + i for i in range(self.n_bins)])).alias("i", "bin"))
        return spread.join(self.track.select("chr", "bin", F.col("E1").alias("value")), ["chr", "bin"])


# ---- assembly -----------------------------------------------------------------------------------


def _with_anchors(out: DataFrame, contacts: DataFrame, anchors: DataFrame, families: Sequence[AnchorFamily], share: int) -> DataFrame:
    """``out`` with the anchor rows of both ends; ``contacts`` are the same contacts from a written table."""
    of_slot = {f.slot: f for f in families}

    def by_lookup(out: DataFrame, contacts: DataFrame, anchors: DataFrame) -> DataFrame:
        rows = anchors
        for family in families:
            rows = rows.join(family.anchor_rows(anchors.select(*ANCHOR)), ANCHOR)
        return attach_anchors(out, cut_lineage(rows), list(of_slot), share, taken=lambda slot, end: of_slot[slot].taken(end), plain=contacts)

    none = anchors.limit(0)
    row_bytes = 64 + sum(f.anchor_rows(none.select(*ANCHOR))._jdf.schema().defaultSize() for f in families)
    dist = F.col("contact_en") - F.col("contact_st")
    extent = contacts.agg(F.min(dist).alias("lo"), F.max(dist).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    far = extent["lo"] is None or max(abs(extent["lo"]), abs(extent["hi"])) > REACH
    if far or not all(f.in_stretches for f in families) or anchors.count() * row_bytes <= HELD:
        return by_lookup(out, contacts, anchors)
    calm, crowded = by_crowding(contacts, "contact_st", max(STRETCH, abs(extent["lo"]), abs(extent["hi"])))
    if crowded is None:
        return _joined_in_stretches(out, anchors, families, extent)
    some = crowded(contacts)
    by_pieces = by_lookup(crowded(out), some, cut_lineage(contact_anchors(some)))
    return _joined_in_stretches(calm(out), anchors, families, extent).unionByName(by_pieces)


def compute(contacts: DataFrame, families: Sequence[AnchorFamily | ContactFamily], share: int = 1000) -> DataFrame:
    """Contact columns followed by the features of all families; names must be unique."""
    names = [f.name for f in families]
    if len(set(names)) != len(names):
        raise ValueError(f"feature family names are not unique: {names}")
    anchored = [f for f in families if isinstance(f, AnchorFamily)]
    of_contacts = [f for f in families if isinstance(f, ContactFamily)]
    late = [name for f in of_contacts for name in f.header()]
    if anchored:
        # read three times: for the anchors, their reach and the features
        contacts = cut_lineage(contacts)
    out = contacts
    # what belongs to a contact is added while its row is narrow
    for family in of_contacts:
        out = family.add(out)
    header = list(contacts.columns)
    if anchored:
        # the one pass over the contacts that finds the anchors; all families start from its result
        anchors = cut_lineage(contact_anchors(contacts))
        joined = _with_anchors(out, contacts, anchors, anchored, share)
        columns: list[Column] = []
        shared: list[Column] = []
        for family in anchored:
            st, en = (lambda tag, f=family, e=e: F.col(f"{e}_{f.slot}")[tag] for e in ("st", "en"))
            shared += [column.alias(f"{family.slot}__{key}") for key, column in family.shared(st, en).items()]
            columns += family.columns(st, en)
        out = joined.select("*", *shared).select(*contacts.columns, *columns, *[F.col(f"`{c}`") for c in late])
        header = out.columns
    else:
        header = header + late
    if len(set(header)) != len(header):
        raise ValueError(f"feature names are not unique: {sorted(h for h in header if header.count(h) > 1)}")
    return out


def assemble(contacts: DataFrame, families: Sequence[AnchorFamily | ContactFamily], share: int = 1000) -> DataFrame:
    """The predictor table: key columns, distance, count, then all features."""
    keyed = contacts.select(*KEY, "dist", "contact_count")
    table = compute(keyed, families, share).withColumnRenamed("dist", "contact_dist")
    lead = [*KEY, "contact_dist", "contact_count"]
    return table.select(*lead, *[c for c in table.columns if c not in lead])
