"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf. The leaves of a group, in order, form a tree of runs of ``arity`` nodes; the subroots of
the groups, in order of the group, form the tree above them. A level is one table of nodes (tree, idx, digest).
A node's siblings stand at computed indices (``idx XOR 1`` in a binary tree, else its slot in the run moved on
by 1, 2, ...), so a level equijoins its nodes with themselves once per shift; the nodes in slot 0 then
hold a whole run and emit the parents. Proofs come down the same tables: a node's proof is its own siblings
followed by its parent's proof, again by an equijoin.

A join key (tree, idx) belongs to one node, so a group that holds most rows is spread like any other. Positions
come from a range sort and one small table of row counts by range. Each level is written once; their sizes
fall by ``arity``. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import partitions
from contactloom.session import cut_lineage


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts after one another, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def leaf_of(*values: Column) -> Column:
    """Digest of the values: each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path of (left, right) siblings, as 32 bytes."""
    return F.aggregate(path, leaf, lambda at, s: digest(as_text(s["left"]), as_text(at), as_text(s["right"])))


def proof_of(path: Column) -> Column:
    """All siblings of a path as hexadecimal text, from the lowest level up, left to right."""
    return F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, as_text(s["left"]), as_text(s["right"])))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``idx``, the position in its group (from 0), and ``n``, the group's rows; nulls come first.

    Equal rows are told apart by a salt, so that very many of them still fill several ranges.
    """
    by = [*group, *order, "_salt"]
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # the id counts the rows of a range in order and holds the range's number above its 33 lower bits
    stored = cut_lineage(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # one row per range and group that meet
    runs = stored.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = part == F.col("_part")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return stored.join(runs, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` plus ``left`` and ``right``, the digests beside a node in its run, and ``above``: in slot 0 the parent's digest."""
    slot, run = F.col("idx") % arity, F.floor(F.col("idx") / arity)
    joined = nodes
    for shift in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else run * arity + (slot + shift) % arity
        other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("digest").alias(f"_d{shift}"))
        joined = joined.withColumn("_want", at.cast("long")).join(other, (F.col("tree") == F.col("_t")) & (F.col("_want") == F.col("_i")), "left").drop("_t", "_i", "_want")
    empty = F.lit(b"")

    # shifted past the end of the run is left of the node, anything else right of it
    def side(left: bool) -> Column:
        beside = [F.when((slot + s >= arity) if left else (slot + s < arity), F.col(f"_d{s}")) for s in range(1, arity)]
        return F.concat(empty, *[F.coalesce(b, empty) for b in beside])

    sides = joined.withColumn("left", side(True)).withColumn("right", side(False)).drop(*[f"_d{s}" for s in range(1, arity)])
    above = F.when(slot == 0, digest(as_text(F.col("digest")), as_text(F.col("right"))))
    return sides.withColumn("above", above)


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees in ``nodes`` (tree, idx, n, digest, more), and (tree, height, digest) of their tops.

    Level i is a written table of the nodes of trees that go on above it, with their siblings; further columns stay on level 0.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], None
    while most > 0:
        ends = nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest")
        tops = ends if tops is None else tops.unionByName(ends)
        if most == 1:
            break
        level = cut_lineage(with_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        up = lambda c: F.ceil(F.col(c) / arity).cast("long").alias(c)
        nodes = level.where("above is not null").select("tree", F.floor(F.col("idx") / arity).alias("idx"), up("n"), F.col("above").alias("digest"))
        most = -(-most // arity)
    return levels, cut_lineage(tops) if tops is not None else nodes.select("tree", F.lit(0).alias("height"), "digest")


def descend(levels: list[DataFrame], tops: DataFrame, arity: int, carry: Sequence[str]) -> DataFrame:
    """(idx, path, ``carry``) of every leaf below ``levels``, where ``tops`` (tree, height, path, more) starts the paths.

    All columns of ``tops`` come down; ``carry`` names columns of level 0. Trees of height 0 are not among the rows.
    """
    more = [c for c in tops.columns if c not in ("tree", "height", "path")]
    above = None
    for i in range(len(levels) - 1, -1, -1):
        own = tops.where(F.col("height") == i + 1).select("tree", F.lit(0).cast("long").alias("idx"), "path", *more)
        above = own if above is None else above.unionByName(own)
        parents = above.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_path"), *more)
        nodes = levels[i].withColumn("_run", F.floor(F.col("idx") / arity))
        met = nodes.join(parents, (F.col("tree") == F.col("_t")) & (F.col("_run") == F.col("_i")))
        path = F.concat(F.array(F.struct("left", "right")), F.col("_path")).alias("path")
        above = met.select("tree", "idx", path, *more, *(carry if i == 0 else []))
        if i:
            above = cut_lineage(above)
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", arity: int = 3, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(``order``, ``group``, the names in ``carry``, leaf, subroot, root, path) of every row of ``docs``.

    ``leaf`` covers ``fields``. Per ``group``, leaves ascend by ``order``; every ``arity`` consecutive nodes
    (at the end fewer, even one) become one, until one is left, the subroot; subroots in order of the group
    (null first, by UTF-8 bytes) likewise become the root. ``path`` lists the siblings on the way to the
    root, lowest level first, as (left, right). ``carry`` are further columns of the result, computed from ``docs``. Digests are 32
    bytes; ``as_text`` gives them as text.

    Nulls are values of their own (as a group, too; null ids come first), an empty text differs from null; rows with
    one id are ordered by their leaf, wholly equal rows are leaves of their own; other columns of ``docs`` are ignored; an
    empty table gives no rows. Texts of any length are read once.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    extra = dict(carry or {})
    leaves = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), leaf_of(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(f"_c{i}") for i, c in enumerate(extra.values())])
    kept = ["_order", "_group", *[f"_c{i}" for i in range(len(extra))]]
    placed = cut_lineage(numbered(leaves, ["_group"], ["_order", "digest"]))
    groups = cut_lineage(numbered(placed.where("idx = 0").select("_group"), [], ["_group"]))
    numbers = groups.select(F.col("_group").alias("_g"), F.col("idx").alias("tree"))
    nodes = cut_lineage(placed.join(numbers, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g"))
    levels, tops = climb(nodes, arity)
    # the tree of the subroots: one tree, whose leaves are the trees
    many = groups.agg(F.count(F.lit(1)).alias("n")).first()[0]
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), "digest", F.col("height").alias("_height"))
    upper_levels, root = climb(upper, arity)
    found = root.head(1)
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    peak = root.select("tree", "height", nothing.alias("path"))
    if upper_levels:
        starts = descend(upper_levels, peak, arity, ["digest", "_height"])
    else:
        starts = upper.withColumn("path", nothing)
    starts = cut_lineage(starts.select(F.col("idx").alias("tree"), F.col("_height").alias("height"), "path", F.col("digest").alias("subroot")))
    lone = nodes.where("n = 1").join(starts.where("height = 0").drop("height"), "tree").select("digest", *kept, "path", "subroot")
    proven = lone
    if levels:
        proven = descend(levels, starts, arity, ["digest", *kept]).select("digest", *kept, "path", "subroot").unionByName(lone)
    return proven.select(
        F.col("_order").alias(order), F.col("_group").alias(group), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)],
        F.col("digest").alias("leaf"), "subroot", F.lit(bytes(found[0]["digest"]) if found else None).cast("binary").alias("root"), "path",
    )
