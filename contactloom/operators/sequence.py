"""Base sequences as positioned blocks, base-pair signals as runs.

Blocks are ``chr, block_start, seq``; runs are ``chr, start, end, value``.
Neither is ever expanded to one row per base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.features import ANCHOR, AnchorFamily
from contactloom.operators.ordered import bucket_of, last_seen, overlap_pairs, running_total
from contactloom.session import tasks_for

# The code of each base.
BASES = "ATGCN"
CODES = "01234"
#: Bases in a cell where regions meet blocks, and about the regions that a task holds.
CELL, HELD = 256, 1 << 18


def encode(seq: Column) -> Column:
    """Digits for bases, upper or lower case."""
    return F.translate(F.upper(seq), BASES, CODES)


def sequence_blocks(
    lines: DataFrame, only: Sequence[str] = (), exclude: Sequence[str] = (), rename: dict[str, str] | None = None
) -> DataFrame:
    """Blocks from the numbered lines (file, line, value) of FASTA files, one block per line.

    A chromosome starts at each header line and is known by the header's first
    word.  Either a list of chromosomes to keep or to leave out may be given.
    """
    if only and exclude:
        raise ValueError("give either the chromosomes to keep or those to leave out")
    text = F.trim("value")
    is_header = F.col("value").startswith(">")
    name = F.regexp_extract("value", r"^>\s*(\S+)", 1)
    if rename:
        name = F.coalesce(F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])[name], name)
    sized = lines.select("file", "line", "value", F.when(is_header, 0).otherwise(F.length(text)).cast("bigint").alias("_len"))
    placed = running_total(sized, ["file"], "line", ["line"], "_len", "_at_line")
    named = last_seen(placed.withColumn("_name", name), ["file"], "line", is_header, ["_name", "_at_line"])
    blocks = named.filter(~is_header & (F.col("_len") > 0)).select(
        F.col("seen._name").alias("chr"), (F.col("_at_line") - F.col("seen._at_line")).alias("block_start"), text.alias("seq")
    )
    if only:
        return blocks.filter(F.col("chr").isin(list(only)))
    return blocks.filter(~F.col("chr").isin(list(exclude))) if exclude else blocks


def split_blocks(sequences: DataFrame, size: int = 4_096) -> DataFrame:
    """Blocks of bounded size from whole sequences (chr, seq), cut in one pass over each."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.filter("seq IS NOT NULL").select("chr", F.posexplode_outer(pieces).alias("_k", "seq")).select(
        "chr", (F.coalesce("_k", F.lit(0)).cast("bigint") * size).alias("block_start"), F.coalesce("seq", F.lit("")).alias("seq")
    )


def sequence_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chr").agg(F.max(F.col("block_start") + F.length("seq")).alias("size"))


def sequence_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` (chr, start, end, ...) with ``seq``, the bases of [start, end); a region past the end is cut.

    Blocks are cut at the borders of cells of ``CELL`` bases, and regions stand in the cells that they cover. Distinct regions, which
    are narrow, are the side of the join that a task holds, about ``HELD`` of them; the bases stream past and are never sorted.
    """
    ids = [c for c in regions.columns if c not in ("chr", "start", "end")]
    tasks = tasks_for(blocks.sparkSession, regions.count(), HELD)

    def celled(df: DataFrame, first: str, last: str) -> DataFrame:
        ends = [bucket_of(c, CELL) for c in (first, F.greatest(first, last))]
        return df.withColumn("_cell", F.explode(F.sequence(*ends)))

    spans = regions.select("chr", F.col("start").alias("a_start"), (F.col("end") - 1).alias("a_end")).distinct()
    whole = blocks.select("chr", F.col("block_start").alias("b_start"), (F.col("block_start") + F.length("seq") - 1).alias("b_end"), "seq")
    lo, hi = F.greatest("b_start", F.col("_cell") * CELL), F.least("b_end", F.col("_cell") * CELL + (CELL - 1))
    bases = F.substring("seq", (lo - F.col("b_start") + 1).cast("int"), (hi - lo + 1).cast("int"))
    # only the bases of its cell travel with a row
    cut = celled(whole, "b_start", "b_end").select("chr", "_cell", "b_start", lo.alias("_lo"), hi.alias("_hi"), bases.alias("_bases"))
    cut, wanted = (df.repartition(tasks, "chr", "_cell") for df in (cut, celled(spans, "a_start", "a_end")))
    met = cut.join(wanted.hint("shuffle_hash"), ["chr", "_cell"]).filter(
        # the last condition tells for regions without bases, which have to lie inside a block
        (F.col("a_start") <= F.col("_hi")) & (F.greatest("a_start", "a_end") >= F.col("_lo")) & (F.col("a_end") >= F.col("b_start"))
    )
    at = F.greatest("a_start", "_lo")
    piece = F.substring("_bases", (at - F.col("_lo") + 1).cast("int"), (F.least("a_end", "_hi") - at + 1).cast("int"))
    pieces = met.select("chr", "a_start", "a_end", F.struct(at.alias("_at"), piece.alias("_piece")).alias("_p"))
    # the pieces of one region are bounded by its length
    joined = pieces.groupBy("chr", "a_start", "a_end").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    found = joined.select(
        "chr",
        F.col("a_start").alias("start"),
        (F.col("a_end") + 1).alias("end"),
        F.array_join(F.transform("_p", lambda e: e["_piece"]), "").alias("seq"),
    )
    return regions.join(found, ["chr", "start", "end"]).select("chr", "start", "end", *ids, "seq")


def gc_content(sequences: DataFrame) -> DataFrame:
    """Share of G and C per sequence (chr, seq)."""
    return sequences.select(
        "chr", F.try_divide(F.length("seq") - F.length(F.translate("seq", "GCgc", "")), F.length("seq")).alias("gc")
    )


def code_bins(blocks: DataFrame, binsize: int) -> DataFrame:
    """(chr, bin, total): sum of base codes per bin."""
    first = F.floor(F.col("block_start") / binsize)
    last = F.floor((F.col("block_start") + F.length("seq") - 1) / binsize)
    spread = blocks.filter(F.length("seq") > 0).select("chr", "block_start", "seq", F.explode(F.sequence(first, last)).alias("bin"))
    lo = F.greatest(F.col("bin") * binsize - F.col("block_start"), F.lit(0))
    hi = F.least((F.col("bin") + 1) * binsize - F.col("block_start"), F.length("seq"))
    piece = F.upper(F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int")))

    def count(base: str) -> Column:
        return F.length("_p") - F.length(F.translate("_p", base, ""))

    total = count("T") + count("G") * 2 + count("C") * 3 + count("N") * 4
    return spread.select("chr", "bin", piece.alias("_p")).groupBy("chr", "bin").agg(F.sum(total).alias("total"))


def clip_runs(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs of a signal inside each region (chr, start, end, ...), cut at its borders; NaN values stay."""
    ids = [c for c in regions.columns if c not in ("chr", "start", "end")]
    left = regions.select("chr", F.col("start").alias("a_start"), F.col("end").alias("a_end"), *ids)
    right = runs.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "value")
    meet = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    return overlap_pairs(left, right, meet).select(
        *ids, "chr", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), "value"
    )


class AnchorSequence(AnchorFamily):
    """Base codes around each anchor bin; null where the sequence does not cover it.

    One array per anchor; ``wide`` makes it one column per base, which is for short stretches only.
    """

    def __init__(self, blocks: DataFrame, binsize: int, distance: int, name: str = "SequencePredictor", wide: bool = False):
        self.blocks, self.binsize, self.distance, self.name, self.wide = blocks, binsize, distance, name, wide

    @property
    def length(self) -> int:
        return self.binsize + 2 * self.distance

    def anchor_rows(self, anchors):
        start = F.col("pos") - self.distance
        regions = anchors.select("chr", start.alias("start"), (start + self.length).alias("end"), "pos").filter("start >= 0")
        found = sequence_regions(self.blocks, regions).filter(F.length("seq") == self.length)
        codes = F.transform(F.split(encode(F.col("seq")), ""), lambda c: c.cast("int"))
        rows = found.select(*ANCHOR, F.struct(F.slice(codes, 1, self.length).alias("codes")).alias(self.slot))
        return anchors.select(*ANCHOR).join(rows, ANCHOR, "left")

    def columns(self, st, en):
        if not self.wide:
            return [pick("codes").alias(f"{self.name}_{side}") for side, pick in (("left", st), ("right", en))]
        return [
            F.get(pick("codes"), F.lit(i)).alias(f"{side}{i + 1}") for side, pick in (("left", st), ("right", en)) for i in range(self.length)
        ]
