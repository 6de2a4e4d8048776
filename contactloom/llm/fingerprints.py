"""Document fingerprints by winnowing, with built-in functions only.

A text is cut into pieces at white space (words; what a word of over ``PIECE`` characters becomes is a parameter: in
``edited_pairs`` each of its characters begins a piece, so that nothing depends on where the word starts). Every
run of ``k`` pieces is hashed; of each window of ``window`` successive hashes the smallest is kept, the
rightmost of equal ones, with its position. Two texts that share ``window + k - 1`` pieces in a row keep a
common hash there. A text with fewer pieces than ``k`` is one run, and one with fewer runs than
``window`` one window; a text without pieces has no hashes. ``edited_pairs`` keeps more of short texts, see ``full_marks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import partitions, text_or_empty

PIECE = 24
#: pieces that are cut from the start of a long word
CUT = rf"(\S{{1,{PIECE}}})"
#: words of at most PIECE characters; in longer ones the eight characters from each one on (fewer at the word's end)
SLIDING = rf"(?=((?<!\S)\S{{1,{PIECE}}}+(?!\S)|\S{{1,8}}))(?:(?<!\S)\S{{1,{PIECE}}}+(?!\S)|\S)"
#: texts of at most so many characters keep all runs of pieces and of GRAM characters; half of one has enough words
#: for a common window with a longer text
SHORT = 256
GRAM = 3
#: a mark is one number: 44 bits of the hash, then 20 bits that fall with the position
PLACE = 20
LAST = (1 << PLACE) - 1


def marks(text: Column, k: int, window: int, pattern: str = CUT) -> Column:
    """The kept hashes of a text as an array of marks, in order of position.

    ``pattern`` finds the pieces: its first group.
    The place part of a mark makes the rightmost of equal hashes the smallest number. It counts positions
    modulo 2**20; neighbouring marks lie at most ``window`` apart, so longer texts lose nothing by that.
    """
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (k - 1)))
        # past the end of a short text get() is null, which the hash passes over
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(k)]))

    def placed(r: Column) -> Column:
        return F.transform(r, lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(F.lit(LAST) - i.bitwiseAND(F.lit(LAST))))

    def smallest(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - (window - 1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(a, i, window))))

    hashes = F.transform(pieces, lambda w: F.xxhash64(w))
    found = through(through(through(hashes, runs), placed), smallest)
    return F.when(F.regexp_like(text, F.lit(r"\S")), found).otherwise(F.array().cast("array<bigint>"))


def full_marks(text: Column, k: int, window: int) -> Column:
    """Marks that short texts share with their edited ones too.

    A text of at most ``SHORT`` characters keeps all its runs of ``k`` pieces, then all runs of ``GRAM``
    characters (of a text with fewer, the whole), at their positions among the characters.
    """
    grams = marks(text, 1, 1, rf"(?s)(?=(.{{{GRAM}}}|^.{{1,{GRAM - 1}}}$)).")
    short = F.concat(marks(text, k, 1, SLIDING), grams)
    return F.when(F.length(text) <= SHORT, short).otherwise(marks(text, k, window, SLIDING))


def through(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashes_of(m: Column) -> Column:
    return F.transform(m, lambda x: F.shiftrightunsigned(x, PLACE))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays of distinct or repeated hashes; 1 if both are empty."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / together)


def as_text(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: F.concat((F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(x, PLACE))))), ",")


def with_bucket(docs: DataFrame, id_column: str, buckets: int) -> DataFrame:
    """``docs`` plus ``bucket``: ranges of the id that hold about as many rows each; a null id is in bucket -1."""
    found = docs.agg(F.percentile_approx(id_column, [i / buckets for i in range(1, buckets)], 10_000 + 10 * buckets)).first()[0] if buckets > 1 else None
    cuts = sorted(set(found or []))
    each = max(1, int(len(cuts) ** 0.5))
    key = F.col(id_column)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= key))

    if not cuts:
        return docs.withColumn("bucket", F.when(key.isNull(), -1).otherwise(0))
    # the coarse cuts are every each-th one: few comparisons find the range
    coarse = below(F.array(*[F.lit(c).cast("long") for c in cuts[each - 1 :: each]]))
    fine = below(F.slice(F.array(*[F.lit(c).cast("long") for c in cuts]), coarse * each + 1, F.lit(each)))
    return docs.withColumn("bucket", F.when(key.isNull(), -1).otherwise(coarse * each + fine))


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 2, window: int = 4) -> DataFrame:
    """Each document's fingerprint next to that of an edited text and of the next document.

    Returns doc_id, n_chars, text, edited (the text whose last floor(n_chars / 2) code points are replaced
    by the first as many, or all, of the next document's), marks, edited_marks (see ``full_marks``), near_edited and near_next (likeness to the edited text's and the next document's marks).

    Documents follow each other by descending id, a null id comes last, equal ids by descending text; after
    the last comes the first, so a single document is its own next. A null text is empty; repeated rows
    are kept; columns other than the two are ignored; an empty table gives no rows. Only one shuffle moves
    texts: ranges of ids are sorted on their own, and each also gets the first row of the range after it.
    """
    buckets = 8 * partitions(docs.sparkSession)
    base = with_bucket(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text")), "doc_id", buckets)
    tops = base.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one row for each bucket
    ordered = Window.orderBy(F.desc("bucket"))
    # a bucket's first row follows the last row of the bucket above it; the very first follows the very last
    tops = tops.withColumn("to", F.coalesce(F.lag("bucket").over(ordered), F.min("bucket").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = (
        base.alias("d")
        .join(F.broadcast(tops.alias("t")), (F.col("d.bucket") == F.col("t.bucket")) & F.col("d.doc_id").eqNullSafe(F.col("t.top")))
        .groupBy("to", "d.doc_id")
        .agg(F.max("text").alias("text"))
        .select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("head"))
    )
    rows = base.withColumn("head", F.lit(False)).unionByName(heads).repartition("bucket")
    marked = rows.withColumn("marks", full_marks(F.col("text"), k, window))
    w = Window.partitionBy("bucket").orderBy("head", F.desc_nulls_last("doc_id"), F.desc("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    linked = (
        marked.withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_hashes", F.lead(hashes_of(F.col("marks"))).over(w))
        .where("not head")
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
        .withColumn("edited_marks", full_marks(F.col("edited"), k, window))
    )
    hashes = hashes_of(F.col("marks"))
    return linked.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        "edited",
        "marks",
        "edited_marks",
        likeness(hashes, hashes_of(F.col("edited_marks"))).alias("near_edited"),
        likeness(hashes, F.col("next_hashes")).alias("near_next"),
    )
