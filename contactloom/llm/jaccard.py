"""Near-duplicate join: n-gram Jaccard by a blocked product of the document by n-gram incidence matrix.

Rows of the matrix are the different n-gram sets (equal sets are merged first), columns are hashed n-grams.
A pair of sets can reach the threshold only if they share one of the first ``n - ceil(t n) + 1`` n-grams of each in any
order common to all; so only those *leading* columns of a row enter the product. The order is made so that
busy columns come last:

1. the quarter of the columns with the lowest hashes, if at most ``BUSY`` sets have them;
2. the rest, by how many of the sets have them that need more than (1) offers (``hard`` sets), then by hash.

Columns of at most ``BUSY`` rows are multiplied by listing their pairs and adding up. Two rows at the threshold
differ in at most ``(1 - t) / (1 + t)`` of the sum of their sizes, so pairs that differ by more in the columns of (1)
are discarded; the others are counted exactly on the whole rows. Busier columns are multiplied as
matrices: blocks of at most ``TILE`` rows meet in a task that accumulates overlaps over slices of columns,
compares them with the bound that the sizes give, and returns a spanning forest of the links, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import blocks, short_batches
from contactloom.llm.components import components
from contactloom.session import cut_lineage, short_table

BUSY = 32
TILE = 2048
#: cells of a dense slice of the incidence matrix
SLICE = 8_000_000
#: ids up to which a list of documents is sent to all executors (16 bytes each); beyond it the texts are shuffled
SENT_IDS = 250_000
#: pairs that are counted in one task
PAIRS = 2000

#: bits that name a column of the lowest quarter: fewer to shuffle; n-grams that fall into one column only add pairs to count
COLUMN_BITS = 40

#: words of more bytes are rare and hashed one by one
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (bytes between white space) of one text; A-Z count as a-z.

    Eight bytes at a time go through a mixing that is not linear, so that no pattern of letters makes words collide; the few
    words of over ``LONG_WORD`` bytes take a cryptographic hash.
    """
    blank = _SPACE[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), dtype="<u8", buffer=low.tobytes(), strides=(1,))
    left = ends - starts
    out = mixed(left.astype(np.uint64) * _BASE)
    long = np.flatnonzero(left > LONG_WORD)
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    word = np.flatnonzero(left <= LONG_WORD)
    at, left = starts[word], left[word]
    while len(word):
        part = eight[at] & (~np.uint64(0) >> (64 - 8 * np.minimum(left, 8)).astype(np.uint64))
        out[word] = mixed((out[word] ^ part) * _BASE + np.uint64(1))
        more = left > 8
        word, at, left = word[more], at[more] + 8, left[more] - 8
    return out


def gram_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes (signed) of the ``k``-word runs of a whole text; all its words as one run if fewer."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_hashes(data)
    if not len(words):
        return np.zeros(0, np.int64)
    size = min(k, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * _BASE + words[i : len(words) - size + 1 + i])
    return np.unique(total.view(np.int64))


def leading(n: Column, percent: int) -> Column:
    """How many leading n-grams a set of ``n`` must show."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def column(gram: str) -> Column:
    """The column of an n-gram: the lowest quarter of the hashes by their first ``COLUMN_BITS`` bits, others by the whole hash."""
    low = (F.col(gram) >= 0) & (F.col(gram) < F.lit(1 << 62))
    return F.when(low, F.shiftright(gram, 62 - COLUMN_BITS)).otherwise(F.col(gram)).alias("h")


def gram_sets(docs: DataFrame, k: int, all_grams: bool) -> DataFrame:
    """(doc_id, n, sid, grams): set size, an id of the set, and its hashes, only the lowest quarter unless ``all_grams``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [gram_set(x, k) for x in part.column("text").to_pylist()]
                # the lowest quarter of the unsigned hashes: non-negative and below 2**62
                kept = sets if all_grams else [s[np.searchsorted(s, 0) : np.searchsorted(s, 1 << 62)] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]))),
                    ],
                    ["doc_id", "n", "sid", "grams"],
                )

    return docs.mapInArrow(run, "doc_id long, n int, sid binary, grams array<long>")


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_anti``: isn't) in ``ids``: without moving texts while the ids are few."""
    ids = cut_lineage(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", how)


def forest(count: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links (row numbers) that connect what ``pairs`` connect, without circles."""
    parent, kept = list(range(count)), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((int(a), int(b)))
    return kept


def linked_rows(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """All pairs (i < j) of rows that reach the threshold, by a product over slices of the incidence matrix."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    _, columns = np.unique(columns[shared], return_inverse=True)
    rows, width = rows[shared], int(columns.max(initial=-1)) + 1
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = max(64, SLICE // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, width, step):
        a, b = np.searchsorted(columns, [start, start + step])
        piece = np.zeros((len(sets), min(step, width - start)), dtype=np.float32)
        piece[rows[a:b], columns[a:b] - start] = 1
        overlap += piece @ piece.T
    found = []
    for i in range(len(sets) - 1):
        o = overlap[i, i + 1 :].astype(np.int64)
        j = np.flatnonzero((o > 0) & (100 * o >= percent * (sizes[i] + sizes[i + 1 :] - o)))
        found.append(np.column_stack([np.full(len(j), i), j + i + 1]))
    return np.concatenate([*found, np.zeros((0, 2), dtype=np.int64)])


def listed_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the columns' rows whose sizes allow the threshold, once for each column they share."""
    columns = postings.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "doc_id"))).alias("rows"))
    one = columns.select("rows", F.posexplode("rows").alias("at", "x"))
    partners = F.filter(
        F.slice("rows", F.col("at") + 2, F.size("rows")),
        lambda y: (y["doc_id"] != F.col("x.doc_id")) & (100 * F.col("x.n") >= percent * y["n"]),
    )
    pairs = one.select(F.col("x.doc_id").alias("one"), F.explode(partners).alias("other"))
    return pairs.select(F.least("one", "other.doc_id").alias("a"), F.greatest("one", "other.doc_id").alias("b"))


def within_bounds(first: DataFrame, more: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that differ by no more than their sizes allow in the columns that ``first`` lists in full.

    ``rows`` (doc_id, n, cold): set size, and how many of those columns the row has. ``more`` lists pairs that
    share other columns.
    """
    pairs = first.withColumn("o", F.lit(1)).unionByName(more.withColumn("o", F.lit(0))).groupBy("a", "b").agg(F.sum("o").alias("o"))
    for x in "ab":
        pairs = pairs.join(rows.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("cold").alias(f"cold_{x}")), x)
    differ = F.col("cold_a") + F.col("cold_b") - 2 * F.col("o")
    return pairs.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def counted(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole rows reach the threshold.

    Pairs are dealt into blocks by the smallest id that their first one is paired with, so that groups tend to
    meet in one block; a text goes to the blocks that need it, where its row is made once and overlaps are counted.
    """
    pairs = cut_lineage(pairs)
    total = blocks(pairs.count(), PAIRS)
    smallest = pairs.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "a")
    pairs = pairs.join(smallest, "a", "left").select("a", "b", F.pmod(F.xxhash64(F.coalesce("least", "a")), F.lit(total)).cast("int").alias("block"))
    needed = pairs.select(F.col("a").alias("doc_id"), "block").unionByName(pairs.select(F.col("b").alias("doc_id"), "block"))
    needed = cut_lineage(needed.groupBy("doc_id").agg(F.collect_set("block").alias("blocks")))
    few = needed.count() <= SENT_IDS
    texts = docs.join(F.broadcast(needed) if few else needed, "doc_id").select(F.explode("blocks").alias("block"), "doc_id", "text")

    def count(sides: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list[np.ndarray]] = {}
        for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
            sets.setdefault(doc, []).append(gram_set(text, k))

        def reached(x: np.ndarray, y: np.ndarray) -> bool:
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                return False
            o = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * o >= percent * (len(x) + len(y) - o) > 0

        ok = [any(reached(x, y) for x in sets[a] for y in sets[b]) for a, b in zip(sides["a"], sides["b"], strict=True)]
        return sides.loc[ok, ["a", "b"]]

    return pairs.groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(count, "a long, b long")


def multiplied(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the busy columns of ``postings`` (h, doc_id, part, n) connect.

    A column's rows are put in order of size and cut into blocks; blocks meet if their sizes allow links.
    """
    # rows of one size are numbered by hash, so that no column is sorted as a whole
    heights = postings.groupBy("h", "n").agg(F.count("*").alias("m"))
    before = heights.withColumn("before", F.sum("m").over(Window.partitionBy("h").orderBy("n")) - F.col("m"))
    placed = postings.join(before, ["h", "n"]).withColumn(
        "block", F.floor((F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("m"))) / (TILE // 2)).cast("int")
    )
    spans = placed.groupBy("h", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = spans.alias("x"), spans.alias("y")
    meets = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") <= F.col("y.block")) & (100 * F.col("x.high") >= percent * F.col("y.low"))).select(
        F.col("x.h").alias("h"), F.col("x.block").alias("i"), F.col("y.block").alias("j")
    )
    sides = meets.select("h", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    tiles = sides.join(placed.select("h", "block", "doc_id", "part"), ["h", "block"]).join(sets, ["doc_id", "part"])

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        ids = frame["doc_id"].to_numpy()
        links = forest(len(ids), linked_rows([np.asarray(g) for g in frame["grams"]], percent))
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}).astype("int64")

    return tiles.select("h", "i", "j", "doc_id", "grams").groupBy("h", "i", "j").applyInPandas(multiply, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every row of ``docs``.

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case; two documents
    link if their sets of ``k``-word runs have a Jaccard similarity of ``percent`` / 100 or more; the
    component is named by its smallest id. A document without words has an empty set and links with
    nothing; so does a row with a null id (its component is null). Rows with equal ids are one document of
    the graph. Other columns are ignored; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with short_table(gram_sets(own, k, False)) as pools:
        sizes = cut_lineage(pools.select("doc_id", "n", "sid"))
        # equal sets are one row of the matrix, named by their smallest id
        named = pools.where("n > 0 and doc_id is not null")
        copies = named.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
        copies = cut_lineage(copies.where("m > 1").select("sid", "rep"))
        later = cut_lineage(named.select("doc_id", "sid").join(copies, "sid").where("doc_id <> rep").select("doc_id", "sid"))
        # an id that stands on several rows keeps those of its rows that are no copies
        other = only(named, later).join(later, ["doc_id", "sid"], "left_anti")
        # a set that an id repeats is one row; the ids on several rows are few or none
        many = cut_lineage(named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
        single = many.isEmpty()

        def parted(frame: DataFrame) -> DataFrame:
            """With ``part``, which tells the sets of one id apart; 0 for an id on one row, so that its postings carry no hash of the set."""
            if single:
                return frame.withColumn("part", F.lit(0).cast("long"))
            several = only(frame, many).dropDuplicates(["doc_id", "sid"]).withColumn("part", F.xxhash64("sid"))
            return only(frame, many, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(several)

        rows = parted(only(named, later, "left_anti").unionByName(other)).withColumn("need", leading(F.col("n"), percent))
        postings = rows.select(F.explode("grams").alias("gram"), "doc_id", "part", "n").select(column("gram"), "doc_id", "part", "n")
        # written, so that the join can split the rows of a busy column
        heights = cut_lineage(postings.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
        shared = cut_lineage(postings.join(heights.hint("shuffle_hash"), "h"))
        busy = shared.where(F.col("m") > BUSY).groupBy("doc_id", "part").agg(F.count("*").alias("busy"))
        each = cut_lineage(
            rows.select("doc_id", "part", "n", "need", F.size("grams").alias("pool"))
            .join(busy, ["doc_id", "part"], "left")
            .withColumn("cold", F.col("pool") - F.coalesce("busy", F.lit(0)))
        )
    # pairs are of ids: of several sets the widest bounds count
    sized = each.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("cold").alias("cold"))
    hard = each.where("cold < need").select("doc_id", "part", "need", F.col("cold").alias("have"))
    sets = parted(gram_sets(only(own, hard), k, True).where("n > 0")).select("doc_id", "part", "n", "grams")
    if not single:
        sets = only(sets, many, "left_anti").unionByName(only(sets, many).join(hard.select("doc_id", "part"), ["doc_id", "part"], "left_semi"))
    sets = cut_lineage(sets)
    low = (F.col("h") >= 0) & (F.col("h") < F.lit(1 << 62))
    busy_columns = shared.where(F.col("m") > BUSY).select("h").distinct().withColumn("late", F.lit(True))
    rest = sets.select(F.explode("grams").alias("gram"), "doc_id", "part", "n").select(column("gram"), "doc_id", "part", "n")
    rest = rest.join(busy_columns, "h", "left").where(~low | F.col("late").isNotNull()).drop("late")
    rest_heights = rest.groupBy("h").agg(F.count("*").alias("m"))
    first = Window.partitionBy("doc_id", "part").orderBy("m", "h")
    chosen = (
        rest.join(rest_heights, "h")
        .withColumn("at", F.row_number().over(first))
        .join(hard, ["doc_id", "part"])
        .where("at <= need - have and m > 1")
        .select("h", "doc_id", "part", "n")
    )
    chosen = cut_lineage(chosen)
    chosen_heights = chosen.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    tall = cut_lineage(chosen.join(chosen_heights, "h"))
    listed = within_bounds(listed_pairs(shared.where(F.col("m") <= BUSY), percent), listed_pairs(tall.where(F.col("m") <= BUSY), percent), sized, percent)
    links = counted(listed, own, k, percent).unionByName(
        multiplied(tall.where(F.col("m") > BUSY).select("h", "doc_id", "part", "n"), sets.select("doc_id", "part", "grams"), percent)
    )
    # an id on several rows is one document: what its rows are copies of belongs together
    same = later.join(many, "doc_id").join(copies, "sid").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.unionByName(same))
    whole = sizes.join(copies, "sid", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return whole.join(groups, F.col("rep") == F.col("id"), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )
