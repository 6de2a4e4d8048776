"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

1. Texts are written once to files of the shared folder (``parts``); from then on only short rows are
   shuffled, and tasks read the texts of their part. Equal texts are one text.
2. Every start of a ``length``-byte string has an *anchor*, the smallest hash of a ``GRAM``-byte gram inside the
   string (rightmost of equal ones). Equal strings have equal anchors at equal places, so strings whose
   anchor occurs once in the corpus are not repeated. Successive starts with one anchor form a *segment*.
3. Equal segments (anchor and all bytes) are merged: all but the first are repeated. Anchors
   with several different segments go on, in buckets of bounded size.
4. In a bucket the segments are dealt to shards. Each shard sorts its own suffixes and derives its
   Burrows-Wheeler transform, over symbols of several bytes. The shards' transforms are merged by refining
   their interleave: a round orders all rows by one more symbol, using only the transforms and the order
   of the round before (one stable counting sort, no suffix is compared again). Where neighbouring
   rows part in a round, their common prefix ends there. A row that has parted from both neighbours is
   dropped, as nothing that ends in it can be repeated. The intervals left after ``length`` bytes are the
   repeated strings; all but the first of an interval are repeated starts.
5. Repeated starts go back to their part, where the removed runs and the rest of the text are made.

An anchor with more than ``WIDE`` different segments isn't put into one bucket: its strings are met by their
hash, each on its own.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import blocks, partitions, short_batches
from contactloom.llm.jaccard import _BASE, mixed, powers
from contactloom.llm.warc import opened
from contactloom.session import cut_lineage, scratch_path

GRAM = 24
PART_BYTES = 24_000_000
BUCKET_BYTES = 1_000_000
SHARD_BYTES = 300_000
WIDE = 3_000
#: texts are hashed in pieces of so many bytes, each with the length of a string more
PIECE = 1 << 16
#: short texts are hashed together, about so many bytes at a time
TOGETHER = 1 << 18

_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


# ---- texts in files


def write_parts(docs: DataFrame, folder: str) -> DataFrame:
    """Write texts to files below ``folder``: rows (doc_id, part, idx, n_bytes, sha) say where each lies."""

    def run(frames):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        # in order of the partitions; an attempt's own number keeps its files apart from those of a repeated one
        number, held, size = (TaskContext.get().partitionId() << 40) + (uuid.uuid4().int % (1 << 20) << 20), [], 0

        def flush():
            nonlocal number, held, size
            out = io.BytesIO()
            pq.write_table(pa.table({"text": pa.array([h[1] for h in held], pa.binary())}), out, compression="zstd", use_dictionary=False)
            with system.open_output_stream(f"{root}/{number}", compression=None) as f:
                f.write(out.getvalue())
            frame = pd.DataFrame(
                {
                    "doc_id": pd.array([h[0] for h in held], dtype="Int64"),
                    "part": number,
                    "idx": range(len(held)),
                    "n_bytes": [len(h[1]) for h in held],
                    "sha": [hashlib.sha256(h[1]).hexdigest() for h in held],
                }
            )
            number, held, size = number + 1, [], 0
            return frame

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = text.encode("utf-8") if isinstance(text, str) else b""
                held.append((None if doc is None or doc != doc else int(doc), data))
                size += len(data)
                if size >= PART_BYTES:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInPandas(run, "doc_id long, part long, idx int, n_bytes long, sha string")


class Parts:
    """Reads texts of parts, the last part read is kept."""

    def __init__(self, folder: str):
        self.system, self.root = opened(folder)
        self.part, self.texts = None, None

    def text(self, part: int, idx: int) -> np.ndarray:
        if part != self.part:
            with self.system.open_input_file(f"{self.root}/{part}") as f:
                self.texts = pq.read_table(f)["text"].combine_chunks()
            self.part = part
        return np.frombuffer(self.texts[idx].as_buffer(), dtype=np.uint8)


# ---- anchors and segments


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte grams, by doubling the width."""
    h, base, size, by_size = _BYTE[data], _BASE, 1, {}
    while size <= GRAM:
        by_size[size] = (h, base)
        if len(h) <= size:
            break
        h, base, size = h[:-size] * base + h[size:], base * base, 2 * size
    n, out, at = len(data) - GRAM + 1, np.zeros(len(data) - GRAM + 1, dtype=np.uint64), 0
    for size in sorted(by_size, reverse=True):
        if GRAM - at >= size:
            part, base = by_size[size]
            out = out * base + part[at : at + n]
            at += size
    return mixed(out)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, size = v, 1
    while 2 * size <= width:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    n = len(v) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; a process computes them once."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [powers(_BASE, 2 * n), powers(_BACK, 2 * n)]
    return _POWERS[0], _POWERS[1]


def segments(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, hash of all bytes, first start, number of starts) of the segments of some texts.

    The texts are hashed as one array, in pieces; strings that would cross from one text to the next are left out.
    """
    out = []
    low = np.uint64(0xFFFFFFFF)
    ends = np.cumsum([len(t) for t in texts])
    data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    # a start is no start of a string if a text ends less than ``length`` bytes behind it
    crossing = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(crossing, np.maximum(ends - length + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    valid = np.cumsum(crossing[:-1]) == 0
    with np.errstate(over="ignore"):
        for at in range(0, max(0, len(data) - length + 1), PIECE):
            piece = data[at : at + PIECE + length - 1]
            starts = np.flatnonzero(valid[at : at + len(piece) - length + 1])
            if not len(starts):
                continue
            grams = gram_hashes(piece)
            ranked = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
            best = (low - (sliding_min(ranked, length - GRAM + 1) & low))[starts]
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            first, count = starts[new], np.diff(np.append(new, len(starts)))
            up, down = kept_powers(len(piece))
            # the mixed hashes of all its grams tell a segment's bytes, and no pattern of bytes makes them cancel
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up[: len(grams)], dtype=np.uint64)])
            until = first + count + length - GRAM
            body = mixed((sums[until] - sums[first]) * down[first] + count.astype(np.uint64))
            of = np.searchsorted(ends, first + at, side="right")
            begins = np.where(of > 0, ends[of - 1], 0)
            out.append((of, grams[best[new].astype(np.int64)].view(np.int64), body.view(np.int64), first + at - begins, count))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def found_segments(texts: DataFrame, folder: str, length: int) -> DataFrame:
    """(anchor, body, doc_id, part, idx, start, count) of all segments of ``texts`` (part, idx, doc_id)."""
    names = ["anchor", "body", "doc_id", "part", "idx", "start", "count"]

    def run(batches):
        parts = Parts(folder)
        for batch in batches:
            columns = [np.array(batch.column(c).to_pylist()) for c in ("doc_id", "part", "idx")]
            held, first, size = [], 0, 0
            for i in range(batch.num_rows):
                held.append(parts.text(int(columns[1][i]), int(columns[2][i])))
                size += len(held[-1])
                if size >= TOGETHER or i == batch.num_rows - 1:
                    of, anchor, body, start, count = segments(held, length)
                    doc, part, idx = (c[first + of] for c in columns)
                    out = (anchor, body, doc, part, idx.astype(np.int32), start, count.astype(np.int32))
                    for at in range(0, len(anchor), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in out], names)
                    held, first, size = [], i + 1, 0

    return by_part(texts).mapInArrow(run, "anchor long, body long, doc_id long, part long, idx int, start long, count int")


def by_part(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a part together and in order; ``part`` names texts of bounded total size."""
    return rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "idx", *order)


# ---- suffixes of a shard, and the merge


class Shard:
    """Suffixes of some segments in order, their transform and its inverse steps.

    ``starts`` and ``ends`` delimit the segments in ``text``; a suffix reaches to the end of its segment, and the
    empty one there is a suffix too. One byte between segments gives it a place of its own.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray, width: int, first_row: int):
        spans = ends + 1 - starts
        # the segments lie one after the other, each with the place of its empty suffix
        where = np.arange(starts[0], ends[-1] + 1, dtype=np.int32)
        left = np.repeat(ends.astype(np.int32), spans) - where
        behind = where - np.repeat(starts.astype(np.int32), spans)
        order = self.sorted_suffixes(text[starts[0] : ends[-1] + 1], left)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.order = where[order]
        has = behind[order] >= width
        back = np.where(has, order - width, order)
        #: the symbol before each row's suffix, and the row of the suffix that starts with it (-1: none)
        self.transform = symbols[starts[0] : ends[-1] + 1][back]
        self.before = np.where(has, rank[back] + np.int32(first_row), np.int32(-1))

    @staticmethod
    def sorted_suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Prefix doubling: only suffixes that still tie are sorted again. Full ties keep their order.

        ``left`` is how many bytes each suffix has.
        """
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
        words = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        # seven bytes, those past the end cleared, and then how many there are
        short = np.minimum(left, 7).astype(np.uint64)
        key = (words & ~(~np.uint64(0) >> (short * np.uint64(8)))) | short
        order = np.argsort(key, kind="stable").astype(np.int32)
        ordered = key[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.int32)
        heads = np.flatnonzero(fresh).astype(np.int32)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        tied, depth, most = np.flatnonzero(~(fresh & np.append(fresh[1:], True))), 7, int(left.max())
        while len(tied) and depth <= most:
            rows = order[tied]
            follows = np.where(left[rows] > depth, rank[np.minimum(rows + depth, n - 1)] + 1, 0)
            pair = rank[rows].astype(np.int64) * (n + 1) + follows
            turn = np.argsort(pair, kind="stable")
            rows, pair = rows[turn], pair[turn]
            order[tied] = rows
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            # a group keeps the number of its first place
            rank[rows] = np.repeat(tied[new], np.diff(np.append(np.flatnonzero(new), len(new)))).astype(np.int32)
            tied = tied[~(new & np.append(new[1:], True))]
            depth *= 2
        return order


def stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable counting sort of numbers below 2**32 in passes of 16 bits."""
    if codes.dtype == np.uint16:
        return np.argsort(codes, kind="stable")
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if codes.size and int(codes.max()) >> 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merged_intervals(shards: list[Shard], length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, interval) of all suffixes that share ``length`` bytes with another one, by interval."""
    transform = np.concatenate([s.transform for s in shards])
    before = np.concatenate([s.before for s in shards])
    place = np.concatenate([s.order for s in shards])
    # the interleave: rows of all shards in merged order, to begin with one shard after the other
    rows, interval = np.arange(len(place), dtype=np.int32), np.zeros(len(place), dtype=np.int32)
    for _ in range(length // width):
        has = before[rows] >= 0
        rows, interval = rows[has], interval[has]
        symbol = transform[rows]
        turn = stable_order(symbol)
        symbol, interval, rows = symbol[turn], interval[turn], before[rows[turn]]
        # neighbours part where the new symbol differs or they had parted before
        parts = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]), [True]])[: len(rows) + 1]
        together = ~(parts[:-1] & parts[1:])
        interval = np.cumsum(parts[:-1], dtype=np.int32)[together]
        rows = rows[together]
        if not len(rows):
            break
    return place[rows], interval


def repeated_starts(texts: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment number, offset) of every start in ``texts`` whose string also starts earlier in another or the same text.

    ``doc`` orders documents, ``row`` numbers them, ``start`` is where a segment begins in its document.
    """
    width = 4 if length % 4 == 0 else 2 if length % 2 == 0 else 1
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = begins + sizes  # where a segment's empty suffix is
    packed = np.zeros(len(text), dtype=np.uint32)
    for i in range(width):
        packed[: len(text) - i] = (packed[: len(text) - i] << np.uint32(8)) | text[i:]
    names, symbols = np.unique(packed, return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
    shards, first, row_at = [], 0, 0
    for i in range(len(texts)):
        if ends[i] - begins[first] >= SHARD_BYTES or i == len(texts) - 1:
            shards.append(Shard(text, begins[first : i + 1], ends[first : i + 1], symbols, width, row_at))
            row_at, first = row_at + len(shards[-1].order), i + 1
    place, interval = merged_intervals(shards, length, width)
    segment = np.searchsorted(ends, place, side="right")
    offset = place - begins[segment]
    order = np.lexsort((start[segment] + offset, row[segment], doc[segment], interval))
    segment, offset, interval = segment[order], offset[order], interval[order]
    head = np.concatenate([[True], interval[1:] != interval[:-1]])[: len(interval)]
    return segment[~head], offset[~head]


# ---- the operator


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept), a row for every row of ``docs``.

    A text is its UTF-8 bytes (null: none). A byte goes if a string of ``length`` bytes of the same text
    that covers it also starts earlier: in a document with a smaller id, or in the same one further to the front.
    ``removed`` lists the maximal runs (start, end), ``kept`` holds the rest of a text that lost some but
    not all bytes (else null: nothing or everything is left). Rows with a null id come after all others, rows
    with equal ids in the order of the input's partitions; rows that are equal in id and text get equal results. Other
    columns are ignored; an empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    short_batches(spark)
    folder = scratch_path(spark, "texts")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = cut_lineage(write_parts(own, folder))
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id")
    firsts = cut_lineage(
        placed.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min(F.struct(order, "part", "idx")).alias("first"), F.min("n_bytes").alias("n_bytes")).select("sha", "first.*")
    )
    # written, as it is read twice: for the counts, and for the join, which can split the rows of a busy anchor
    found = cut_lineage(found_segments(firsts, folder, length))
    counts = cut_lineage(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    again = cut_lineage(found.join(counts.hint("shuffle_hash"), "anchor"))
    # equal segments: all but the first are repeated as a whole
    first = F.min(F.struct("doc_id", "part", "idx", "start", "count")).alias("first")
    merged = cut_lineage(again.groupBy("anchor", "body").agg(first, F.count("*").alias("n")))
    several = merged.where("n > 1").select("anchor", "body", "first")
    copies = again.join(several, ["anchor", "body"]).where(F.struct("doc_id", "part", "idx", "start", "count") > F.col("first")).select("part", "idx", "start", "count")
    widths = merged.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("first.count").alias("starts")).where("kinds > 1")
    kinds = cut_lineage(merged.join(widths, "anchor").select("anchor", "kinds", "first.*"))
    size = kinds.where(F.col("kinds") <= WIDE).agg(F.sum(F.col("count") + length)).first()[0] or 0
    total = blocks(size, BUCKET_BYTES)
    within = interval_starts(kinds.where(F.col("kinds") <= WIDE).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(total)).cast("int")), folder, length)
    wide = wide_starts(kinds.where(F.col("kinds") > WIDE), folder, length)
    runs = copies.unionByName(within).unionByName(wide)
    cut = removed_runs(runs, folder, length)
    rows = placed.join(firsts.select(F.col("sha"), F.col("doc_id").alias("first_id"), F.col("part").alias("at_part"), F.col("idx").alias("at_idx")), "sha", "left")
    rows = rows.withColumn("own", F.col("first_id").isNull() | (F.col("first_id") == F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    both = rows.join(cut.withColumnRenamed("part", "at_part").withColumnRenamed("idx", "at_idx"), ["at_part", "at_idx"], "left")
    spans = F.when(~F.col("own"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(
        F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    )
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(~F.col("own"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(~F.col("own"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        spans.alias("removed"),
        F.when(F.col("own"), F.col("kept")).alias("kept"),
    )


def interval_starts(kinds: DataFrame, folder: str, length: int) -> DataFrame:
    """(part, idx, start, count): runs of repeated starts, from the merged transforms of each bucket."""

    def cut_out(batches):
        parts = Parts(folder)
        for frame in batches:
            yield frame.assign(bytes=[parts.text(p, i)[s : s + c + length - 1].tobytes() for p, i, s, c in zip(frame["part"], frame["idx"], frame["start"], frame["count"], strict=True)])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        # a fixed order of the shards, with the kinds of one anchor in different ones where there are several
        frame = frame.sort_values(["doc_id", "part", "idx", "start"], kind="stable").reset_index(drop=True)
        row = frame.groupby(["part", "idx"], sort=True).ngroup().to_numpy()
        segment, offset = repeated_starts(list(frame["bytes"]), frame["doc_id"].to_numpy(), row, frame["start"].to_numpy(), length)
        return start_runs(frame["part"].to_numpy()[segment], frame["idx"].to_numpy()[segment], frame["start"].to_numpy()[segment] + offset)

    cut = by_part(kinds.select("bucket", "doc_id", "part", "idx", "start", "count"), "start").mapInPandas(
        cut_out, "bucket int, doc_id long, part long, idx int, start long, count int, bytes binary"
    )
    return cut.groupBy("bucket").applyInPandas(merge, "part long, idx int, start long, count int")


def start_runs(part: np.ndarray, idx: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Single starts as runs of successive ones."""
    order = np.lexsort((start, idx, part))
    part, idx, start = part[order], idx[order], start[order]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (idx[1:] != idx[:-1]) | (start[1:] != start[:-1] + 1)])[: len(part)]
    first = np.flatnonzero(new)
    return pd.DataFrame({"part": part[first], "idx": idx[first].astype(np.int32), "start": start[first], "count": np.diff(np.append(first, len(part))).astype(np.int32)})


def wide_starts(kinds: DataFrame, folder: str, length: int) -> DataFrame:
    """The same for anchors with very many kinds: every string on its own, met by a hash of its bytes."""

    def strings(frames):
        parts = Parts(folder)
        for frame in frames:
            rows = []
            for doc, p, i, s, c in zip(*(frame[x] for x in ("doc_id", "part", "idx", "start", "count")), strict=True):
                data = parts.text(p, i)
                rows += [(hashlib.blake2b(data[a : a + length].tobytes(), digest_size=16).digest(), doc, p, i, a) for a in range(s, s + c)]
            yield pd.DataFrame(rows, columns=["string", "doc_id", "part", "idx", "start"])

    each = by_part(kinds.select("doc_id", "part", "idx", "start", "count"), "start").mapInPandas(strings, "string binary, doc_id long, part long, idx int, start long")
    place = F.struct("doc_id", "part", "idx", "start")
    least = each.groupBy("string").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(least, "string").where(place > F.col("least")).select("part", "idx", "start", F.lit(1).alias("count"))


def removed_runs(starts: DataFrame, folder: str, length: int) -> DataFrame:
    """(part, idx, n_removed, runs, kept_sha256, kept) of every text with repeated starts."""

    def run(frames):
        parts, held, rows = Parts(folder), None, []

        def finished(part, idx, runs):
            data = parts.text(part, idx)
            keep = np.ones(len(data), dtype=bool)
            for a, b in runs:
                keep[a:b] = False
            kept = data[keep].tobytes()
            gone = len(data) - len(kept)
            return (part, idx, gone, [{"start": a, "end": b} for a, b in runs], hashlib.sha256(kept).hexdigest(), kept)

        def out():
            return pd.DataFrame(rows, columns=["part", "idx", "n_removed", "runs", "kept_sha256", "kept"])

        for frame in frames:
            for part, idx, start, count in zip(frame["part"].tolist(), frame["idx"].tolist(), frame["start"].tolist(), frame["count"].tolist(), strict=True):
                end = start + count + length - 1
                if held and held[:2] == (part, idx) and start <= held[2][-1][1]:
                    held[2][-1][1] = max(held[2][-1][1], end)
                elif held and held[:2] == (part, idx):
                    held[2].append([start, end])
                else:
                    if held:
                        rows.append(finished(*held))
                    held = (part, idx, [[start, end]])
            yield out()
            rows = []
        if held:
            rows.append(finished(*held))
        yield out()

    return by_part(starts.select("part", "idx", "start", "count"), "start").mapInPandas(
        run, "part long, idx int, n_removed long, runs array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    )
