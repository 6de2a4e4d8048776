"""Hard negatives by exact inner products over lists that the anchors of a cluster share (after MAXIMUS).

Anchors are clustered by direction. No member's angle to a row can be less than the row's angle to the centroid
less the widest angle of a member, so norm times cosine of that difference bounds the row's product with every member
(per unit of the member's norm). For each cluster the rows are sorted by this bound once, and every member
walks that list from the top, until the bound falls below what it still looks for: then no later row can matter.

Rows are dealt to cells (the nearest centroid) and parts of bounded size; a task holds one part and one block of
anchors. Anchors first walk one part of their own cell, which gives each a score to beat; then they visit only the
parts whose cell can reach it. Positives come first, as they say how far down negatives are wanted. Rows with equal
vectors and labels are one item with the smallest few ids, and equal anchors are searched once, so
one very frequent vector costs no more than another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import blocks
from contactloom.operators.ordered import lookup
from contactloom.session import cut_lineage

#: scores stay within these ends
LOW, HIGH = -(2**63 - 1), 2**63 - 1
#: doubles hold whole numbers below this exactly
EXACT = 2.0**53
#: rows that a member looks at between two looks at the bound
STEP = 2048
#: room for rounding in angles and bounds
SLACK = 1e-6


def scaled(vector: Column, factor: float) -> Column:
    """Whole numbers floor(factor * x) as doubles; doubles from 2^53 on are whole already."""
    y = lambda x: x.cast("double") * factor
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < EXACT, F.floor(y(x)).cast("double")).otherwise(y(x)))


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, factor: float) -> DataFrame:
    """(id, label, vector): distinct rows without nulls and with finite components, scaled to whole numbers."""
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    known = named.where("id is not null and label is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * factor) < float("inf")))
    return known.where(finite).select("id", "label", scaled(F.col("v"), factor).alias("vector")).distinct()


def norms_of(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; zero stays zero."""
    top = np.abs(x).max(axis=1, initial=0.0)
    small = x / np.where(top > 0, top, 1.0)[:, None]
    size = np.sqrt((small**2).sum(axis=1))
    return small / np.where(size > 0, size, 1.0)[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def products(rows: np.ndarray, vector: np.ndarray, reach: float) -> np.ndarray:
    """Inner products as whole numbers; ``reach`` bounds the size of each. Beyond a long's range they count as its ends."""
    if reach < EXACT:
        return (rows @ vector).astype(np.int64)
    mine = [int(x) for x in vector]
    sums = [sum(int(x) * y for x, y in zip(row, mine, strict=True)) for row in rows]
    return np.array([min(max(s, LOW), HIGH) for s in sums], dtype=np.int64)


def lowest(score: int, percent: int) -> int:
    """Least whole number n with 100 n >= percent * score."""
    return -((-percent * score) // 100)


def centroids_of(sample: np.ndarray, clusters: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids of directions (spherical k-means); the same sample gives the same ones."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(clusters, len(sample)), replace=False)]
    for _ in range(rounds):
        member = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, member, sample)
        centres = directions(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, centres))
    return centres


@dataclass
class Cells:
    """What is known of each cell of rows: widest angle to its centroid, largest norm, number of parts."""

    centres: np.ndarray
    widest: np.ndarray
    norm: np.ndarray
    parts: np.ndarray


def walk(items: pd.DataFrame, anchors: pd.DataFrame, centres: np.ndarray, keep: int, percent: int):
    """What each anchor finds among ``items`` (label, vector, ids).

    An anchor (gid, cluster, label, vector, floor, wanted) without ``wanted`` scores looks for rows of its label with
    a product of ``floor`` or more, and yields the first ``keep``: (gid, None, score, id, own). One with ``wanted`` looks, for
    each score s there, for rows of other labels between ``percent`` percent of s and s: (gid, s, score, id, False).
    """
    data, labels, ids = np.vstack(items["vector"].to_numpy()), items["label"].to_numpy(), items["ids"].to_numpy()
    norms, units = norms_of(data), directions(data)
    for cluster, members in anchors.groupby("cluster", sort=True):
        vectors = np.vstack(members["vector"].to_numpy())
        far, size = angles(directions(vectors), centres[cluster : cluster + 1])[:, 0], norms_of(vectors)
        apart = np.maximum(0.0, angles(units, centres[cluster : cluster + 1])[:, 0] - (far.max() + SLACK))
        with np.errstate(over="ignore", invalid="ignore"):
            bound = norms * np.cos(apart) * (1 + np.where(np.cos(apart) > 0, SLACK, -SLACK))
        order = np.argsort(-bound, kind="stable")
        bound, listed, label = bound[order], data[order], labels[order]
        top_norm = norms.max()
        for m, (gid, own_label, floor, wanted) in enumerate(zip(members["gid"], members["label"], members["floor"], members["wanted"], strict=True)):
            mine = None if wanted is None else sorted({int(w) for w in wanted}, reverse=True)
            least = int(floor) if mine is None else min(lowest(s, percent) for s in mine)
            at, kept_at, kept_score = 0, [], []
            while at < len(listed):
                if bound[at] * size[m] + SLACK < least:
                    break
                chunk = slice(at, at + STEP)
                score = products(listed[chunk], vectors[m], top_norm * size[m])
                hit = (score >= least) & ((label[chunk] == own_label) if mine is None else (label[chunk] != own_label) & (score <= mine[0]))
                if hit.any():
                    kept_at.append(np.flatnonzero(hit) + at)
                    kept_score.append(score[hit])
                    # each item stands for one id at least, so what the last of ``keep`` scores is reached for certain
                    found = np.concatenate(kept_score)
                    if mine is None:
                        if len(found) >= keep:
                            least = max(least, int(-np.partition(-found, keep - 1)[keep - 1]))
                    else:
                        ends = []
                        for s in mine:
                            under = found[found <= s]
                            ends.append(max(lowest(s, percent), int(-np.partition(-under, keep - 1)[keep - 1]) if len(under) >= keep else LOW))
                        least = max(least, min(ends))
                at += STEP
            if not kept_at:
                continue
            places, found = np.concatenate(kept_at), np.concatenate(kept_score)
            for s in [None] if mine is None else mine:
                fits = found >= least if s is None else (found <= s) & (found >= lowest(s, percent))
                if not fits.any():
                    continue
                # rows that score as the last of ``keep`` may still come first by id
                good = found[fits]
                if len(good) > keep:
                    fits &= found >= -np.partition(-good, keep - 1)[keep - 1]
                rows = [(-int(found[i]), int(x), place) for i, place in zip(np.flatnonzero(fits), places[fits], strict=True) for x in ids[order[place]]]
                for minus, x, place in sorted(rows)[:keep]:
                    yield gid, s, -minus, x, s is None and bool((listed[place] == vectors[m]).all())


FOUND = "gid long, wanted long, score long, id long, own boolean"


def visit(parts: DataFrame, callers: DataFrame, centres, keep: int, percent: int) -> DataFrame:
    """Callers (part, block, gid, ...) walk the lists of the part they call at."""
    shared = parts.sparkSession.sparkContext.broadcast(centres)

    def meet(items: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        rows = list(walk(items, anchors, shared.value, keep, percent)) if len(items) and len(anchors) else []
        out = pd.DataFrame(rows, columns=["gid", "wanted", "score", "id", "own"])
        return out.astype({"gid": "int64", "wanted": "Int64", "score": "int64", "id": "int64", "own": "bool"})

    # a part goes to the blocks of anchors that call at it
    called = callers.select("part", F.col("block").alias("of")).distinct()
    left = parts.join(called, "part").groupBy("part", "of")
    return left.cogroup(callers.groupBy("part", "block")).applyInPandas(meet, FOUND)


def mine(vectors: DataFrame, is_anchor, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", factor: float = 256.0, positives: int = 5, negatives: int = 5, percent: int = 80, clusters: int = 32, sample_rows: int = 4096, part_rows: int = 20_000, anchor_block: int = 4_000) -> DataFrame:
    """Hard negatives of the rows for which ``is_anchor`` (a condition on ``id``) holds.

    Components count as floor(``factor`` * x); a row's score is its inner product with the anchor. An anchor's
    positives are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels
    whose score lies between ``percent`` percent of the positive's and the positive's are returned: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score. Higher scores come first, ties by the smaller id.

    Rows with a null id, label or vector, with null or non-finite components (also after scaling), or of another length
    than the most frequent one (ties: the shortest) take no part. Rows equal in id, label and scaled vector are one row; an id
    with several vectors is several rows. A score beyond the range of a long counts as its end. Zero vectors score 0. A positive
    with a negative score has no negatives. Other columns are ignored; an empty table, or one without anchors, gives no rows.

    ``clusters`` centroids come from at most about ``sample_rows`` anchors; they steer the work, the result is exact.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut_lineage(usable(vectors, id_column, vector_column, label_column, factor))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    if not sizes or not sizes[0]["dim"]:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vector") == sizes[0]["dim"])
    anchors = rows.where(is_anchor)
    groups = cut_lineage(anchors.groupBy("vector", "label").agg(F.min("id").alias("least")).withColumn("gid", F.monotonically_increasing_id()))
    many = groups.count()
    if not many:
        return spark.createDataFrame([], result)
    drawn = groups.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) <= int(min(1.0, sample_rows / many) * (1 << 30))).orderBy("least", "vector", "label").select("vector").collect()
    sample = np.array([r[0] for r in drawn] or [r[0] for r in groups.orderBy("least").limit(1).select("vector").collect()])
    centres = centroids_of(directions(sample), clusters)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, angle double, norm double")
    def place(v: pd.Series) -> pd.DataFrame:
        x = np.vstack(v.to_numpy()) if len(v) else np.zeros((0, shared.value.shape[1]))
        apart = angles(directions(x), shared.value)
        cell = np.argmin(apart, axis=1).astype(np.int32)
        return pd.DataFrame({"cell": cell, "angle": apart[np.arange(len(x)), cell], "norm": norms_of(x)})

    # of equal rows only the first few ids can be anyone's; the limit drops the others before the shuffle
    keep = max(positives + 1, negatives)
    first = F.row_number().over(Window.partitionBy("vector", "label").orderBy("id"))
    items = rows.withColumn("_n", first).where(F.col("_n") <= keep).groupBy("vector", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    placed = cut_lineage(items.withColumn("at", place("vector")).select("vector", "label", "ids", "at.*"))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect()}
    k = len(centres)
    cells = Cells(
        centres,
        np.array([stats[c]["angle"] if c in stats else 0.0 for c in range(k)]),
        np.array([stats[c]["norm"] if c in stats else 0.0 for c in range(k)]),
        np.array([blocks(stats[c]["n"], part_rows) if c in stats else 0 for c in range(k)]),
    )
    offsets = np.concatenate([[0], np.cumsum(cells.parts)])
    starts, counts = (F.array(*[F.lit(int(x)) for x in values]) for values in (offsets[:-1], cells.parts))
    salt = F.pmod(F.xxhash64("vector", "label"), F.get(counts, F.col("cell"))).cast("int")
    parts = placed.select((F.get(starts, F.col("cell")) + salt).alias("part"), "label", "vector", "ids")
    members = groups.withColumn("at", place("vector")).select("gid", "vector", "label", F.col("at.cell").alias("cluster"))
    # members of a cluster stay together where a block has room for them
    of_cluster = {r["cluster"]: r["count"] for r in members.groupBy("cluster").count().collect()}
    at, used, first_block, splits = 0, 0, {}, {}
    for c in range(k):
        n = of_cluster.get(c, 0)
        splits[c] = blocks(n, anchor_block)
        if used + min(n, anchor_block) > anchor_block or splits[c] > 1:
            at, used = at + 1, 0
        first_block[c] = at
        used += n
        if splits[c] > 1:
            at, used = at + splits[c], 0
    listed = lambda d: F.array(*[F.lit(int(d[c])) for c in range(k)])
    block = F.get(listed(first_block), F.col("cluster")) + F.pmod(F.xxhash64("gid"), F.get(listed(splits), F.col("cluster"))).cast("int")
    members = cut_lineage(members.withColumn("block", block))

    @F.pandas_udf("array<int>")
    def reached(v: pd.Series, least: pd.Series) -> pd.Series:
        """Parts of the cells that can hold a product of ``least`` or more."""
        x = np.vstack(v.to_numpy()) if len(v) else np.zeros((0, cells.centres.shape[1]))
        apart = np.maximum(0.0, angles(directions(x), cells.centres) - cells.widest - SLACK)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = norms_of(x)[:, None] * cells.norm * np.maximum(0.0, np.cos(apart)) * (1 + SLACK) + SLACK
            open_cells = (cells.parts > 0) & ~(bound < least.to_numpy(dtype=float)[:, None])
        return pd.Series([[p for c in np.flatnonzero(row) for p in range(offsets[c], offsets[c + 1])] for row in open_cells])

    base = ["gid", "block", "cluster", "label", "vector"]
    nothing = F.lit(None).cast("array<long>").alias("wanted")
    # one part of the own cell: the score of the last that is found there is a floor for the search of all parts
    own_part = F.get(starts, F.col("cluster")) + F.pmod(F.xxhash64("vector", "label"), F.greatest(F.get(counts, F.col("cluster")), F.lit(1))).cast("int")
    near = members.select(*base, F.lit(LOW).alias("floor"), nothing, own_part.alias("part"))
    seen = visit(parts, near, centres, positives + 1, percent).groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    floors = cut_lineage(members.join(seen, "gid", "left").withColumn("floor", F.when(F.col("n") > positives, F.col("score")).otherwise(F.lit(LOW))).select(*base, "floor"))
    calling = floors.withColumn("part", F.explode(reached("vector", "floor"))).select(*base, "floor", nothing, "part")
    best = Window.partitionBy("gid").orderBy(F.desc("score"), "id", F.desc("own"))
    tops = visit(parts, calling, centres, positives + 1, percent).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives + 1)
    tops = cut_lineage(tops.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id", "own"))).alias("tops")))
    scores = F.array_distinct(F.transform(F.filter("tops", lambda t: t["score"] >= 0), lambda t: t["score"]))
    asked = members.join(tops, "gid").withColumn("wanted", scores).where(F.size("wanted") > 0)
    asked = asked.select(*base, F.lit(0).cast("long").alias("floor"), "wanted", F.floor(F.array_min("wanted") * F.lit(percent / 100)).alias("least"))
    calling = asked.withColumn("part", F.explode(reached("vector", "least"))).select(*base, "floor", "wanted", "part")
    nearest = Window.partitionBy("gid", "wanted").orderBy(F.desc("score"), "id")
    hard = visit(parts, calling, centres, negatives, percent).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= negatives)
    hard = hard.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("wanted", "n", "id", "score"))).alias("hard"))
    # back to the anchors: one row of bounded size for each distinct one
    told = groups.select("gid", "vector", "label").join(tops, "gid").join(hard, "gid")
    every = lookup(anchors, told.select("vector", "label", "tops", "hard"), ["vector", "label"], ["tops", "hard"])
    others = F.slice(F.filter("tops", lambda t: ~(t["own"] & (t["id"] == F.col("id")))), 1, positives)
    positive = every.where("hard is not null").select("id", "hard", F.explode(others).alias("p"))
    chosen = positive.select("id", "p", F.explode(F.filter("hard", lambda x: x["wanted"] == F.col("p.score"))).alias("x"))
    return chosen.select(F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("x.n").alias("rank"), F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))
