"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned from a bounded sample (iterative
quantisation). A code is split into 16-bit substrings, and every block of the index keeps, for each
substring, its rows ordered by the substring's value. Two codes within Hamming radius r agree in one of m
substrings up to floor(r / m) bits, so probing all values within that distance finds every code within the
radius; those rows are reranked by the exact cosine in double precision. The radius is learned from the
sample (the distance that ``recall`` of its true neighbours stay within) and grows for a query that finds
fewer than ``k`` rows in a block, until the block is exhausted.

Blocks of the index and of the queries have bounded sizes; every block of queries meets every block of the
index, in tasks of their own. No bucket is cut short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import blocks

BITS = 16


@dataclass
class Coder:
    """``rotations`` (dim, bits), ``radius``: the learned Hamming radius."""

    rotations: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """16-bit substrings (rows, m) of unit vectors."""
        signs = np.packbits(x @ self.rotations > 0, axis=1)
        return signs.view("<u2")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two, so that the largest component is about 1: cosines stay the same, sums in range."""
    top = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    # in two steps, as the power itself may be out of range
    return np.ldexp(np.ldexp(vectors, -(top // 2)[:, None]), -(top - top // 2)[:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, summed in one order for every row."""
    return np.sqrt((vectors * vectors).sum(axis=1))


def unit(vectors: np.ndarray) -> np.ndarray:
    near = scaled(vectors)
    return near / norms(near)[:, None]


def learn(sample: np.ndarray, bits: int = 128, k: int = 5, recall: float = 0.97, rounds: int = 20, seed: int = 5) -> Coder:
    """Learn rotations and a radius from unit vectors; the same sample gives the same coder."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    width, parts = min(dim, bits), []
    while sum(p.shape[1] for p in parts) < bits:
        # principal directions first, then rotated so that signs lose little
        _, directions = np.linalg.eigh(sample.T @ sample)
        base = directions[:, ::-1][:, :width]
        low = sample @ base
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ v).T
        parts.append(base @ turn)
    coder = Coder(np.hstack(parts)[:, : bits - bits % BITS], 0)
    codes, hits = coder.codes(sample), []
    for i in range(0, len(sample), max(1, len(sample) // 500)):
        near = sample @ sample[i]
        near[i] = -2
        best = np.argsort(-near, kind="stable")[: min(k, len(sample) - 1)]
        hits.append(distance(codes[best], codes[i]))
    found = np.concatenate(hits) if hits else np.zeros(0)
    coder.radius = int(np.ceil(np.quantile(found, recall))) if len(found) else bits
    return coder


class Block:
    """An index block: rows by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.values, self.starts, self.ends = [], [], []
        for j, order in enumerate(self.order):
            values, starts = np.unique(codes[order, j], return_index=True)
            self.values.append(values)
            self.starts.append(starts)
            self.ends.append(np.append(starts[1:], len(order)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all rows within ``radius``, ascending."""
        m, seen = self.codes.shape[1], np.zeros(len(self.codes), dtype=bool)
        for j in range(m):
            probe = np.flatnonzero(np.bitwise_count(self.values[j] ^ code[j]) <= radius // m)
            if len(probe) == len(self.values[j]):
                seen[:] = True
                break
            sizes = self.ends[j][probe] - self.starts[j][probe]
            at = np.repeat(self.starts[j][probe] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            seen[self.order[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[distance(self.codes[rows], code) <= radius]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of rows whose vector is not null or zero and has only finite components; doubles."""
    v = F.col(vector_column).cast("array<double>")
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return clean.where(good)


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, bits: int = 128, sample_rows: int = 4000, index_block: int = 50_000, query_block: int = 5_000) -> DataFrame:
    """The ``k`` rows found nearest to each row for which ``is_query`` (a condition on ``id``) holds.

    Returns query_id, rank (from 1), vec_id, score: cosine in double precision, ties to the smaller vec_id;
    fewer than ``k`` rows only where there are no more candidates. Every row but the query's own id is a
    candidate. Vectors that are null, zero, hold null or non-finite components, or differ in length
    from the most frequent one take no part, nor do rows with a null id; of rows with equal id and vector
    one counts. Other columns are ignored; an empty table gives no rows. Rotations and radius come from at most about
    ``sample_rows`` rows; all rows are indexed.
    """
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_column, vector_column).distinct()
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("vector") == dim)
    share = min(1.0, sample_rows / n)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("id").select("vector").collect()
    sample = np.array([r[0] for r in drawn] or [r[0] for r in rows.limit(1).select("vector").collect()])
    coder = vectors.sparkSession.sparkContext.broadcast(learn(unit(sample), bits, k))
    queries = rows.where(is_query)
    parts, groups = blocks(n, index_block), blocks(queries.count(), query_block)
    part, group = F.pmod(F.xxhash64("id"), F.lit(parts)), F.pmod(F.xxhash64("id"), F.lit(groups))
    # every block of queries meets every block of rows once
    left = rows.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), group.alias("group"), "id", "vector")
    left, right = (x.select(F.col("part").cast("int").alias("part"), F.col("group").cast("int").alias("group"), "id", "vector") for x in (left, right))

    def meet(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        c = coder.value
        ids, data = index["id"].to_numpy(), scaled(np.vstack(index["vector"].to_numpy()))
        lengths = norms(data)
        block = Block(c.codes(unit(data)))
        original = scaled(np.vstack(asked["vector"].to_numpy()))
        out = []
        for query, vector, code in zip(asked["id"], original, c.codes(unit(original)), strict=True):
            radius, want = c.radius, min(k, int((ids != query).sum()))
            while True:
                found = block.within(code, radius)
                found = found[ids[found] != query]
                if len(found) >= want:
                    break
                radius = min(bits, radius + 8)
            # each row is summed in the same order, so equal vectors get equal scores
            score = (data[found] * vector).sum(axis=1) / (lengths[found] * norms(vector[None])[0])
            best = np.lexsort((ids[found], -score))[:k]
            out += [(query, ids[found[i]], score[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInPandas(meet, schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
