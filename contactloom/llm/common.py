"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from itertools import accumulate

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: let tasks hand them to Python in Arrow batches of at most ``rows`` rows.

    Sets the session's limit if it is wider; a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def batches_by_size(frames, column: str, most: int):
    """Cut pandas frames into slices of at least one row and about ``most`` characters of ``column``."""
    for frame in frames:
        start, size = 0, 0
        for i, value in enumerate(frame[column]):
            size += len(value) if isinstance(value, (str, bytes)) else 0
            if size >= most:
                yield frame.iloc[start : i + 1]
                start, size = i + 1, 0
        if start < len(frame):
            yield frame.iloc[start:]


def arrow_slices(batch, column: int, most: int):
    """Cut a record batch into slices of at least one row and about ``most`` bytes of a string column."""
    offsets = [0, *accumulate(0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist())]
    start = 0
    for i in range(1, batch.num_rows + 1):
        if offsets[i] - offsets[start] >= most or i == batch.num_rows:
            yield batch.slice(start, i - start)
            start = i


def blocks(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
