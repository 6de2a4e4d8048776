"""Session helpers: local sessions for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contactloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is made
    and recorded in the session, so every later call sees the same one; on a
    cluster each machine would see its own, so there that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("contactloom.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="contactloom-")
        spark.conf.set("contactloom.scratch", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; never reused, so nothing is overwritten."""
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


#: paths made in each open scope, the innermost last
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes at its end what was written to the scratch root inside.

    A caller that stores its result opens one around the work; a DataFrame that is still to be
    computed must not leave it, as it may read from the removed tables.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df):
    """``df`` written once to the shared scratch folder and read back.

    What follows starts from files: nothing is computed twice, a lost executor
    only costs re-reading, and the planner knows the true size of the table.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_table(df):
    """``df`` written as by ``cut_lineage`` and removed at the end of the block.

    For a wide table: by then, all that is derived from it must be written in turn.
    """
    path = scratch_path(df.sparkSession, "table")
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _remove(df.sparkSession, path)


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """The session's shuffle partitions, or as many as it takes for ``each`` of ``amount`` in a task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def planned_bytes(df) -> int:
    """The planner's size estimate; for a table just written it is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_bytes(df) -> int:
    """What a table just written takes in memory, as far as its number of rows (read from the files' footers) and columns tell.

    Files of few or sorted values are many times smaller than the rows that a broadcast holds.
    """
    return df.count() * (64 + df._jdf.schema().defaultSize())
