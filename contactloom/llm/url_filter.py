"""URL filters: host and path prefixes as nested intervals of one sorted key.

A rule names a host (it also fits all subdomains) and a path prefix. Reversing the labels of the host
(``blog.example.org`` -> ``org.example.blog``) and appending the path gives a key in which a rule is a
prefix, so it covers the interval of keys that start with it; two such intervals are nested or disjoint.
A page takes part with one key for every ancestor of its host that is as deep as some rule.

Keys and interval starts are sorted together. At any key the *last interval opened* carries the stack of
the rules that enclose it; those of the stack that have not closed yet are the rules that fit. The sweep
runs in ranges of the key; a range starts with the last interval opened before it, so no task needs
another's rows. Only distinct (host, path) pairs are swept: a host with a third of all pages, or a url
that repeats, costs one row per different path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import partitions
from contactloom.operators.ordered import lookup
from contactloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with the rules that enclose it, itself included, shortest first.

    ``rules`` has host, path and verdict. Rows with a null in one of them fit nothing and are left out; of
    several rules with the same host and path a ``block`` one counts.
    """
    clean = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    # every prefix of a rule's path, met with the rules of its host that end there
    prefixes = clean.select(
        "host", F.col("path").alias("full"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")
    ).select("host", "full", F.substring("full", F.lit(1), F.col("n")).alias("path"))
    stacks = (
        prefixes.join(clean, ["host", "path"])
        .groupBy("host", "full")
        .agg(F.sort_array(F.collect_list(F.struct("path", F.concat("host", "path").alias("rule"), "verdict", "host"))).alias("stack"))
    )
    return stacks.select(sort_key(F.col("host"), F.col("full")).alias("key"), "stack")


def sort_key(host: Column, path: Column) -> Column:
    return F.concat(reversed_host(host), F.lit("\u0000"), path)


def swept(keys: DataFrame, stacks: DataFrame, ranges: int) -> DataFrame:
    """``keys`` (with a column ``key``) plus ``stack``: the one of the last interval opened at or before the key."""
    events = keys.withColumn("opens", F.lit(1)).unionByName(stacks.withColumn("opens", F.lit(0)), allowMissingColumns=True)
    # ranges are numbered once and written, so that both uses below see the same ones
    ranged = cut_lineage(
        events.repartitionByRange(ranges, "key", "opens").withColumn("range", F.spark_partition_id())
    )
    carried = (
        ranged.where("opens = 0")
        .groupBy("range")
        .agg(F.max_by("stack", "key").alias("carried"))
        .join(ranged.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range")), "range", "right")
        .withColumn("carried", F.last("carried", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    )
    sweep = Window.partitionBy("range").orderBy("key", "opens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("opens = 1")
        .join(carried, "range")
        .withColumn("stack", F.coalesce("open", "carried"))
        .drop("open", "carried", "opens", "range")
    )


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    The longest rule (characters of host and path) wins, at equal length the one with the longer host;
    where none fits, ``default`` is the verdict. Every input row gives one output row. A null url, or one
    without ``://``, has an empty host and path and fits no rule. Columns of ``pages`` named like the new
    ones are replaced. Empty tables give no rows, respectively the default verdict.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    stacks = cut_lineage(rule_stacks(rules))
    # only ancestors as deep as some rule's host can match
    depth = stacks.agg(F.max(F.size(F.split(F.element_at("stack", 1)["host"], r"\.", -1)))).first()[0] or 0
    distinct = parsed.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.", -1)
    ancestors = distinct.select(
        "host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth))))).alias("n"), labels.alias("labels")
    ).select("host", "path", F.array_join(F.slice("labels", -F.col("n"), F.col("n")), ".").alias("ancestor"))
    # very many hosts share an ancestor and a path: each such key is swept once
    keys = ancestors.select("ancestor", "path").distinct().withColumn("key", sort_key(F.col("ancestor"), F.col("path")))
    fits = swept(keys, stacks, partitions(spark)).withColumn(
        "fit",
        F.try_element_at(
            F.filter("stack", lambda r: (r["host"] == F.col("ancestor")) & F.col("path").startswith(r["path"])), F.lit(-1)
        ),
    )
    # back to the hosts; keys with very many of them don't go through the shuffle
    fitting = lookup(ancestors, fits.where("fit is not null").select("ancestor", "path", "fit"), ["ancestor", "path"], ["fit"])
    best = (
        fitting.where("fit is not null")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("fit.rule"), F.length("fit.host"), "fit.rule", "fit.verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
