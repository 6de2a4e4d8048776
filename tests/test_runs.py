"""A stored feature run: same table as without storing, and nothing left in the scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from contactloom.operators import features as X
from contactloom.plans import runs
from contactloom.plans.parameters import RunParameters
from contactloom.session import scratch_path, scratch_root, scratch_scope
from contactloom.sources import writers as K


def inputs(spark):
    contacts = spark.createDataFrame([("chr1", 5000 * i, 5000 * (i + 12 + i % 5), float(i + 1), 5000 * (12 + i % 5)) for i in range(60)], "chr string, contact_st bigint, contact_en bigint, contact_count double, dist bigint")
    peaks = spark.createDataFrame([("chr1", 4000 * i, 4000 * i + 300, 4000 * i + 150, float(i % 7)) for i in range(90)], "chr string, start bigint, end bigint, mids bigint, sigVal double")
    return contacts, peaks


def test_stored_run_leaves_nothing_behind(spark, tmp_path):
    contacts, peaks = inputs(spark)
    families = [X.PeakSums(peaks, "CTCF", 25_000, 2)]
    parameters = RunParameters(mindist=0)
    plain = runs.generate_features(contacts, families, parameters)
    want = sorted(tuple(r) for r in plain.collect())
    root = scratch_root(spark)
    before = set(os.listdir(root))
    stored = runs.generate_features(contacts, families, parameters, output=str(tmp_path / "features"))
    assert stored.columns == plain.columns and sorted(tuple(r) for r in stored.collect()) == want and len(want) == 60
    assert set(os.listdir(root)) == before


def test_a_run_can_be_repeated_and_restarted(spark, tmp_path, monkeypatch):
    contacts, peaks = inputs(spark)
    more = contacts.unionByName(contacts.withColumn("chr", F.lit("chr2")))
    families, parameters = [X.PeakSums(peaks, "CTCF", 25_000, 2)], RunParameters(mindist=0)
    out = str(tmp_path / "features")
    # a run that ended after its first chromosome
    runs.generate_features(contacts, families, parameters, output=out, run="a")
    seen = []
    assemble = X.assemble
    monkeypatch.setattr(runs.X, "assemble", lambda df, f: seen.append(sorted(r.chr for r in df.select("chr").distinct().collect())) or assemble(df, f))
    whole = sorted(tuple(r) for r in runs.generate_features(more, families, parameters, output=out, run="a").collect())
    assert seen == [["chr2"]] and len(whole) == 120
    again = runs.generate_features(more, families, parameters, output=out, run="a")
    assert seen == [["chr2"]] and sorted(map(str, again.collect())) == sorted(map(str, runs.generate_features(more, families, parameters, output=out, run="a").collect()))
    # writing a run twice leaves its rows once, and other runs alone
    table = assemble(contacts, families)
    for _ in range(2):
        K.write_predictors(table, out, run="b")
    stored = spark.read.parquet(out)
    assert {(r["run_id"], r["chr"]): r["count"] for r in stored.groupBy("run_id", "chr").count().collect()} == {("a", "chr1"): 60, ("a", "chr2"): 60, ("b", "chr1"): 60}
    with pytest.raises(ValueError, match="holds columns"):
        K.write_predictors(table.withColumnRenamed("contact_count", "n"), out, run="c")
    text = str(tmp_path / "text")
    K.write_predictors(table, text, "csv")
    K.write_predictors(table, text, "csv")
    with pytest.raises(ValueError, match="holds columns"):
        K.write_predictors(table.select(*reversed(table.columns)), text, "csv")


def test_scopes_nest(spark):
    with scratch_scope(spark):
        outer = scratch_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch_scope(spark):
            inner = scratch_path(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert os.path.isdir(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer)
