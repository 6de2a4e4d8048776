"""Training refuses what it would have to leave out, and scratch folders are shared ones."""

import pytest

from contactloom import session
from contactloom.operators import model as M
from contactloom.plans import q_model


def table(spark, counts):
    rows = [("chr1", i, i + 10, c, float(i)) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "chr string, contact_st bigint, contact_en bigint, contact_count double, x double")


def test_zero_counts_are_refused_unless_told(spark):
    df = table(spark, [0.0, 1.0, 2.0, 4.0, 8.0, None])
    small = M.default_trees(2, 2)
    with pytest.raises(ValueError, match="2 counts"):
        M.train(df, ["x"], small)
    assert M.train(df, ["x"], small, on_zero="drop").features == ("x",)
    assert M.train(df, ["x"], small, on_zero=1).log_target
    with pytest.raises(ValueError, match="on_zero"):
        M.train(df, ["x"], small, on_zero="keep")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Spark())


def test_a_removed_table_of_the_model_queries_is_written_again(spark, monkeypatch):
    """Scratch folders are cleared between queries; the next model query must not read a table that is gone."""
    made = spark.createDataFrame([("chr1", 1, 2, 5, 1.0), ("chr4", 1, 2, 200_000, 1.0)], "chr string, contact_st bigint, contact_en bigint, contact_dist bigint, contact_count double")
    monkeypatch.setattr(q_model, "base", lambda *a: None)
    monkeypatch.setattr(q_model, "families", lambda *a: None)
    monkeypatch.setattr(q_model.X, "assemble", lambda *a: made)
    train, _ = q_model._tables(spark, "/made")
    files = train.inputFiles()
    assert q_model._tables(spark, "/made")[0].inputFiles() == files
    session._remove(spark, files[0].rsplit("/", 1)[0])
    spark.catalog.clearCache()
    train, held_out = q_model._tables(spark, "/made")
    assert [(r["chr"], r["contact_count"]) for r in (*train.collect(), *held_out.collect())] == [("chr1", 40.0), ("chr4", 8.0)]
