"""The pipeline's stages on one small table, each against what it must do with its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from contactloom.llm import jaccard
from contactloom.llm.queries import QUERIES
from contactloom.llm.settings import byte_bpe
from contactloom.session import cut_lineage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
    return out


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_stage_keeps_clean_documents(spark, stages):
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    assert clean.join(stages[1], "doc_id", "left_anti").count() == 0
    texts = stages[0].select("doc_id", "text")
    assert stages[1].select("doc_id", "text").exceptAll(texts).count() == 0


def test_one_document_of_each_group_stays(stages):
    groups = jaccard.near_duplicates(stages[1], 5, 80)
    want = {r.component_id for r in groups.collect()}
    assert sorted(r.doc_id for r in stages[2].select("doc_id").collect()) == sorted(want)


def test_secrets_go_and_all_documents_stay(stages):
    assert stages[3].count() == stages[2].count()
    secret = "text rlike 'AKIA[0-9A-Z]{16}' or text rlike 'password=[0-9a-f]{12}' or text rlike 'token = .?[0-9a-f]{40}'"
    before, after = stages[2].where(secret).count(), stages[3].where(secret).count()
    assert before > 0 and after <= before // 4
    changed = stages[3].exceptAll(stages[2].select(*stages[3].columns)).where("text not like '%<secret>%'").count()
    assert changed == 0


def test_mixing_only_repeats_or_leaves_out(stages):
    assert stages[4].distinct().exceptAll(stages[3].distinct()).count() == 0
    assert stages[4].count() > 0.7 * stages[3].count()


def test_packing_holds_every_token(stages):
    tokenizer = Tokenizer.from_file(byte_bpe()[0])
    want = {}
    for r in stages[4].collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.setdefault(r.doc_id, []).append(len(ids))
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(np.frombuffer(r.ids, "<u4"))
    assert got == {d: sum(x) for d, x in want.items()}


def test_run_equals_the_stages(spark, stages):
    again = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert again.select(*columns).exceptAll(stages[5].select(*columns)).count() == 0 and again.count() == stages[5].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_tables(spark, tmp_path, labels=True):
    rng = np.random.default_rng(2)
    words = [f"wort{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words, n))
    one, two = prose(80), prose(80)
    rows = [(i, prose(70), "en", "a", 1) for i in range(30)]
    rows += [(100, one, "en", "a", 1), (100, one, "en", "a", 1), (100, two, "en", "a", 1), (101, one + " end", "en", None, None)]
    rows += [(None, one, None, None, None), (None, two, "en", "b", 3), (200, None, "en", "b", 0), (201, "", None, "b", 0), (202, " \n", "en", None, 2)]
    rows += [(300, prose(30_000), "en", "b", 9), (301, "x" * 200_000, "en", "b", 9), (302, "1234 !", "en", "b", 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(5) for c in ("key", "id", "rate", "posterior", "score", "lang_pred", "tokens", "block", "n")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, i % 2, int(i % 7 == 0)) for i in range(30)] if labels else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return df, one, two


@pytest.mark.filterwarnings("ignore:no finding")
def test_stages_take_odd_rows(spark, tmp_path):
    df, one, two = odd_tables(spark, tmp_path)
    sf, before = str(tmp_path), df
    lang, near, secret, mixed, packs = (stage for _, stage in corpus_pipeline.STAGES)
    kept = cut_lineage(lang(spark, df, sf))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == corpus_pipeline.COLUMNS and not {200, 201, 202, 302} & set(ids) and ids.count(100) == 3
    first = cut_lineage(near(spark, df, sf))
    rows = [(r.doc_id, r.text) for r in first.collect()]
    # two unlike texts of one id both stay, their copies go; what has no id or no words is no copy
    assert sorted(t for i, t in rows if i == 100) == sorted([one, two]) and 101 not in {i for i, _ in rows}
    assert sum(i is None for i, _ in rows) == 2 and {200, 201, 202, 300, 301, 302} <= {i for i, _ in rows} and len(rows) == len(set(rows)) == 40
    clean = cut_lineage(secret(spark, df, sf))
    assert clean.count() == before.count() and clean.where("text is null").count() == 1
    drawn = cut_lineage(mixed(spark, df, sf))
    assert drawn.columns == corpus_pipeline.COLUMNS
    assert packs(spark, df, sf).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.filterwarnings("ignore:no finding")
def test_without_labels_or_rows(spark, tmp_path):
    (tmp_path / "some").mkdir()
    df, *_ = odd_tables(spark, tmp_path / "some", labels=False)
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, df, str(tmp_path / "some"))
    assert mixed.count() == df.count()
    unnamed = df.withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, unnamed, "").count() == 0
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0, name
    for name, fn in QUERIES.items():
        assert fn(spark, empty).collect() == [], name
    assert corpus_pipeline.run(spark, empty).collect() == []
