"""The corpus pipeline: language ID, near-duplicate join, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
``documents``. Further columns of ``docs`` are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import jaccard, language, mixing, packing, secrets
from contactloom.llm.common import table
from contactloom.llm.settings import MIX_TARGETS, byte_bpe, held_out, labelled_domains
from contactloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: documents whose language is less sure than this are rejected
LEAST_SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined; ``lang`` is the predicted one.

    A null or empty text, or one without letters, has no language and goes. Rows with a null id are judged like others but
    don't teach; repeated rows are judged alike. Without a labelled text nothing is determined, so nothing stays.
    """
    net = language.fit(docs.where(~held_out()))
    sure = language.predict(docs.select(*COLUMNS), net).where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SURE))
    return sure.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): the one with the smallest id.

    Of rows equal in id and text one stays. An id that stands on rows with different texts is several documents,
    each judged by its own text; they go by a number made of id and text, below all others. Documents without words, and
    rows with a null id, are no one's copies and stay.
    """
    own = docs.select(*COLUMNS)
    repeated = cut_lineage(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return _firsts(own.withColumn("key", F.col("doc_id")))
    several = jaccard.only(own, repeated).dropDuplicates(["doc_id", "text"])
    number = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    alone = jaccard.only(own, repeated, "left_anti").withColumn("key", F.col("doc_id"))
    return _firsts(cut_lineage(alone.unionByName(several.withColumn("key", number))))


def _firsts(keyed: DataFrame) -> DataFrame:
    """Rows whose ``key`` names their group, or is null."""
    groups = jaccard.near_duplicates(keyed.select("key", "text"), k=5, percent=80, key="key")
    others = groups.where("doc_id <> component_id").select("doc_id")
    named = keyed.withColumnsRenamed({"doc_id": "id", "key": "doc_id"})
    return jaccard.only(named, others, "left_anti").drop("doc_id").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay, repeated rows and null texts too; ``n_chars`` is counted anew."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    The draw is by id: repeated rows, and all rows with a null id, are drawn alike. Without labels every rate is 1.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), labelled_domains(spark, sf_dir), MIX_TARGETS)
    return mixing.drawn(mixed).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024. A null or empty text is its closing id alone; repeated rows are documents of their own."""
    vocabulary, ranks = byte_bpe()
    return packing.pack(docs, vocabulary, ranks=ranks)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing_weights),
    ("packing", packed),
]

#: trained models and tokenizers are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
