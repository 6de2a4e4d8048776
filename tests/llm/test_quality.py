"""The quality rules next to plain counts and a plain ratio of multinomials."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactloom.llm import quality, queries
from contactloom.llm.common import table

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
    return *counts, len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def texts():
    rng = random.Random(3)
    some = ["a b c d", "a a a a a", "", None, "  \n\t\x0b\x0c\r ", "x", "x y", "x y z", "x y z x y z", "#*$%&|<> <a>|b", "l\nl\n\nl \n l\nm\n", "é ß 日本語 𝄞𝄞   x", "one\x00two one\x00two"]
    some += [" ".join(rng.choice("ab" if i % 2 else "abcdefghij") for _ in range(rng.randrange(1, 90))) for i in range(40)]
    some += [" ".join(f"w{rng.randrange(300)}" for _ in range(20000)), "same " * 3000, "z" * 100000, "line of words\n" * 60]
    return some


def test_counts_like_plain_ones(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    none = quality.learn(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long"))
    out = quality.judge(spark.createDataFrame(rows, SCHEMA), none).collect()
    got = {r["doc_id"]: tuple(r)[2:8] for r in out}
    assert got == {i: plain_counts(t) for i, t in rows}
    # without trusted documents only the base rules decide
    assert all(r["kept"] == (not r["base_failed"]) for r in out)


def made_documents(n: int = 240):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(4)) for _ in range(rng.randrange(60, 200))) for _ in range(n)]
    bad = [" ".join(rng.choice(["###", "$$$", "!!"]) + str(rng.randrange(40)) for _ in range(rng.randrange(60, 200))) for _ in range(n // 4)]
    return [(i, t) for i, t in enumerate([*good, *bad])], n


def test_ratio_like_a_plain_one(spark):
    rows, n = made_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(0, n, 2)] * 2 + [(None,)], "doc_id long")
    ratio = quality.learn(docs, trusted, buckets=512)
    listed = docs.withColumn("_words", quality.words_of(F.col("text"))).select("doc_id", quality.grams("_words", 512).alias("g")).collect()
    grams = {r["doc_id"]: r["g"] for r in listed}
    assert all(len(grams[i]) == 2 * len(t.split()) - 1 for i, t in rows)
    ids = spark.createDataFrame([(i,) for i in range(0, n, 2)], "_id long")
    half = {r["_id"]: r["h"] for r in ids.select("_id", F.pmod(F.xxhash64(F.col("_id"), F.lit("half")), F.lit(2)).alias("h")).collect()}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if half.get(i) == 0:
            good.update(g)
    weight = {b: math.log((good[b] + 1) / (good.total() + 512)) - math.log((raw[b] + 1) / (raw.total() + 512)) for b in raw}
    score = {i: sum(weight[b] for b in g) / len(g) for i, g in grams.items()}
    out = {r["doc_id"]: r for r in quality.judge(docs, ratio).collect()}
    assert all(abs(out[i]["score"] - s) < 1e-5 for i, s in score.items())
    calm = sorted(score[i] for i, h in half.items() if h == 1)
    at = (1 - 0.999) * (len(calm) - 1)
    assert abs(ratio.threshold / 1e6 - (calm[0] + at * (calm[1] - calm[0]))) < 1e-4
    assert all(out[i]["kept"] == (out[i]["score"] >= ratio.threshold / 1e6 - 1e-12 and not out[i]["base_failed"]) for i in out)
    assert not any(out[i]["kept"] for i in range(n, len(rows)))
    assert sum(out[i]["kept"] for i in range(n)) >= 0.97 * n


def test_held_out_labels(spark):
    """Learned from the labels with even ids, judged on the odd ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    ratio = quality.learn(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id"))
    odd = quality.judge(docs, ratio).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    shares = {r["quality"]: r["kept"] for r in odd.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[0] < 0.05 and shares[1] > 0.97


def test_edges(spark):
    rows, n = made_documents(40)
    rows += [(None, rows[0][1]), (0, rows[0][1]), (0, rows[-1][1]), (500, None), (501, "")]
    names = ("_words", "_text", "_row", "_score", "score", "kept", "n_words", "_half", "_id", "bucket", "_weights")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in names})
    ratio = quality.learn(docs, docs.select("doc_id"))
    out = quality.judge(docs, ratio).collect()
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        by_text.setdefault(r["text"], set()).add((r["kept"], r["score"]))
        assert r["_words"] == r["_score"] == r["bucket"] == 7
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == {(False, None)} == by_text[""]
    assert quality.judge(docs.limit(0), ratio).collect() == []


@pytest.mark.parametrize("name", ["op13_quality_rules"])
def test_no_python_workers(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_every_trusted_document_counts(spark, broadcast_ids):
    """More than 100,000 trusted documents: counts and threshold come from all of them, whether their ids are broadcast or shuffled."""
    n, late = 110_000, F.pmod(F.xxhash64(F.lit("trusted"), F.col("doc_id")), F.lit(1 << 30)) > 0.95 * (1 << 30)
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))
    base = spark.range(n).select(F.col("id").alias("doc_id"))
    docs = base.select("doc_id", F.when(late, F.when(half == 0, "rare rare").otherwise("odd rare odd")).otherwise("plain words").alias("text"))
    ratio = quality.learn(docs, base, buckets=64, least_words=1, broadcast_ids=broadcast_ids)
    # plain counts of the few kinds of texts
    kinds = docs.groupBy("text", half.alias("half")).count().withColumn("_words", F.split("text", " ")).select("half", "count", quality.grams("_words", 64).alias("g")).collect()
    raw, good = Counter(), Counter()
    for r in kinds:
        for b in r["g"]:
            raw[b] += r["count"]
            good[b] += r["count"] if r["half"] == 0 else 0
    weight = [math.log((good[b] + 1) / (good.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)]
    assert all(abs(w / 1e6 - v) < 1e-6 for w, v in zip(ratio.weights.first()[0], weight, strict=True))
    scores = sorted((sum(weight[b] for b in r["g"]) / len(r["g"]), r["count"]) for r in kinds if r["half"] == 1)
    at = (1 - 0.999) * (sum(c for _, c in scores) - 1)
    # the least kind is more than one in a thousand, so the threshold is its score
    assert at < scores[0][1] - 1 and abs(ratio.threshold / 1e6 - scores[0][0]) < 1e-6
