"""Quality rules: plain counts of a text, and a log-likelihood ratio of hashed n-grams, with built-in functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the
buckets are gathered: the raw corpus (every document) and a trusted target (all documents of one half of those that labels
call good). A document's score is the mean, over its n-grams, of log(target share / raw share); the mean
takes the length out. A document is kept if its score is not below a threshold: the score that all but a set share of
trusted documents reach, taken from all trusted documents of the other half, whose n-grams are not in the target's counts.

Counts are added map-side, so a shuffle carries at most one row per bucket and task. The weights are whole
numbers (millionths), so sums do not depend on order; the table of weights has a fixed size and reaches the
rows as the value of a scalar subquery. Texts are shuffled only where the trusted ids are too many to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import text_or_empty
from contactloom.operators.ordered import exact_quantiles
from contactloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MILLION = 1_000_000

#: Trusted ids up to this number are broadcast; more meet the texts in a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass
class Ratio:
    """``weights``: one row (weights), the log ratio of each bucket in millionths; ``threshold``: least score, in millionths, or None."""

    weights: DataFrame
    buckets: int
    threshold: float | None


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bucket(buckets: int, *parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def pairs_of(words: Column) -> Column:
    """Positions of the pairs of neighbouring words; null if there is none."""
    return F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2))


def grams(words: str, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    w = F.col(words)
    pairs = F.transform(pairs_of(w), lambda i: bucket(buckets, F.get(w, i), F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: bucket(buckets, x)), F.coalesce(pairs, F.array().cast("array<int>")))


def gram_counts(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): how often each bucket of ``grams`` occurs in ``rows`` (with ``_words``); hashed row by row, without arrays of buckets."""
    words = F.col("_words")
    following = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    beside = rows.select(F.inline(F.arrays_zip(words.alias("word"), following.alias("next"))))
    pair = F.when(F.col("next").isNotNull(), bucket(buckets, "word", "next"))
    hashed = beside.select(F.explode(F.array(bucket(buckets, "word"), pair)).alias("bucket")).where("bucket is not null")
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``_text``) plus ``_words`` and the counts of the base rules."""
    body = text_or_empty("_text")
    words, lines = F.col("_words"), F.col("_lines")
    none = F.array()
    out = docs.withColumn("_words", words_of(body))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    # hashes of the three-word windows: where all differ, so do the windows
    window = lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumn("_windows", F.when(F.size(words) > 2, F.transform(F.slice(words, F.lit(1), F.size(words) - 2), window)))
    few = F.size(F.array_distinct("_windows")) < F.size("_windows")
    # equal hashes stand together once sorted; words decide between neighbours of one hash
    same = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(3)])
    spelled = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), same(i).alias("w"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(few, spelled))
    length = F.size("_sorted") - 1
    twins = F.zip_with(
        F.slice(F.col("_sorted"), F.lit(1), length), F.slice(F.col("_sorted"), F.lit(2), length),
        lambda a, b: F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), F.array(a["i"], b["i"])).otherwise(none.cast("array<int>")),
    )
    out = out.withColumn("_twice", F.sort_array(F.array_distinct(F.flatten(twins))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_twice", start, lambda at, i: F.struct((i + 3).alias("end"), (at["n"] + i + 3 - F.greatest(i, at["end"])).alias("n")))["n"]
    return out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_lines", "_windows", "_sorted", "_twice")


def scored(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """``rows`` (with ``_words``) plus ``_score``: the mean log ratio of a document's n-grams in millionths; null without words."""
    weighed = rows.withColumn("_weights", ratio.weights.scalar())
    words, none = F.col("_words"), F.lit(0).cast("long")
    weight = lambda *parts: F.get(F.col("_weights"), bucket(ratio.buckets, *parts))
    singles = F.aggregate(words, none, lambda a, x: a + weight(x))
    pairs = F.aggregate(pairs_of(words), none, lambda a, i: a + weight(F.get(words, i), F.get(words, i + 1)))
    mean = F.when(F.size(words) > 0, (singles + F.coalesce(pairs, none)).cast("double") / (2 * F.size(words) - 1))
    return weighed.withColumn("_score", mean).drop("_weights")


def learn(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = 1 << 16, pass_share: float = 0.999, least_words: int = 50, smoothing: float = 1.0, broadcast_ids: int = BROADCAST_IDS) -> Ratio:
    """The log ratio of each bucket and the threshold that ``pass_share`` of the trusted documents reach.

    ``trusted`` (key) names good documents; repeated and null keys count once and not at all. Half of them
    (by a hash) make the target, the other half sets the threshold (only texts of ``least_words`` words or more);
    each half is used whole, and the threshold is an exact quantile. The raw counts take every document. Without trusted documents in both
    halves there is no threshold. Up to ``broadcast_ids`` trusted ids are broadcast; with more, the texts are shuffled once by
    key, streamed past the ids of their partition, and those of trusted documents are written.
    """
    named = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    ids = trusted.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    halved = cut_lineage(ids.withColumn("_half", F.pmod(F.xxhash64(F.col("_id"), F.lit("half")), F.lit(2)).cast("int")))
    if halved.count() <= broadcast_ids:
        good_texts = named.join(F.broadcast(halved), "_id")
    else:
        good_texts = cut_lineage(named.join(halved.hint("shuffle_hash"), "_id").select("_half", "_text"))
    split = lambda df: df.withColumn("_words", words_of(text_or_empty("_text")))
    raw_counts = gram_counts(split(named), buckets, "raw")
    target_counts = gram_counts(split(good_texts.where("_half = 0")), buckets, "target")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = cut_lineage(every.join(raw_counts, "bucket", "left").join(target_counts, "bucket", "left").na.fill(0))
    raw, good = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = lambda c, n: (F.col(c) + smoothing) / F.lit(float(n + smoothing * buckets))
    weight = F.round(MILLION * F.log(share("target", good) / share("raw", raw))).cast("long")
    weights = cut_lineage(counts.agg(F.sort_array(F.collect_list(F.struct("bucket", weight.alias("w")))).alias("all")).select(F.transform("all", lambda x: x["w"]).alias("weights")))
    ratio = Ratio(weights, buckets, None)
    if not good:
        return ratio
    held_out = split(good_texts.where("_half = 1")).where(F.size("_words") >= least_words)
    scores = cut_lineage(scored(held_out, ratio).select("_score"))
    found = exact_quantiles(scores, [], "_score", {"least": 1.0 - pass_share}).first()
    ratio.threshold = found["least"] if found else None
    return ratio


def judge(docs: DataFrame, ratio: Ratio, text: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A document fails the base rules with fewer than ``least_words`` words, or if more than ``most_repeated``
    percent of them lie in three-word windows that occur again in the text. Of the others those are kept whose ``score`` (mean
    log ratio of n-grams) is not below the threshold; all of them, if there is none.

    A null text has no words, like an empty one (score null, not kept); equal texts get equal verdicts;
    new columns replace old ones of their names; an empty table stays empty. Texts are judged whole.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    own = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[c for c in own if c != text]).alias("_row"), F.col(text).alias("_text"))
    rated = scored(counted(rows), ratio)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    passes = F.lit(True) if ratio.threshold is None else F.col("_score") >= F.lit(ratio.threshold)
    told = rated.select("_row", "_text", *made[:5], failed.alias("base_failed"), (F.col("_score") / MILLION).alias("score"), (~failed & F.coalesce(passes, F.lit(False))).alias("kept"))
    # a generator between the counts and the caller: filters on a verdict stay above it, where they cost nothing
    carried = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in own]
    return told.select(*carried, F.inline(F.array(F.struct(*made))))
