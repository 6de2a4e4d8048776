"""Mixing sources to target weights by soft membership, with built-in functions only.

A naive Bayes classifier, learned from a table of labelled documents, gives every document a posterior
over domains. A document's rate (how often it enters the mixture) is found by projected-gradient least
squares: the expected tokens of domain k are sum_i rate_i * tokens_i * p_ik, and rates move against the
gradient of the squared distance from the targets, measured in the domains' second moments, and are cut
off at 0. A step needs one aggregate of as many numbers as there are domains; a document's rate is a
function of its own posterior and the steps so far, so nothing is written between steps. Of a step and
its halves, the one that comes nearest is taken, so the distance never grows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import text_or_empty
from contactloom.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: lengths that are tried for each step: the whole, a half, a quarter, ...
HALVINGS = 6
#: bits below which a sign is left out of the vocabulary
LEAST_TOLD = 0.3
LETTERS = UPPER + UPPER.lower() + " \t\r\n"


def total(terms) -> Column:
    out = F.lit(0.0)
    for term in terms:
        out = out + term
    return out


def signs(text: Column) -> Column:
    """Distinct words of a text in lower case, and marks of its shape that start with ``#``."""
    size = F.length(text)
    capitals = size - F.length(F.translate(text, UPPER, ""))
    other = F.length(F.translate(text, LETTERS, ""))
    words = F.split(F.lower(text), r"\s+")
    shape = F.array(
        F.concat(F.lit("#capitals"), F.floor(10 * capitals / F.greatest(size, F.lit(1))).cast("string")),
        F.concat(F.lit("#other"), F.floor(10 * other / F.greatest(size, F.lit(1))).cast("string")),
        F.concat(F.lit("#length"), F.floor(F.log2(size + F.lit(1.0))).cast("string")),
    )
    return F.array_distinct(F.concat(words, shape))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, per_domain: int, vocabulary: int) -> tuple[list[str], dict[str, tuple[float, float]], dict[str, list[float]]]:
    """Domains, their log priors with the log weights of no word at all, and the log odds of the ``vocabulary`` words that tell most.

    ``labels`` (key, domain). The posterior's classifier uses at most about ``per_domain`` labelled documents
    of each domain, drawn by a hash of the key; priors count all labels.
    """
    clean = labels.where(F.col(key).isNotNull() & F.col("domain").isNotNull()).select(key, F.col("domain").cast("string").alias("domain"))
    counts = {r["domain"]: r["count"] for r in clean.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        return [], {}, {}
    everything = sum(counts.values())
    span = 1 << 30
    limit = F.element_at(F.create_map(*[F.lit(x) for d in domains for x in (d, int(span * min(1.0, per_domain / counts[d])))]), F.col("domain"))
    chosen = clean.where(F.pmod(F.xxhash64(key), F.lit(span)) <= limit)
    # per_domain rows of each domain at most: a size that the parameters fix
    sample = docs.select(key, text).join(F.broadcast(chosen), key).select("domain", signs(text_or_empty(text)).alias("signs"))
    sample = cut_lineage(sample)
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    seen = sample.select("domain", F.explode("signs").alias("sign")).where("sign != ''").groupBy("sign").agg(*per)
    rates = [(F.col(f"n{i}") + 0.5) / F.lit(sizes.get(d, 0) + 1.0) for i, d in enumerate(domains)]
    # a sign tells as much as its share in one domain stands out from that in every other one
    outstanding = []
    for i, r in enumerate(rates):
        others = [x for j, x in enumerate(rates) if j != i]
        outstanding.append(r * F.log2(r / (F.greatest(*others) if len(others) > 1 else others[0] if others else r)))
    told = (F.greatest(*outstanding) if len(outstanding) > 1 else outstanding[0]).alias("told")
    signed = seen.select("sign", told, *[r.alias(f"r{i}") for i, r in enumerate(rates)])
    best = signed.where(F.col("told") >= LEAST_TOLD).orderBy(F.desc("told"), "sign").limit(vocabulary).collect()
    # a word that is there adds the log odds of its share, one that isn't the log of the rest (put into the base)
    shares = {r["sign"]: [r[f"r{i}"] for i in range(len(domains))] for r in best}
    weights = {w: [math.log(x / (1 - x)) for x in row] for w, row in shares.items()}
    base = {d: (math.log(counts[d] / everything), sum(math.log(1 - row[i]) for row in shares.values())) for i, d in enumerate(domains)}
    return domains, base, weights


def posteriors(docs: DataFrame, model, text: str, temper: float) -> DataFrame:
    """``docs`` plus ``posterior``: an array with the probability of each domain, in order of name; empty without domains."""
    domains, base, weights = model
    if not domains:
        return docs.withColumn("posterior", F.array().cast("array<double>"))
    known = F.array(*[F.lit(w) for w in sorted(weights)]) if weights else F.array().cast("array<string>")
    hits = F.array_intersect(signs(text_or_empty(text)), known)
    tables = [F.create_map(*[F.lit(x) for w in sorted(weights) for x in (w, weights[w][i])]) for i in range(len(domains))] if weights else []

    def summed(table: Column) -> Column:
        return F.aggregate("hits", F.lit(0.0), lambda a, w: a + F.element_at(table, w)) / temper

    scores = [F.lit(base[d][0] + base[d][1] / temper) + (summed(tables[i]) if weights else F.lit(0.0)) for i, d in enumerate(domains)]
    scored = docs.withColumn("hits", hits).withColumn("scores", F.array(*scores))
    grown = scored.withColumn("grown", F.transform("scores", lambda s: F.exp(s - F.array_max("scores"))))
    return grown.withColumn("posterior", F.transform("grown", lambda g: g / F.aggregate("grown", F.lit(0.0), lambda a, x: a + x))).drop("hits", "scores", "grown")


def rates(members: DataFrame, targets: list[float], steps: int, tolerance: float) -> tuple[Column, list[float]]:
    """The rate as an expression of ``posterior``, and the reached shares of tokens by domain.

    ``members`` (tokens, posterior); ``targets``: shares of all tokens wanted for each domain.
    """
    k = len(targets)
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    n, pairs = F.col("tokens").cast("double"), [(i, j) for i in range(k) for j in range(i, k)]
    everything = members.agg(F.sum(n)).first()[0] or 0.0
    if not everything:
        return F.lit(0.0), [0.0] * k
    wanted, moves = np.array(targets), []

    def shares(tried: list[list[list[float]]]) -> list[np.ndarray]:
        """The shares that each of several sequences of steps reaches, in one pass."""
        sums = [F.sum(after(steps, k) * n * p[i]).alias(f"t{a}_{i}") for a, steps in enumerate(tried) for i in range(k)]
        row = members.agg(*sums).first()
        return [np.array([row[f"t{a}_{i}"] for i in range(k)]) / everything for a in range(len(tried))]

    reached = shares([[]])[0]
    for _ in range(steps):
        miss = reached - wanted
        if np.abs(miss).max() <= tolerance:
            break
        # second moments of the documents that can still move down
        row = members.where(after(moves, k) > 0).agg(*[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
        m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / everything
        move = np.linalg.solve(m + np.eye(k) * 1e-9 * max(np.trace(m), 1e-9), miss)
        tried = [[*moves, (move / 2**h).tolist()] for h in range(HALVINGS)]
        results = shares(tried)
        errors = [float(((r - wanted) ** 2).sum()) for r in results]
        best = int(np.argmin(errors))
        if errors[best] >= float((miss**2).sum()) * (1 - 1e-6):
            break
        moves, reached = tried[best], results[best]
    return after(moves, k), reached.tolist()


def after(moves: list[list[float]], k: int) -> Column:
    """The rate of a document after these steps, from its posterior."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(x) for x in m]) for m in moves])
    return F.aggregate(
        steps, F.lit(1.0), lambda rate, m: F.greatest(F.lit(0.0), rate - total(F.element_at("posterior", i + 1) * m[i] for i in range(k)))
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id", per_domain: int = 2000, vocabulary: int = 200, temper: float = 2.0, steps: int = 25, tolerance: float = 1e-4, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) plus ``n_tokens``, ``posterior`` (domains in order of name) and ``rate``.

    ``labels`` (key, domain) teaches the domains; ``targets`` are the shares of expected tokens wanted of
    each domain (domains left out want 0; they are scaled to sum to 1), while the total stays that of the input. Null or empty
    texts have no tokens and get the prior as posterior; repeated rows and ties get equal rates; new columns
    replace old ones of their names; an empty table gives no rows. Targets that nonnegative rates can't
    reach are approached as the least squares say. A target whose domain no label names is left out, and the others are
    scaled to sum to 1; if none is left (an empty ``labels``, say), every rate is 1.
    """
    kept = [c for c in carry or docs.columns if c not in ("n_tokens", "posterior", "rate")]
    model = learn(docs, labels, text, key, per_domain, vocabulary)
    if min(targets.values(), default=0) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must not be negative, nor all 0")
    domains = model[0]
    whole = sum(targets.get(d, 0.0) for d in domains)
    own = docs.drop("n_tokens", "posterior", "rate")
    scored = cut_lineage(posteriors(own, model, text, temper).withColumn("n_tokens", tokens(text_or_empty(text))).select(*kept, "n_tokens", "posterior"))
    if whole <= 0:
        return scored.withColumn("rate", F.lit(1.0))
    members = scored.select(F.col("n_tokens").alias("tokens"), "posterior")
    rate, _ = rates(members, [targets.get(d, 0.0) / whole for d in domains], steps, tolerance)
    return scored.withColumn("rate", rate)


def drawn(mixed: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Each row of ``mixed`` as often as its rate says: the whole part, and once more with the rest as probability.

    The draw is a hash of the key, so a rerun repeats it; columns of ``mix`` are dropped.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return mixed.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy", "rate", "posterior", "n_tokens")
