"""Winnowing against a plain version of its rule, and the edited texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from contactloom.llm import fingerprints
from contactloom.llm.queries import QUERIES

K, WINDOW = 4, 8


def chain(docs):
    """Each document with the next one by descending id, null last, ties by text."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()), reverse=True)
    return [(d, order[(i + 1) % len(order)]) for i, d in enumerate(order)]


def edited(text, nxt):
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "é", "x" * 60, "日本", "\U0001f600", "go", "stop", "b"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in rng.sample(range(-500, 500), 120)]
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a"), (1004, "tie " * 300), (1005, docs[0][1]), (None, "last one"), (None, None)]
    return docs


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_edited_texts_follow_the_order(spark, monkeypatch, buckets):
    monkeypatch.setattr(fingerprints, "partitions", lambda _: buckets)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, n_chars int").repartition(3)
    rows = fingerprints.edited_pairs(df).collect()
    got = sorted(((r.doc_id, r.n_chars, r.text, r.edited) for r in rows), key=str)
    want = sorted(((d, len(t or ""), t or "", edited(t or "", n or "")) for (d, t), (_, n) in chain(docs)), key=str)
    assert got == want
    marks = {r.text: [m >> 20 for m in r.marks] for r in rows}
    of_next = {(d, t or ""): n or "" for (d, t), (_, n) in chain(docs)}
    for r in rows:
        a, b = set(marks[r.text]), set(marks[of_next[r.doc_id, r.text]])
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        e = {m >> 20 for m in r.edited_marks}
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)


def test_marks_are_the_window_minima(spark):
    texts = [t or "" for _, t in corpus()]
    pieces = F.regexp_extract_all("text", F.lit(r"\S{1,24}"), F.lit(0))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    h = F.transform(pieces, lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - 3)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(K)]))
    for r in df.select("text", runs.alias("runs"), fingerprints.marks(F.col("text"), K, WINDOW).alias("marks")).collect():
        if not re.search(r"[^ \t\n\x0b\f\r]", r.text):
            assert r.marks == []
            continue
        low = [((x << 20) & (1 << 64) - 1) for x in r.runs]
        signed = [x - (1 << 64) if x >> 63 else x for x in low]
        want = set()
        for s in range(max(1, len(signed) - WINDOW + 1)):
            best = min(signed[s : s + WINDOW])
            want.add(max(i for i in range(s, min(s + WINDOW, len(signed))) if signed[i] == best))
        got = [fingerprints.LAST - (m & fingerprints.LAST) for m in r.marks]
        assert got == sorted(want)
        assert [m >> 20 for m in r.marks] == [signed[i] >> 20 for i in got]


def test_shared_passages_share_a_mark(spark):
    rng = random.Random(8)
    prose = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    passage = prose(K + WINDOW - 1)
    a, b = (" ".join(prose(40) + passage + prose(30)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r.near_next > 0 for r in fingerprints.edited_pairs(df, k=K, window=WINDOW).collect())
    assert fingerprints.edited_pairs(df.where("doc_id > 5")).count() == 0
    alone = fingerprints.edited_pairs(df.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.edited == edited(a, a)


def test_short_texts_share_marks_with_their_edited_ones(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    rows = [(i, " ".join(word() for _ in range(1 + i % 30 if i % 30 else 200))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in fingerprints.edited_pairs(df).collect():
        assert r.near_edited > 0 or len(r.text) < 2 * fingerprints.GRAM, r
    same = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in fingerprints.edited_pairs(same).collect()} == {3: 0.0, 2: 1.0, 1: 0.0}


def test_long_runs_do_not_depend_on_their_start(spark):
    rng = random.Random(13)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789+/", [chr(0x4E00 + i) for i in range(2000)]):
        run = "".join(rng.choice(alphabet) for _ in range(900))
        passage = "".join(rng.choice(alphabet) for _ in range(20))
        lone = ["".join(rng.choice(alphabet) for _ in range(400)) + passage + "".join(rng.choice(alphabet) for _ in range(300 + n)) for n in (0, 7)]
        texts = [run, "x" + run, lone[0], lone[1]]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        near = {r.doc_id: r.near_next for r in fingerprints.edited_pairs(df).collect()}
        assert near[1] > 0.9 and near[3] > 0 and near[2] == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: (len(t or ""), hashlib.sha256(edited(t or "", n or "").encode()).hexdigest()) for (d, t), (_, n) in chain(docs)}
    rows = QUERIES["op9_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    texts = dict(docs)
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
