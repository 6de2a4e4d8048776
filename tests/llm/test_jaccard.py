"""The near-duplicate join against all pairs of sets, with tall columns, and the components."""

import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactloom.llm import jaccard
from contactloom.llm.components import components
from contactloom.session import cut_lineage, scratch_root


def sets_of(text, k):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(table))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(docs, k, percent):
    sets = [(d, sets_of(t, k)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(sets_of(t, k)), top(d) if d is not None else None) for d, t in docs), key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    notice = " ".join(prose(14))
    docs = [" ".join(prose(rng.randint(0, 60))) for _ in range(60)] + [f"{notice} {' '.join(prose(rng.randint(1, 8)))}" for _ in range(60)]
    base = prose(90)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    docs += [docs[130]] * 40 + [None, "", " \n\t", "One two", "ONE  TWO", "one two three", "café É a b c", "a b c", "​"]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(None, docs[3]), (None, None)]


@pytest.mark.parametrize(("k", "percent", "busy", "tile"), [(4, 85, 32, 2048), (5, 80, 4, 64), (4, 85, 2, 16)])
def test_equals_all_pairs(spark, monkeypatch, k, percent, busy, tile):
    monkeypatch.setattr(jaccard, "BUSY", busy)
    monkeypatch.setattr(jaccard, "TILE", tile)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, component_id int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, k, percent).collect()), key=str)
    assert got == brute(docs, k, percent)


def test_texts_are_shuffled_when_ids_are_many(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute(docs, 4, 85)


@pytest.mark.parametrize("bits", [4, 9])
def test_grams_that_share_a_column_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "COLUMN_BITS", bits)
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute(docs, 4, 85)


@pytest.mark.parametrize("again", [False, True])
def test_postings_carry_short_numbers(spark, monkeypatch, again):
    """A column's short name, and nothing of the set's hash unless an id stands on several rows."""
    written, before = [], set(Path(scratch_root(spark)).glob("table-*"))
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    docs = corpus(6)
    docs += [(docs[0][0], "six other words stand here too"), (docs[0][0], "")] * again
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute(docs, 4, 85)
    # the hashes of all sets are gone when the pairs are sought
    folders = Path(scratch_root(spark)).glob("table-*")
    assert not any({"sid", "grams"} <= set(spark.read.parquet(str(f)).columns) for f in set(folders) - before if any(f.glob("*.parquet")))
    shared = next(t for t in written if {"h", "part", "m"} <= set(t.columns)).collect()
    assert shared and all(0 <= r.h < 1 << 40 and (r.part == 0 or again and r.doc_id == docs[0][0]) for r in shared)


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert jaccard.near_duplicates(df.where("doc_id > 9")).count() == 0
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df).collect()) == [(3, 2, 3), (5, 2, 3), (5, 2, 3)]
    # an id with two texts ties together what they are copies of
    two = spark.createDataFrame([(3, "a b c d e"), (7, "a b c d e"), (7, "p q r s t u"), (9, "p q r s t u")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(two).collect()} == {(3, 3), (7, 3), (9, 3)}


@pytest.mark.parametrize("text_again", [True, False])
def test_repeated_rows_keep_their_links(spark, text_again):
    rng = random.Random(11)
    docs = []
    for i in range(0, 1200, 3):
        words = [f"w{rng.randrange(10**9)}" for _ in range(13)]
        docs += [(i, " ".join(words)), (i + 1, " ".join(words[:-1]))]  # 10 shingles, one missing
        docs.append((i, docs[-2][1] if text_again else " ".join(f"v{rng.randrange(10**9)}" for _ in range(30))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted(((d, len(sets_of(t, 4)), d - d % 3) for d, t in docs), key=str)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1cé \U0001f600", max_size=40))
def test_gram_sets_have_the_right_size(text):
    assert len(jaccard.gram_set(text, 4)) == len(sets_of(text, 4))


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 400)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)] + [(3, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-1]:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    got = {r["id"]: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: top(x) for x in parent if any(x in link and link[0] != link[1] for link in links)} == got


def thue_morse(letters, n):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_patterned_words_do_not_collide(spark):
    """Words that a polynomial modulo a power of two cannot tell apart."""
    pairs = [(thue_morse("ab", n), thue_morse("ba", n)) for n in (16, 64, 128, 1024, 4096)]
    for a, b in pairs:
        assert len(set(jaccard.gram_set(f"{a} {b}", 1))) == 2
    docs = [(i, t) for i, t in enumerate(x for p in pairs for x in p)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 1 for r in got)
    assert len(set(jaccard.gram_set("A" * 70 + " " + "a" * 70 + " ab AB aB a b", 1))) == 4
