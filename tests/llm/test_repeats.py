"""Suffix dedup against a dictionary of all strings, and its parts."""

import hashlib
import random

import numpy as np
import pytest

from contactloom.llm import repeats

SCHEMA = "doc_id long, text string, part string, n_bytes long"


def brute(docs, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)}; ids are distinct."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        data = (text or "").encode()
        cover = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                cover[s : s + length] = True
            seen.add(piece)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[doc] = (len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    docs = [(i, prose(rng.randint(1, 80))) for i in range(40)]
    docs += [(100 + i, prose(10) + shared + prose(10)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "a" * 700), (203, "a" * 99), (204, "ab" * 300), (205, docs[3][1]), (206, docs[41][1]), (207, docs[41][1])]
    near = docs[45][1].split()
    for i in range(15):
        copy = list(near)
        copy[rng.randrange(len(copy))] = word()
        docs.append((300 + i, " ".join(copy)))
    docs += [(400, prose(4000)), (401, shared + shared), (None, shared[:150])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("settings", [{}, {"WIDE": 2, "SHARD_BYTES": 400, "BUCKET_BYTES": 3000, "PIECE": 700, "PART_BYTES": 3000}])
def test_equals_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(repeats, name, value)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    rows = repeats.remove_repeats(df).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(docs)
    # with other sizes the tasks on executors keep the module's, the driver's ones change
    assert found == brute(docs)
    texts = dict(docs)
    for r in rows:
        if r.kept is not None:
            data, gone = (texts[r.doc_id] or "").encode(), set()
            for span in r.removed:
                gone.update(range(span.start, span.end))
            assert bytes(r.kept) == bytes(b for i, b in enumerate(data) if i not in gone)


def test_repeated_rows_and_empty_table(spark):
    text = "x y z " * 60
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect())
    # rows equal in id and text get equal results: what repeats within the text
    assert got[0] == got[1] and got[0][1] > 0 and got[2] == (2, len(text))
    assert repeats.remove_repeats(df.where("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, length=10)


def test_merge_equals_sorting_all_suffixes():
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    texts = [base[i : i + rng.randint(100, 160)] for i in range(0, 240, 7)]
    n = len(texts)
    doc, row, start = np.arange(n) % 9, np.arange(n), np.array([rng.randrange(1000) for _ in range(n)])
    for shard in (150, 1000, 10**6):
        repeats_shard, repeats.SHARD_BYTES = repeats.SHARD_BYTES, shard
        try:
            segment, offset = repeats.repeated_starts(texts, doc, row, start, 100)
        finally:
            repeats.SHARD_BYTES = repeats_shard
        groups = {}
        for i, t in enumerate(texts):
            for o in range(len(t) - 99):
                groups.setdefault(t[o : o + 100], []).append((doc[i], row[i], start[i] + o, i, o))
        want = {m[3:] for g in groups.values() for m in sorted(g)[1:]}
        assert set(zip(segment.tolist(), offset.tolist(), strict=True)) == want


def test_shard_order_is_suffix_order():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"a\0b") for _ in range(rng.randint(100, 130))) for _ in range(12)]
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    shard = repeats.Shard(data, begins, begins + sizes, np.zeros(len(data), np.uint16), 4, 0)
    suffixes = {b + o: t[o:] for b, t in zip(begins, texts, strict=True) for o in range(len(t) + 1)}
    want = sorted(suffixes, key=lambda p: (suffixes[p], p))
    assert shard.order.tolist() == want


def test_segments_of_joined_texts():
    """Texts hashed together have the segments that they have on their own."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 5, 99, 100, 101, 3000, 150, 0, 70_000, 130)]
    together = repeats.segments(texts, 100)
    alone = [repeats.segments([t], 100) for t in texts]
    of = np.concatenate([np.full(len(x[0]), i) for i, x in enumerate(alone)])
    # where a long text is cut into pieces may differ; starts and their strings' anchors may not
    def starts(segs, of):
        return {(int(t), int(s) + k, int(a)) for t, a, s, c in zip(of, segs[1], segs[3], segs[4], strict=True) for k in range(int(c))}
    assert starts(together, together[0]) == starts([np.concatenate(c) for c in zip(*alone, strict=True)], of)
    assert len(starts(together, together[0])) == sum(max(0, len(t) - 99) for t in texts)
