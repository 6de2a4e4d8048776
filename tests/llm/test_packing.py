"""Packing: round trips, the tree against a linear search, and the two encoders against each other."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactloom.llm import packing
from contactloom.llm.settings import byte_bpe

VOCABULARY, RANKS = byte_bpe()


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|> a", "x" * 5000, "été Œuvre 日本 \U0001f600", "tie tie", "tie tie"] + [" ".join(rng.choice(["the", "Été", "42", "zz\n"]) for _ in range(rng.randint(0, 900))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 2)], "doc_id long, text string, offset int").repartition(2)
    rows = packing.pack(df, VOCABULARY, length=64, group_tokens=2000, ranks=RANKS).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces]).tolist()[:-1]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == want
        assert {r.doc_tokens for r in pieces} == {len(want)}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces]).tolist()[:-1]
        assert sum(n for _, n in pieces) <= 64
    assert sum(r.length for r in rows) > 0.9 * 64 * len(sequences)
    assert packing.pack(df.where("doc_id > 9999"), VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tree_finds_the_tightest_sequence(lengths):
    rooms, want = [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [r for r in rooms if r >= lengths[i]]
        if not fit:
            rooms.append(50)
            fit = [50]
        rooms[len(rooms) - 1 - rooms[::-1].index(min(fit))] -= lengths[i]
        want[i] = min(fit)
    got = packing.best_fit_decreasing(lengths, 50)
    # which of equally tight sequences is taken is free; how tight it is isn't
    assert [50 - offset for _, offset in got] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ranks_give_the_ids_of_the_vocabulary(text):
    assert quick([text]) == slow([text])


quick, slow = packing.encoder(VOCABULARY, RANKS), packing.encoder(VOCABULARY, None)


def test_ranks_give_the_ids_of_whole_tables(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    assert quick(texts) == slow(texts)


def test_query_digest(spark):
    from contactloom.llm.queries import QUERIES

    rows = QUERIES["op10_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_added_tokens_in_a_text():
    from tokenizers import Tokenizer

    from contactloom.llm.settings import byte_bpe

    vocabulary, ranks = byte_bpe()
    texts = ["<|endoftext|> hello", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext", "é <|endoftext|>\n", "日本 <|endoftext|> x", "plain"]
    plain = Tokenizer.from_file(vocabulary)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0][0] == 50256
    assert packing.encoder(vocabulary, ranks)(texts) == expected == packing.encoder(vocabulary, None)(texts)
