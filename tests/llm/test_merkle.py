"""The Merkle manifest next to a plain one."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from contactloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves: list[str], arity: int):
    """The root, and for each leaf its siblings (left, right) level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % arity
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def plain(rows, arity: int = 3):
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for _, _, leaf in sorted(by_source[s])], arity) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources], arity)
    out = []
    for s, above in zip(sources, upper, strict=True):
        for (known, doc_id, leaf), path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            proof = "".join(a + b for a, b in [*path, *above])
            out.append((doc_id if known else None, leaf, trees[s][0], root, h(proof)))
    return sorted(out, key=repr)


def told(manifest):
    rows = manifest.select("doc_id", *[merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(merkle.proof_of(F.col("path")), 256).alias("proof"), merkle.as_text(merkle.folded(F.col("leaf"), F.col("path"))).alias("folded")).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return sorted([tuple(r)[:5] for r in rows], key=repr)


def documents():
    rows = [(i, f"text {i}\n", "en", f"s{i % 5}", i) for i in range(60)]
    rows += [(None, "x", None, None, None), (None, None, None, None, 3), (7, "", "", "", 0), (7, "tie", "en", "s2", 1), (7, "tie", "en", "s2", 1)]
    rows += [(100 + i, "é" * 5000, "fr", "ß", 5000) for i in range(3)] + [(i, "one", "en", "hot", 3) for i in range(1000, 1200)]
    return rows


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_like_a_plain_tree(spark, arity):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(merkle.manifest(df, arity=arity)) == plain(rows, arity)


def test_repeated_rows_fill_several_ranges(spark):
    rows = [(1, "same", "en", "a", 4)] * 500 + [(2, "other", "en", "b", 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert told(merkle.manifest(df)) == plain(rows)
    spread = merkle.numbered(df.select("source", "doc_id"), ["source"], ["doc_id"])
    assert sorted(r["idx"] for r in spread.where("source = 'a'").collect()) == list(range(500))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == []
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "en", "t", 1)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]):
        assert told(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_other_columns_do_not_matter(spark):
    rows = documents()[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit(i) for i, c in enumerate(("idx", "n", "tree", "digest", "left", "right", "path", "leaf", "_order", "_salt", "root", "height"))})
    assert told(merkle.manifest(clashing)) == plain(rows)


def test_tampering_is_seen(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_merkle_manifest(spark, str(tmp_path))
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] >= 10}
    import zlib

    for r in out.where("doc_id >= 10").collect():
        spoiled = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in texts[r["doc_id"]]
        assert r["verified"] == (not spoiled) == (r["folded_root"] == r["root"])
    assert out.where("doc_id is null and not verified").count() == 0
