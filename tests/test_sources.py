"""Readers and sinks on hand-made files."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from contactloom.operators import sequence as Q
from contactloom.operators import contacts as C
from contactloom.plans import q_sources
from contactloom.sources import readers as S
from contactloom.sources import writers as K


def write(path, text):
    path.write_text(text)
    return str(path)


def test_contacts_divide_only_counts(spark, tmp_path):
    coeff = S.read_norm_coefficient(spark, write(tmp_path / "k.txt", "cell_type\tcoeff\tmedian\tstd\nK562\t10\t9\t1\n"))
    with gzip.open(tmp_path / "chr1.5MB.contacts.gz", "wt") as f:
        f.write("0\t5000\t20\n0\t10000\tNaN\n5000\t5000\t\n")
    write(tmp_path / "chr2.5MB.oe.txt", "0\t5000\t20\n")
    df = S.read_contacts(spark, [str(tmp_path / "chr1.5MB.contacts.gz"), str(tmp_path / "chr2.5MB.oe.txt")], coeff)
    got = {(r.chr, r.contact_en): (r.contact_count, r.dist) for r in df.collect() if not math.isnan(r.contact_count)}
    assert got == {("chr1", 5000): (2.0, 5000), ("chr2", 5000): (20.0, 5000)}


def test_peaks_with_comments_and_duplicates(spark, tmp_path):
    path = write(tmp_path / "p.bed", "#header\nchr1\t10\t21\ta\t0\t.\t5.5\nchr1\t10\t21\ta\t0\t.\t5.5\nchr1\t30\t40\tb\t0\t.\t1\n")
    got = sorted((r.start, r.end, r.sigVal, r.mids) for r in S.read_peaks(spark, path).collect())
    assert got == [(10, 21, 5.5, 15), (30, 40, 1.0, 35)]


def test_genes_are_checked_and_prefixed(spark, tmp_path):
    head = "Gene name\tst\ten\tchrom\tFPKM\n"
    names = {"Gene name": "gene", "st": "start", "en": "end", "chrom": "chr", "FPKM": "sigVal"}
    good = write(tmp_path / "g.tsv", head + "A\t1\t9\t1\t2.5\nB\t4\t8\tX\t0\n")
    assert sorted((r.chr, r.gene) for r in S.read_genes(spark, good, names).collect()) == [("chr1", "A"), ("chrX", "B")]
    bad = write(tmp_path / "b.tsv", head + "A\t9\t1\t1\t2.5\n")
    with pytest.raises(Exception, match="ends before"):
        S.read_genes(spark, bad, names).collect()


def test_loops_between_chromosomes_are_refused(spark, tmp_path):
    head = "chr1\tx1\tx2\tchr2\ty1\ty2\n"
    good = write(tmp_path / "l.tsv", head + "1\t0\t5\t1\t50\t55\n1\t0\t5\t1\t50\t55\n")
    rows = S.read_loops(spark, good).collect()
    assert [(r.chr, r.x1, r.y2) for r in rows] == [("chr1", 0, 55)] and rows[0].id is not None
    with pytest.raises(Exception, match="two chromosomes"):
        S.read_loops(spark, write(tmp_path / "x.tsv", head + "1\t0\t5\t2\t50\t55\n")).collect()


def test_line_numbers_across_blocks(spark, tmp_path):
    path = write(tmp_path / "chr7.cells.25K.txt", "\n".join(["nan" if i == 3 else str(i) for i in range(2000)]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = S.read_eigenvector(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2000
    assert all(r.E1 == (0 if r.bin == 3 else r.bin) for r in rows)
    assert {(r.chr, r.binsize) for r in rows} == {("chr7", 25_000)} and min(r.mid for r in rows) == 12_500


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "g.fa", ">1 first\nACGTN\nacg\n\n>2\nTTTT\n>3\nGG\n")
    blocks = Q.sequence_blocks(S.read_lines(spark, path), exclude=["3"], rename={"1": "chr1"})
    assert sorted(tuple(r) for r in blocks.select("chr", "block_start", "seq").collect()) == [("2", 0, "TTTT"), ("chr1", 0, "ACGTN"), ("chr1", 5, "acg")]
    assert {r.chr: r.size for r in Q.sequence_sizes(blocks).collect()} == {"chr1": 8, "2": 4}
    region = spark.createDataFrame([("chr1", 3, 7)], "chr string, start bigint, end bigint")
    assert [r.seq for r in Q.sequence_regions(blocks, region).collect()] == ["TNac"]
    assert [r.c for r in spark.range(1).select(Q.encode(F.lit("ATGCNa")).alias("c")).collect()] == ["012340"]
    bins = {(r.chr, r.bin): r.total for r in Q.code_bins(blocks, 4).collect()}
    assert bins == {("chr1", 0): 0 + 3 + 2 + 1, ("chr1", 1): 4 + 0 + 3 + 2, ("2", 0): 4}


def test_manifest_skips_empty_rows(spark, tmp_path):
    path = write(tmp_path / "m.csv", "CTCF;a.bed;DB;1\n;;;\n;;;\nRAD21;b.bed;DB;2\n")
    assert [m["name"] for m in S.read_manifest(spark, path)] == ["CTCF", "RAD21"]


def test_first_line_of_a_pair_wins(spark, tmp_path):
    path = write(tmp_path / "oe", "5000 0 1.5\n0 5000 9\n0 50000 3\n0 900000 4\n")
    pairs = spark.createDataFrame([("c", 0, 1), ("c", 0, 180)], "chr string, i bigint, j bigint")
    assert sorted(tuple(r) for r in S.read_oe_pairs(spark, path, "c", 5000, pairs).collect()) == [("c", 0, 1, 1.5), ("c", 0, 180, 4.0)]
    assert [tuple(r) for r in S.read_oe_pairs(spark, path, "c", 5000, pairs, reach=100).collect()] == [("c", 0, 1, 1.5)]


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    folder = tmp_path / "chr1.oe"
    folder.mkdir()
    rows = [f"{(i * 7 % 400) * 5000} {(i * 7 % 400 + 3) * 5000} {i} {i + 0.5}" for i in range(2000)]
    for k in range(4):
        write(folder / f"part-0000{k} %20", "\n".join(rows[k * 500 : (k + 1) * 500]) + "\n")
    pairs = spark.createDataFrame([("chr1", i, i + 3) for i in range(400)], "chr string, i bigint, j bigint")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        first = S.read_oe_pairs(spark, str(folder), None, 5000, pairs).collect()
        last = S.read_model_pairs(spark, str(folder), None, 5000).collect()
        lines = S.read_lines(spark, str(folder))
        assert sorted(r.line for r in lines.collect()) == sorted([*range(500)] * 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    place = {i * 7 % 400: i for i in range(400)}
    assert {r.i: r.value for r in first} == place and len(first) == 400
    assert {r.i: (r.observed, r.predicted) for r in last} == {b: (i + 1600, i + 1600.5) for b, i in place.items()}
    # the lines are neither sorted nor shuffled: only the small side of the join is
    assert "Window" not in lines._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_pair_files_are_written_in_ranges(spark, tmp_path):
    q_sources._pair_lines(spark, "/root/testdata/sf0.001", str(tmp_path / "pairs"), ["contact_count"])
    folders = [f for f in (tmp_path / "pairs").iterdir() if f.is_dir()]
    assert len(folders) == 5
    # several tasks wrote, and no line of a later file goes before one of an earlier file
    assert len({f.name[:10] for d in folders for f in d.glob("part-*")}) > 5
    for folder in folders:
        starts = [[int(line.split()[1]) for line in f.read_text().splitlines()] for f in sorted(folder.glob("part-*"))]
        joined = [x for s in starts for x in s]
        assert sum(a > b for a, b in zip(joined, joined[1:])) == 1


def test_expected_values_keep_their_chromosome(spark, tmp_path):
    paths = [write(tmp_path / "chr1.expected.txt", "8\nnan\n"), write(tmp_path / "chr2.expected.txt", "2\n1\n")]
    expected = S.read_expected(spark, paths, 5000)
    contacts = spark.createDataFrame([("chr1", 0, 1.5), ("chr2", 5000, 4.0)], "chr string, dist bigint, contact_count double")
    got = sorted((r.chr, r.observed) for r in C.to_observed(contacts, expected, 2).collect())
    assert got == [("chr1", 6.0), ("chr2", 2.0)]
    with pytest.raises(ValueError, match="several rows"):
        C.to_observed(contacts, expected.unionByName(expected), 2).collect()


def test_predictors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 0, 50, 50, 2.0, None), ("chr2", 5, 50, 45, 1.0, 7.0)], "chr string, contact_st bigint, contact_en bigint, contact_dist bigint, contact_count double, X double")
    K.write_predictors(df, str(tmp_path / "t"), "csv")
    back = S.read_predictors(spark, str(tmp_path / "t"))
    assert back.columns == df.columns and sorted(r.X for r in back.collect()) == [0.0, 7.0]


def test_signal_keeps_nan(spark, tmp_path):
    path = write(tmp_path / "s.bg", "c\t0\t10\t2\nc\t10\t20\tNaN\n")
    runs = S.read_signal(spark, path)
    region = spark.createDataFrame([("c", 5, 15)], "chr string, start bigint, end bigint")
    got = sorted((r.start, r.end, str(r.value)) for r in Q.clip_runs(runs, region).collect())
    assert got == [(5, 10, "2.0"), (10, 15, "nan")]


def test_files_of_different_resolution_are_told(spark, tmp_path):
    (tmp_path / "chr1.contacts").write_text("".join(f"{i * 5000}\t{i * 5000 + 10000}\t1\n" for i in range(5)))
    (tmp_path / "chr2.contacts").write_text("".join(f"{i * 25000}\t{i * 25000 + 50000}\t1\n" for i in range(5)))
    one, both = str(tmp_path / "chr1.contacts"), [str(tmp_path / f"chr{i}.contacts") for i in (1, 2)]
    assert S.read_contacts(spark, one, check_bins=True).count() == 5 and S.same_bin_size(S.read_contacts(spark, one)) == 5000
    with pytest.raises(ValueError, match="bin size"):
        S.read_contacts(spark, both, check_bins=True)


def test_tasks_of_pair_files_grow_with_their_size(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("concat('0 c ', id * 5000, ' 0 0 c ', id * 5000, ' 0 ', id) AS value").write.text(str(tmp_path / "pre"))
    spark.range(2000).selectExpr("concat(id * 5000, ' ', id * 5000, ' ', id, ' ', id) AS value").write.text(str(tmp_path / "c.oe"))
    wanted = spark.range(2000).selectExpr("'c' AS chr", "id AS i", "id AS j")
    monkeypatch.setattr(S, "TASK_BYTES", 2_000)
    for df in (S.read_pre(spark, str(tmp_path / "pre"), 5000), S.read_model_pairs(spark, str(tmp_path / "c.oe"), None, 5000), S.read_oe_pairs(spark, str(tmp_path / "c.oe"), None, 5000, wanted)):
        assert df.rdd.getNumPartitions() > 8 and df.count() == 2000


def test_regions_hold_no_bases_in_memory(spark, monkeypatch):
    """Bases stream past the regions that a task holds, and tasks grow with the regions; pieces are those of plain slices."""
    monkeypatch.setattr(Q, "HELD", 50)
    rng = random.Random(4)
    texts = {f"c{i}": "".join(rng.choice("acgtn") for _ in range(n)) for i, n in enumerate((0, 1, 59, 256, 257, 5000, 9000))}
    whole = spark.createDataFrame(list(texts.items()), "chr string, seq string")
    spans = [(c, s, s + n) for c, t in texts.items() for s, n in [(rng.randrange(-20, len(t) + 20), rng.choice((0, 1, 30, 240, 3000))) for _ in range(40)]]
    spans += [("c5", s, s + n) for s, n in ((0, 0), (256, 0), (255, 1), (256, 1), (0, 5000), (4999, 9), (5000, 9), (-9, 9), (4096, 0))]
    regions = spark.createDataFrame([(c, s, e, i) for i, (c, s, e) in enumerate(spans + spans[:5])] + [("none", 0, 9, -1), (None, 0, 9, -2)], "chr string, start long, end long, id int")
    for size in (60, 4096):
        found = Q.sequence_regions(Q.split_blocks(whole, size), regions)
        plan = found._jdf.queryExecution().executedPlan().toString()
        tasks = -(-regions.count() // 50)
        assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2 and "ShuffledHashJoin" in plan
        got = {r["id"]: (r["start"], r["end"], r["seq"]) for r in found.collect()}
        for i, (c, s, e) in enumerate(spans + spans[:5]):
            if min(e, len(texts[c])) > max(s, 0):
                assert got.pop(i) == (s, e, texts[c][max(s, 0) : e])
        # what is left meets a block without sharing a base
        assert all(seq == "" and end - start <= 0 or texts[spans[i % len(spans)][0]] == "" for i, (start, end, seq) in got.items())
