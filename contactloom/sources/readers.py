"""Readers.  Every reader is one scan, whatever the number of files.

Paths may be files, globs, or folders written by Spark; gzip is read as is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.operators.contacts import add_chr_prefix
from contactloom.operators.ordered import previous_row, running_before
from contactloom.operators.tracks import midpoint
from contactloom.session import planned_bytes, tasks_for

_DOUBLE, _LONG, _STRING = T.DoubleType(), T.LongType(), T.StringType()

#: Positional columns of a narrowPeak track.
PEAK_COLUMNS = {0: "chr", 1: "start", 2: "end", 6: "sigVal"}
ORIENTATION_COLUMNS = {0: "chr", 1: "start", 2: "end", 4: "score", 5: "orientation"}
TSS_COLUMNS = {0: "chr", 1: "start", 2: "end", 5: "strand", 6: "TSS_start", 7: "TSS_end"}
_TYPES = {"start": _LONG, "end": _LONG, "TSS_start": _LONG, "TSS_end": _LONG, "sigVal": _DOUBLE, "score": _DOUBLE, "value": _DOUBLE}


def file_name() -> Column:
    """Name of the data file; of its folder where Spark wrote a part file (without a ``key=`` prefix)."""
    part = r"/part-[^/]*$"
    path = F.regexp_replace(F.col("_metadata.file_path"), part, "")
    return F.regexp_replace(F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1)), "^[^=]+=", "")


def read_positional(
    spark: SparkSession, path: str | Sequence[str], columns: Mapping[int, str], types: Mapping[str, T.DataType] | None = None
) -> DataFrame:
    """Headerless tab-separated file with ``#`` comments; chosen positions under chosen names."""
    types = {**_TYPES, **(types or {})}
    fields = [
        T.StructField(columns.get(i, f"_{i}"), types.get(columns.get(i), _STRING)) for i in range(max(columns) + 1)
    ]
    table = (
        spark.read.schema(T.StructType(fields))
        .option("recursiveFileLookup", "true")
        .csv(path if isinstance(path, str) else list(path), sep="\t", comment="#")
    )
    return table.select("*", "_metadata").select(*[columns[i] for i in columns], "_metadata")


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_metadata")


def read_norm_coefficient(spark: SparkSession, path: str) -> DataFrame:
    schema = "cell_type string, coeff bigint, median bigint, std bigint"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, sep="\t", header=True)


def read_contacts(
    spark: SparkSession, path: str | Sequence[str], coefficient: DataFrame | None = None, chrom: str | None = None, check_bins: bool = False
) -> DataFrame:
    """Contact triples of one or many files.

    The chromosome is the file name up to its first dot.  Counts of
    ``*.contacts`` files are divided by the coefficient, those of ``*.oe``
    files stay as they are.  Rows with a missing value are dropped.  With
    ``check_bins`` files of different resolutions are an error (one more pass over them).
    """
    columns = {0: "contact_st", 1: "contact_en", 2: "contact_count"}
    types = {"contact_st": _LONG, "contact_en": _LONG, "contact_count": _DOUBLE}
    raw = read_positional(spark, path, columns, types).withColumn("_file", file_name()).drop("_metadata")
    usable = raw.na.drop(subset=list(columns.values()))
    # the kind is the part before the extension; a folder written by Spark carries no extension
    kind = F.regexp_extract("_file", r"\.(contacts|oe)(?:\.[^.]*)?$", 1)
    if coefficient is None:
        scale = F.lit(1)
    else:
        # one row
        value = coefficient.agg(F.max("coeff").alias("c")).scalar()
        scale = F.when(kind == "oe", F.lit(1)).otherwise(value)
    name = F.lit(chrom) if chrom else F.regexp_extract("_file", r"^([^.]+)", 1)
    contacts = usable.select(
        name.alias("chr"),
        "contact_st",
        "contact_en",
        (F.col("contact_count") / scale).alias("contact_count"),
        (F.col("contact_en") - F.col("contact_st")).alias("dist"),
    )
    if check_bins:
        same_bin_size(contacts)
    return contacts


def same_bin_size(contacts: DataFrame) -> int:
    """The bin size of all chromosomes; chromosomes (files) of different resolutions are an error.

    As in ``bin_size``, that of a chromosome is the smallest distance between its anchors or neighbouring starts.
    """
    places = contacts.select("chr", "contact_st").distinct()
    gaps = previous_row(places, ["chr"], "contact_st", ["contact_st"], []).select("chr", (F.col("contact_st") - F.col("prev.contact_st")).alias("d"))
    spans = contacts.select("chr", (F.col("contact_en") - F.col("contact_st")).alias("d"))
    # one row per chromosome
    sizes = {r["chr"]: r["d"] for r in gaps.unionByName(spans).filter("d > 0").groupBy("chr").agg(F.min("d").alias("d")).collect()}
    if len(set(sizes.values())) != 1:
        raise ValueError(f"contacts of one bin size are needed, found {sizes}")
    return next(iter(sizes.values()))


def read_peaks(spark: SparkSession, path: str | Sequence[str], columns: Mapping[int, str] = PEAK_COLUMNS) -> DataFrame:
    """Peak track with midpoints; exact duplicate rows dropped, orientation not yet known (0)."""
    track = _plain(read_positional(spark, path, columns)).dropDuplicates()
    none = F.lit(0.0)
    return track.withColumns({"mids": midpoint(), "plus_orientation": none, "minus_orientation": none})


def read_orientation(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _plain(read_positional(spark, path, ORIENTATION_COLUMNS)).dropDuplicates()


def _checked(df: DataFrame, good: Column, message: str) -> DataFrame:
    """Fails at run time on the first row that breaks ``good``."""
    return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(message)).isNull()))


def read_genes(spark: SparkSession, path: str | Sequence[str], rename: Mapping[str, str] | None = None, prefix: bool = True) -> DataFrame:
    """Gene table with a header; ``rename`` maps its columns to chr, start, end, sigVal, gene."""
    table = spark.read.option("recursiveFileLookup", "true").csv(path if isinstance(path, str) else list(path), sep="\t", header=True)
    named = table.withColumnsRenamed(dict(rename or {})).select(
        "chr", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("sigVal").cast("double").alias("sigVal"), "gene"
    )
    named = add_chr_prefix(named) if prefix else named
    named = _checked(named, F.col("end") > F.col("start"), "a gene ends before it starts")
    return named.dropDuplicates().withColumn("mids", midpoint())


def read_tss(spark: SparkSession, path: str | Sequence[str], columns: Mapping[int, str] = TSS_COLUMNS, prefix: bool = True) -> DataFrame:
    table = _plain(read_positional(spark, path, columns))
    table = add_chr_prefix(table) if prefix else table
    table = _checked(table, F.col("end") > F.col("start"), "an entry ends before it starts")
    site = F.when(F.col("strand") == "+", F.col("TSS_start")).when(F.col("strand") == "-", F.col("TSS_end"))
    return table.withColumn("TSS", site).dropDuplicates().withColumn("mids", midpoint())


def _numbered(spark: SparkSession, path: str | Sequence[str], **of_block: Column) -> DataFrame:
    """(file, line, at, value, of_block) of the lines of each file: ``line`` counts from 0, ``at`` goes on from file to file.

    Spark cuts a file into blocks, and a task reads a block in order, giving rising ids.  A line's number in its block is its
    id less the first id there; the lines of earlier blocks are added from a table with one row per block, so
    no line is moved or sorted.  ``of_block`` are columns of ``file``, computed once per block.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path))
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    counts = placed.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # one row per block of a file, and one per file
    before = running_before(counts, ["file"], "_block", {"_n": "sum"}).withColumnRenamed("_n", "_before")
    files = counts.groupBy("file").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"), *[c.alias(n) for n, c in of_block.items()])
    blocks = counts.join(before, ["file", "_block"]).join(files, "file").drop("_n")
    line = F.col("_id") - F.col("_first") + F.col("_before")
    found = placed.join(F.broadcast(blocks), ["file", "_block"])
    return found.select("file", line.alias("line"), (line + F.col("_earlier")).alias("at"), "value", *of_block)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line, value): the lines of each file, numbered from 0; no file is read by a single task."""
    return _numbered(spark, path).select("file", "line", "value")


def _name_of(file: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_extract(F.regexp_replace(file, r"/part-[^/]*$", ""), r"([^/]+)$", 1)), "^[^=]+=", "")


def _number(value: Column) -> Column:
    """A number, with NaN and unreadable text as 0."""
    return F.nanvl(F.coalesce(F.trim(value).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def binsize_from_name(name: Column) -> Column:
    """Bin size from the second-last part of a dotted name, as in ``chr1.cells.25K.txt``."""
    part = F.regexp_extract(name, r"\.(\d+)([kKmM]?)\.[^.]*$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(name, r"\.(\d+)([kKmM]?)\.[^.]*$", 2))
    return part * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)


def read_eigenvector(spark: SparkSession, path: str | Sequence[str], binsize: int | None = None) -> DataFrame:
    """(chr, bin, E1, binsize, mid): one value per line; the position follows from the line number."""
    lines = read_lines(spark, path)
    name = _name_of(F.col("file"))
    size = F.lit(binsize).cast("bigint") if binsize else binsize_from_name(name)
    return lines.select(
        F.regexp_extract(name, r"^([^.]+)", 1).alias("chr"), F.col("line").alias("bin"), _number(F.col("value")).alias("E1"), size.alias("binsize")
    ).withColumn("mid", F.col("bin") * F.col("binsize") + F.floor(F.col("binsize") / 2))


def read_expected(spark: SparkSession, path: str | Sequence[str], binsize: int) -> DataFrame:
    """(chr, dist, expected): one value per distance bin, NaN as 0; the chromosome is the first part of the file name."""
    chrom = F.regexp_extract(_name_of(F.col("file")), r"^([^.]+)", 1).alias("chr")
    return read_lines(spark, path).select(chrom, (F.col("line") * binsize).alias("dist"), _number(F.col("value")).alias("expected"))


def read_loops(spark: SparkSession, path: str | Sequence[str], prefix: bool = True) -> DataFrame:
    """Loop table with a header: (id, chr, x1, x2, y1, y2); the id is a hash of the coordinates, the same on every read."""
    table = spark.read.option("recursiveFileLookup", "true").csv(path if isinstance(path, str) else list(path), sep="\t", header=True)
    coords = [F.col(c).cast("bigint").alias(c) for c in ("x1", "x2", "y1", "y2")]
    loops = table.select("chr1", "chr2", *coords)
    if prefix:
        loops = add_chr_prefix(add_chr_prefix(loops, "chr1"), "chr2")
    loops = _checked(loops, F.col("chr1") == F.col("chr2"), "a loop joins two chromosomes").dropDuplicates()
    return loops.select(
        F.xxhash64("chr1", "x1", "x2", "y1", "y2").alias("id"), F.col("chr1").alias("chr"), "x1", "x2", "y1", "y2"
    )


def read_manifest(spark: SparkSession, path: str, sep: str = ";") -> list[dict[str, str]]:
    """Rows (name, filename, database, id) of a track list; empty rows are dropped.  A list of files is small."""
    rows = spark.read.schema("name string, filename string, database string, id string").option("recursiveFileLookup", "true").csv(path, sep=sep)
    rows = rows.filter(F.col("name").isNotNull() & F.col("filename").isNotNull() & (F.col("name") != "name"))
    return [r.asDict() for r in rows.collect()]


def read_tracks(
    spark: SparkSession, manifest: Sequence[Mapping[str, str]], folder: str, columns: Mapping[int, str] = PEAK_COLUMNS
) -> DataFrame:
    """All tracks of a manifest as one table with a ``track`` column, in one scan."""
    paths = [f"{folder}/{m['filename']}" for m in manifest]
    names = F.create_map(*[F.lit(x) for m in manifest for x in (m["filename"].split("=")[-1], m["name"])])
    raw = read_positional(spark, paths, columns)
    track = names[file_name()]
    return _plain(raw.withColumn("track", track)).dropDuplicates().withColumn("mids", midpoint())


def read_chrom_sizes(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """(chr, size) from the first two columns."""
    sizes = _plain(read_positional(spark, path, {0: "chr", 1: "size"}, {"size": _LONG}))
    if rename:
        mapped = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])[F.col("chr")]
        sizes = sizes.withColumn("chr", F.coalesce(mapped, F.col("chr")))
    return sizes


def read_signal(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Runs (chr, start, end, value) of a bedGraph; NaN values stay."""
    return _plain(read_positional(spark, path, {0: "chr", 1: "start", 2: "end", 3: "value"}))


#: Types of the leading predictor columns; all others are doubles.
KEY_TYPES = {"chr": _STRING, "contact_st": _LONG, "contact_en": _LONG, "contact_dist": _LONG, "contact_count": _DOUBLE}


def available_predictors(spark: SparkSession, path: str) -> list[str]:
    """Column names of a predictor table, from its first line."""
    return spark.read.option("recursiveFileLookup", "true").text(path).first()[0].strip().split("\t")


def read_predictors(spark: SparkSession, path: str) -> DataFrame:
    """Predictor table typed by its header, missing values as 0."""
    header = available_predictors(spark, path)
    schema = T.StructType([T.StructField(c, KEY_TYPES.get(c, _DOUBLE)) for c in header])
    table = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, sep="\t", header=True)
    return table.na.fill(0)


# ---- pair files of the condition comparison -------------------------------------------------------


def _words(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path))
    return text.select(F.split(F.trim("value"), r"\s+").alias("w"))


def _whole(i: int) -> Column:
    return F.col("w")[i].cast("bigint")


def read_promoters(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """Distinct (chr, bin) of transcription starts, by strand."""
    at = F.when(F.col("w")[3] == "+", _whole(4)).otherwise(_whole(5))
    return _words(spark, path).select(F.col("w")[2].alias("chr"), F.floor(at / resolution).alias("bin")).distinct()


def read_enhancers(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """Distinct (chr, bin) of interval midpoints."""
    middle = F.floor((_whole(1) + _whole(2)) / (2 * resolution))
    return _words(spark, path).select(F.col("w")[0].alias("chr"), middle.alias("bin")).distinct()


#: Bytes of pair files whose lines are grouped in one task.
TASK_BYTES = 32 << 20


def _dealt(rows: DataFrame, path: str | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``rows`` of the files by ``keys``, in as many tasks as the files' sizes ask for: what a task groups does not grow with the input."""
    files = rows.sparkSession.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path))
    return rows.repartition(tasks_for(rows.sparkSession, planned_bytes(files), TASK_BYTES), *keys)


def _sorted_bins(lines: DataFrame, resolution: int, reach: int | None, values: dict[str, int]) -> DataFrame:
    words = lines.withColumn("w", F.split(F.trim("value"), r"\s+"))
    x, y = F.floor(_whole(0) / resolution), F.floor(_whole(1) / resolution)
    pairs = words.select(
        "chr", "at", F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), *[F.col("w")[k].cast("double").alias(n) for n, k in values.items()]
    )
    return pairs if reach is None else pairs.filter(F.col("j") - F.col("i") < reach)


def _chromosome(chrom: str | None) -> Column:
    """The given chromosome, or the first part of the file's name."""
    return F.lit(chrom) if chrom else F.regexp_extract(_name_of(F.col("file")), r"^([^.]+)", 1)


def read_oe_pairs(spark: SparkSession, path: str | Sequence[str], chrom: str | None, resolution: int, pairs: DataFrame, reach: int | None = None) -> DataFrame:
    """(chr, i, j, value) of the wanted pairs; where a pair occurs twice the first line counts.

    Without ``chrom`` the chromosome comes from the file's name.
    """
    rows = _sorted_bins(_numbered(spark, path, chr=_chromosome(chrom)), resolution, reach, {"value": 2})
    first = _dealt(rows, path, ["chr", "i", "j"]).groupBy("chr", "i", "j").agg(F.min_by("value", "at").alias("value"))
    return first.join(pairs.select("chr", "i", "j"), ["chr", "i", "j"], "left_semi")


def read_model_pairs(spark: SparkSession, path: str | Sequence[str], chrom: str | None, resolution: int, reach: int | None = None) -> DataFrame:
    """(chr, i, j, observed, predicted); where a pair occurs twice the last line counts, ``chrom`` as above."""
    rows = _sorted_bins(_numbered(spark, path, chr=_chromosome(chrom)), resolution, reach, {"observed": 2, "predicted": 3})
    return _dealt(rows, path, ["chr", "i", "j"]).groupBy("chr", "i", "j").agg(
        F.max_by("observed", "at").alias("observed"), F.max_by("predicted", "at").alias("predicted")
    )


def read_pre(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """(chr1, i, chr2, j, value) of a nine-column pair file; the last line of a pair counts."""
    lines = _numbered(spark, path).withColumn("w", F.split(F.trim("value"), r"\s+"))
    rows = lines.select(
        "at",
        F.col("w")[1].alias("chr1"),
        F.floor(_whole(2) / resolution).alias("i"),
        F.col("w")[5].alias("chr2"),
        F.floor(_whole(6) / resolution).alias("j"),
        F.col("w")[8].cast("double").alias("value"),
    )
    keys = ["chr1", "i", "chr2", "j"]
    return _dealt(rows, path, keys).groupBy(*keys).agg(F.max_by("value", "at").alias("value"))


# ---- validation of inputs -------------------------------------------------------------------------


def validate_inputs(genes: DataFrame, peak_lines: DataFrame, orientation_lines: DataFrame) -> DataFrame:
    """(check, passed, n_bad) for a gene table and the raw lines (value) of a peak and an orientation file.

    Field counts are checked on every line, not only on the first.
    """
    required = ("chr", "gene", "FPKM", "start", "end")
    missing = [c for c in required if c not in genes.columns]

    def fields(lines: DataFrame) -> DataFrame:
        body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        return body.select(F.split("value", "\t").alias("w"))

    def short(lines: DataFrame, least: int, check: str) -> DataFrame:
        bad = F.count_if(F.size("w") < least)
        return fields(lines).agg(bad.alias("n_bad")).select(F.lit(check).alias("check"), (F.col("n_bad") == 0).alias("passed"), "n_bad")

    strands = fields(orientation_lines).agg(
        (F.coalesce(F.bool_or(F.get("w", F.lit(5)) == "+"), F.lit(False))).alias("p"),
        (F.coalesce(F.bool_or(F.get("w", F.lit(5)) == "-"), F.lit(False))).alias("m"),
    )
    absent = (~F.col("p")).cast("bigint") + (~F.col("m")).cast("bigint")
    columns = genes.limit(1).agg(F.lit(len(missing)).cast("bigint").alias("n_bad"))
    return (
        columns.select(F.lit("gene_columns").alias("check"), (F.col("n_bad") == 0).alias("passed"), "n_bad")
        .unionByName(short(peak_lines, 6, "peak_fields"))
        .unionByName(short(orientation_lines, 5, "orientation_fields"))
        .unionByName(strands.select(F.lit("both_strands").alias("check"), (absent == 0).alias("passed"), absent.alias("n_bad")))
    )
