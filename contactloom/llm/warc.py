"""WARC archives with a two-level capture index.

Archives: every task writes the records of its rows, each a gzip member of its own, to one file of its
own name; the rows it returns say where each record lies. Files of a lost or repeated attempt are named by
no row, so they are never read.

Index: captures are sorted by reversed-host url key and id and cut into blocks of ``lines`` captures, each
compressed on its own. For every index file a sparse directory holds the first key, offset and size of its
blocks. A lookup sorts its keys the same way, picks the file by its first key, binary-searches the file's
directory, reads the one block (and its followers while they can hold the key), binary-searches the lines, and
fetches records by range reads. The only thing that all tasks share is one key per index file.

Files are read and written through ``pyarrow.fs``, so the folder may lie in any store that it knows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import partitions, short_batches
from contactloom.llm.url_filter import reversed_host, url_host
from contactloom.session import cut_lineage, scratch_path

CAPTURE = "key string, page_id long, file string, offset long, size long"


def opened(folder: str):
    """File system and path of a folder given as a path or a URI."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def capture_key(url: Column) -> Column:
    """``org,example,blog)/path?query`` in lower case; a url without a host is its own key, a null one is empty."""
    host = url_host(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(host == "", url).otherwise(F.concat(F.replace(reversed_host(host), F.lit("."), F.lit(",")), F.lit(")"), rest)), F.lit(""))


def classified(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is the page that a revisit repeats, else null.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is the
    response. Digests are counted first, so a payload with many copies costs one row per task there; the join
    that brings the result back to the payloads has one row per digest on its other side and can be split.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return base.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    )


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only the digest and the page it repeats."""
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": json.dumps(url or "")[1:-1],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-Id": page_id,
        "X-Payload-Bytes": len(payload),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": refers_to}
    body = b"" if revisit else payload
    head["Content-Type"], head["Content-Length"] = "text/html; charset=utf-8", len(body)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one record; raises if it is cut short."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if not first.startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is damaged")
    return fields, rest[:n]


def whole(x):
    """A number from pandas as int, None for a missing one."""
    return None if x is None or x != x else int(x)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``classified`` rows below ``folder`` and return their captures (key, page_id, file, offset, size)."""

    def run(frames):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        try:
            for frame in frames:
                rows = []
                for key, page, url, payload, digest, first in zip(*(frame[c] for c in ("key", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    if out is None:
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(record_bytes(whole(page), url, bytes(payload), digest, whole(first)), 4, mtime=0)
                    out.write(data)
                    rows.append((key, whole(page), name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "size"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return records.withColumn("key", capture_key(F.col("url"))).mapInPandas(run, CAPTURE)


def write_index(captures: DataFrame, folder: str, lines: int = 1000) -> DataFrame:
    """Write the two-level index of ``captures``; returns one row per index file (file, first)."""

    def run(frames):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name, at, block, directory, out = f"index-{uuid.uuid4().hex}", 0, [], [], None

        def flush():
            nonlocal at, block, out
            if out is None:
                out = system.open_output_stream(f"{root}/{name}.blocks", compression=None)
            data = zlib.compress("\n".join(block).encode(), 6)
            out.write(data)
            directory.append([json.loads(block[0])[0], at, len(data)])
            at, block = at + len(data), []

        for frame in frames:
            for row in zip(*(frame[c] for c in ("key", "page_id", "file", "offset", "size")), strict=True):
                block.append(json.dumps([row[0], whole(row[1]), row[2], int(row[3]), int(row[4])]))
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            with system.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pd.DataFrame({"file": [name], "first": [directory[0][0]], "blocks": [len(directory)]})

    n = partitions(captures.sparkSession)
    # the page id splits a url that repeats; sorting by code points is what Python's comparison does too
    ranged = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInPandas(run, "file string, first string, blocks long")


def lookup(keys: DataFrame, index_files: DataFrame, archive_folder: str, index_folder: str) -> DataFrame:
    """All captures of the distinct keys of ``keys`` (a column ``key``), read back from the archives.

    Returns page_id, headers (map) and content (binary) of every record found. ``index_files`` is what
    ``write_index`` returned: one short row for each file, as many as the cluster has shuffle partitions.
    """
    starts = sorted((r["first"], r["file"]) for r in index_files.collect())
    firsts = [s[0] for s in starts]

    def files(frames):
        """The files that can hold a key: from the last that starts before it to the last that starts with it."""
        for frame in frames:
            rows = [
                (key, starts[i][1])
                for key in frame["key"]
                for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))
            ]
            yield pd.DataFrame(rows, columns=["key", "file"])

    def find(frames):
        system, root = opened(index_folder)
        name, directory, blocks, data = None, [], None, None
        at, held = -1, []
        for frame in frames:
            found = []
            for key, file in zip(frame["key"], frame["file"], strict=True):
                if file != name:
                    name, at = file, -1
                    with system.open_input_file(f"{root}/{name}.directory") as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    blocks = [d[0] for d in directory]
                    data = system.open_input_file(f"{root}/{name}.blocks")
                i = max(0, bisect.bisect_left(blocks, key) - 1)
                while i < len(blocks) and blocks[i] <= key:
                    if i != at:
                        held = [json.loads(x) for x in zlib.decompress(data.read_at(directory[i][2], directory[i][1])).decode().split("\n")]
                        at = i
                    j = bisect.bisect_left(held, key, key=lambda x: x[0])
                    while j < len(held) and held[j][0] == key:
                        found.append(held[j])
                        j += 1
                    i += 1
                if len(found) >= 5000:
                    yield pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "size"]).astype({"page_id": "Int64"})
                    found = []
            yield pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "size"]).astype({"page_id": "Int64"})

    def fetch(frames):
        system, root = opened(archive_folder)
        name, file, rows, size = None, None, [], 0
        for frame in frames:
            for of, offset, n in zip(frame["file"], frame["offset"], frame["size"], strict=True):
                if of != name:
                    name, file = of, system.open_input_file(f"{root}/{of}")
                fields, content = parsed_record(gzip.decompress(file.read_at(int(n), int(offset))))
                page = fields["X-Page-Id"]
                rows.append((None if page == "None" else int(page), fields, content))
                size += len(content)
                if size >= 1 << 23:
                    yield pd.DataFrame(rows, columns=["page_id", "headers", "content"]).astype({"page_id": "Int64"})
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["page_id", "headers", "content"]).astype({"page_id": "Int64"})

    n = partitions(keys.sparkSession)
    wanted = keys.select("key").where("key is not null").distinct().mapInPandas(files, "key string, file string")
    found = wanted.repartitionByRange(n, "file", "key").sortWithinPartitions("file", "key").mapInPandas(find, CAPTURE)
    spread = found.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInPandas(fetch, "page_id long, headers map<string,string>, content binary")


def archive_and_read(pages: DataFrame, least: int = 100, lines: int = 1000) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), index them, and read every record back through the index.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, headers, content, one row for each
    input row. A null html is an empty payload; smaller payloads than ``least`` bytes are always responses;
    a null url has an empty key; a row with a null page_id is a response; of repeated rows with equal
    page_id all are responses; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    short_batches(spark)
    folder, index_folder = scratch_path(spark, "archives"), scratch_path(spark, "index")
    captures = cut_lineage(write_archives(classified(pages, least), folder))
    index_files = cut_lineage(write_index(captures, index_folder, lines))
    records = lookup(pages.select(capture_key(F.col("url")).alias("key")), index_files, folder, index_folder)
    h = F.col("headers")
    return records.select(
        "page_id",
        h["X-Payload-Bytes"].cast("long").alias("payload_bytes"),
        F.regexp_replace(h["WARC-Payload-Digest"], "^sha256:", "").alias("payload_digest"),
        h["WARC-Type"].alias("record_type"),
        h["X-Refers-To-Page"].cast("long").alias("refers_to"),
        "headers",
        "content",
    )
