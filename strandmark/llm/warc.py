"""Operator 5, WARC archives with a two-level capture index.

write_archives: tasks write gzip-member WARC files to the shared folder under names of their
own attempt and return a capture row for each record; only the rows of committed attempts are
kept, so a lost executor leaves at most an orphan file. Of records with equal payloads of at
least MIN_REVISIT bytes the one with the largest page_id is the response, others revisit it.
build_index: captures are range-partitioned and sorted by reversed-host URL key; each task
writes compressed blocks of BLOCK lines to an index file with a sparse directory beside it
(first key, offset and length of each block) and returns one row with its key range.
lookup: keys are binary-searched in the list of ranges (one row a file), then in the file's
directory; the blocks found are dealt to tasks, each range-reads its block, binary-searches
its lines and range-reads the records. A key with a third of all captures is many blocks.

Defined cases: a null html is an empty payload; a null url has the empty key; a null page_id
never wins against another and is archived as an empty field; rows with the same payload and
the same largest page_id are all responses; repeated rows give one record each; an empty table
gives no files and no rows; a payload of any length is one record; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_path, path_of, read_blocks, small_batches, spark_schema

MIN_REVISIT = 1000
#: the rows of a digest that occurs often meet its newest id in so many places
SALTS = 16
BLOCK = 1000
#: a task starts another archive file beyond this size
ARCHIVE_BYTES = 1 << 30
#: captures that a task reads back
CAPTURES_A_TASK = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SHARDS = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("n", pa.int64())])
PLACES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def clean_url(url: str | None) -> str:
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")


@functools.lru_cache(100_000)
def surt(url: str | None) -> str:
    """Reversed-host key: no scheme, port, leading www. or fragment; host parts from the top domain down, then path and query."""
    text = clean_url(url)
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return text.lower()
    if not host and not parts.path:
        return ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


# ------------------------------------------------------------------ records


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, with CRLFs; refers_to is None for a response."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_url(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; the digest of a response's payload is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI", ""), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def _gzip(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(data)


# ------------------------------------------------------------------ writing


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row; the capture table (key, page_id, file, offset, length)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    again = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "newest")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(again, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            got: list[list] = [[], [], [], [], []]
            for page_id, url, html, digest, refers_to in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = _gzip(record(page_id, url, html.encode(), digest, refers_to))
                out.write(data)
                for x, v in zip(got, (surt(url), page_id, name, at, len(data)), strict=True):
                    x.append(v)
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, CAPTURES, strict=True)], schema=CAPTURES)
        if out is not None:
            out.close()

    captures = materialize(rows.mapInArrow(run, spark_schema(CAPTURES)), "captures")
    return captures.select("key", "page_id", F.concat(F.lit(folder + "/"), "file").alias("file"), "offset", "length")


def build_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """Write index files and directories; the list of their key ranges, one row a file."""
    spark = captures.sparkSession
    folder = new_path(spark, "index")
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        name, out, at, n, entries, held, last = f"part-{uuid.uuid4().hex}", None, 0, 0, [], [], ""

        def flush():
            nonlocal at
            data = _gzip("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode())
            out.write(data)
            entries.append([held[0][0], held[-1][0], at, len(data)])
            at += len(data)
            held.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in CAPTURES.names), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                held.append(list(row))
                last, n = row[0], n + 1
                if len(held) == block:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with files.open_output_stream(f"{base}/{name}.idx", compression=None) as d:
                d.write(json.dumps(entries).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((entries[0][0], last, name, n), SHARDS, strict=True)], schema=SHARDS)

    shards = materialize(ordered.select(*CAPTURES.names).mapInArrow(run, spark_schema(SHARDS)), "index-ranges")
    return shards.withColumn("folder", F.lit(folder))


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """All captures of the (distinct) keys, read from the archives."""
    spark = keys.sparkSession
    ranges, folder = path_of(index), index.select("folder").limit(1).collect()
    folder = folder[0][0] if folder else ""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        shards = sorted((r["first"], r["last"], r["file"]) for b in read_blocks(ranges, SHARDS.names) for r in b.to_pylist()) if folder else []
        lasts = [s[1] for s in shards]

        @functools.lru_cache(8)
        def directory(name):
            with files.open_input_file(f"{base}/{name}.idx") as f:
                entries = json.loads(f.read())
            return [e[1] for e in entries], entries

        for b in batches:
            got: list[list] = [[], [], [], []]
            for key in b.column("key").to_pylist():
                for k in range(bisect.bisect_left(lasts, key), len(shards)):
                    if shards[k][0] > key:
                        break
                    ends, entries = directory(shards[k][2])
                    for e in range(bisect.bisect_left(ends, key), len(entries)):
                        if entries[e][0] > key:
                            break
                        for x, v in zip(got, (shards[k][2], entries[e][2], entries[e][3], key), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, PLACES, strict=True)], schema=PLACES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        archives: dict = {}

        def record_at(uri, offset, length):
            if uri not in archives:
                if len(archives) >= 64:
                    archives.pop(next(iter(archives))).close()
                archives[uri] = filesystem(uri)[0].open_input_file(filesystem(uri)[1])
            archives[uri].seek(offset)
            return archives[uri].read(length)

        at, lines, starts = None, [], []
        for b in batches:
            out = []
            for name, offset, length, key in zip(*(b.column(c).to_pylist() for c in PLACES.names), strict=True):
                if at != (name, offset):
                    with files.open_input_file(f"{base}/{name}.cdx.gz") as f:
                        f.seek(offset)
                        lines = [json.loads(x) for x in _gunzip(f.read(length)).decode().split("\n")]
                    at, starts = (name, offset), [x[0] for x in lines]
                for k in range(bisect.bisect_left(starts, key), bisect.bisect_right(starts, key)):
                    out.append(parse(_gunzip(record_at(*lines[k][2:5]))))
                    if len(out) == 200:
                        yield pa.RecordBatch.from_pylist(out, schema=RECORDS)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=RECORDS)

    small_batches(spark)
    sorted_keys = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")
    places = sorted_keys.mapInArrow(locate, spark_schema(PLACES))
    # each row is a block to read, much work for few bytes: a fixed number of partitions, which AQE leaves alone
    captures = index.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures // CAPTURES_A_TASK))
    dealt = places.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(read, spark_schema(RECORDS))


def op5_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = build_index(write_archives(pages))
    return lookup(url_keys(pages), index).drop("url", "payload")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
newest AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN newest <> page_id OR (page_id IS NULL AND newest IS NOT NULL) THEN newest END AS refers_to
FROM p LEFT JOIN newest USING (payload_digest)
"""
