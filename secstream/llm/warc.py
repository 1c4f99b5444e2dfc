"""WARC archives through a chunked record table.

A payload becomes rows (record key, chunk number, data) of at most CHUNK bytes, each with the SHA-256 of the
payload up to its end: the digest is carried along, so no step has to hold a record to know its digest. The
table is written once; everything else reads its columns as needed.

Records with equal payloads of at least SMALL bytes share one response, the one with the smallest id; the
others are revisits of it. Archives are written by Spark's text writer, whose commit protocol makes a lost or
repeated task harmless. A record of one chunk is one WARC record; longer payloads are segmented, as the WARC
standard has it, into a first record and continuations. Each (segment) record is one line to the writer, and
the blank lines that end a WARC record are its line separator.

Reading splits archives at the WARC magic, streaming, whatever the size of the file; no segment's block holds the
magic, because the chunker cuts inside it. Single records are digested where they are read; the segments
of longer ones are shuffled, put in order and digested one after the other with a running SHA-256.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import table
from secstream.session import materialise, work_dir

CHUNK = 64 << 10
#: Payloads below this many bytes are not worth a revisit.
SMALL = 100
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
TYPE_HTTP = "application/http; msgtype=response"

CHUNK_SCHEMA = "_record long, page_id long, url string, chunk_no long, data binary, sha256_so_far string, payload_bytes long, last boolean"


def cut_points(data: memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of the chunks; an empty payload is one empty chunk.

    A chunk never holds the WARC magic, nor the part of it that the blank lines behind a block would complete.
    """
    magic, n, at = MAGIC.strip().encode(), len(data), 0
    while True:
        end = min(at + size, n)
        found = bytes(data[at:end]).find(magic)
        if found >= 0:
            end = at + found + 4
        yield at, end
        at = end
        if at >= n:
            return


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The written chunk table of ``pages`` (page_id, url, html).

    _record numbers the rows of the input, so that repeated or null ids stay apart; a null payload is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            payloads = batch.column("payload")
            for k, (record, page_id, url) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_record", "page_id", "url")), strict=True)):
                buffer = payloads[k].as_buffer()
                data, sha = memoryview(buffer if buffer is not None else b""), hashlib.sha256()
                for number, (a, b) in enumerate(cut_points(data, size)):
                    sha.update(data[a:b])
                    rows.append((record, page_id, url, number, bytes(data[a:b]), sha.hexdigest(), b, b == len(data)))
                    held += b - a
                    if held >= 16 * size:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    named = pages.select(
        F.monotonically_increasing_id().alias("_record"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    written = f"{work_dir(pages.sparkSession)}/warc-chunks-{uuid.uuid4().hex}"
    named.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "zstd").parquet(written)
    return pages.sparkSession.read.schema(CHUNK_SCHEMA).parquet(written)


def record_types(chunks: DataFrame, small: int = SMALL) -> DataFrame:
    """(_record, _type, _refers, _digest, _size, _chunks) of every record of a chunk table.

    Equal payloads are told by size and digest. Rows that share the smallest id are all responses; ids that
    are null come last, and payloads without any id are all responses.
    """
    ends = materialise(chunks.filter("last").select("_record", "page_id", F.col("sha256_so_far").alias("_digest"), F.col("payload_bytes").alias("_size"), (F.col("chunk_no") + 1).alias("_chunks")), "warc-records")
    first = ends.filter(F.col("_size") >= small).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    # written, so that both sides of the join are plain exchanges and a hot payload can be split
    joined = ends.join(materialise(first.select("_digest", "_first"), "warc-first"), "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("_record", F.when(again, "revisit").otherwise("response").alias("_type"), F.when(again, F.col("_first")).alias("_refers"), "_digest", "_size", "_chunks")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def warc_lines(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """One line per WARC record or segment: magic, headers, blank line, block. Revisits have no payload."""
    rows = chunks.join(types, "_record").filter("_type = 'response' OR chunk_no = 0").sortWithinPartitions("_record", "chunk_no")
    first, segmented = F.col("chunk_no") == 0, (F.col("_type") == "response") & (F.col("_chunks") > 1)
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit(END))).otherwise(F.lit(""))
    block = F.concat(http.cast("binary"), F.when(F.col("_type") == "response", F.col("data")).otherwise(F.lit(b"")))
    urn = lambda record, number: F.concat(F.lit("<urn:x-page-record:"), record.cast("string"), F.lit(":"), number.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(first, F.col("_type")).otherwise("continuation")),
        _header("WARC-Record-ID", urn(F.col("_record"), F.col("chunk_no"))),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        _header("WARC-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        _header("WARC-Profile", F.when(F.col("_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To-Page-ID", F.col("_refers")),
        _header("WARC-Segment-Number", F.when(segmented, F.col("chunk_no") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(segmented & ~first, urn(F.col("_record"), F.lit(0)))),
        _header("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("_size") + F.octet_length(_http_head(F.col("_size"))))),
        _header("Content-Type", F.when(first, F.lit(TYPE_HTTP))),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def _http_head(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))


def write_warc(pages: DataFrame, path: str, size: int = CHUNK, small: int = SMALL, compression: str = "gzip") -> None:
    """Write a WARC record for every row of ``pages`` (page_id, url, html) under ``path``."""
    chunks = chunk_table(pages, size)
    warc_lines(chunks, record_types(chunks, small)).write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each WARC record or segment of the archives under ``path``: the headers and the block.

    A block that is shorter or longer than its Content-Length is an error.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).filter("value <> ''")
    cut = lines.select(F.substring_index("value", END, 1).alias("_head"), F.col("value").cast("binary").alias("_all"))
    of = lambda name: F.nullif(F.regexp_extract("_head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    length = of("Content-Length").cast("long")
    start = F.octet_length("_head") + len(END)
    out = cut.select(
        of("WARC-Record-ID").alias("record_id"),
        of("WARC-Type").alias("type"),
        of("WARC-Page-ID").cast("long").alias("page_id"),
        of("WARC-Target-URI").alias("url"),
        F.substring_index(of("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        of("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        of("WARC-Segment-Number").cast("long").alias("segment"),
        of("WARC-Segment-Origin-ID").alias("origin"),
        of("WARC-Segment-Total-Length").cast("long").alias("total_length"),
        F.expr(f"substring(_all, cast(octet_length(_head) + {len(END)} + 1 AS int), cast(regexp_extract(_head, '(?:^|\\r\\n)Content-Length: ([0-9]+)', 1) AS int))").alias("block"),
        (F.octet_length("_all") - start - length).alias("_rest"),
        length.alias("_length"),
    )
    sound = (F.octet_length("block") == F.col("_length")) & (F.col("_rest") == len(END))
    return out.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("broken WARC record "), F.coalesce("record_id", F.lit("?"))))).cast("binary")).drop("_rest", "_length")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in read records.

    The digest of a response is computed anew from its payload and must equal the one it carries.
    """
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    body = F.expr(f"substring(block, cast(octet_length(substring_index(cast(block AS string), '{END}', 1)) + {len(END)} + 1 AS int))")
    size = F.regexp_extract(F.substring_index(F.col("block").cast("string"), END, 1), r"Content-Length: ([0-9]+)", 1).cast("long")
    whole = records.filter("segment IS NULL")
    single = whole.filter("type = 'response'").select("page_id", (F.octet_length("block") - http).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("_found"), "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = whole.filter("type = 'revisit'").select("page_id", size.alias("payload_bytes"), F.col("payload_digest").alias("_found"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, sha, size, number, head = None, None, 0, 0, None

        def done() -> tuple:
            return head[0], size, sha.hexdigest(), head[1], "response", None

        for batch in batches:
            out = []
            blocks = batch.column("block")
            for k, (o, segment, page_id, digest, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_origin", "segment", "page_id", "payload_digest", "total_length")), strict=True)):
                data = memoryview(blocks[k].as_buffer())
                if o != origin:
                    if segment != 1:
                        raise ValueError(f"WARC record {o} lacks its first segment")
                    origin, sha, size, number, head = o, hashlib.sha256(), 0, 0, (page_id, digest)
                    at = bytes(data[:4096]).index(END.encode()) + len(END)
                    start, data = at, data[at:]
                number += 1
                if segment != number:
                    raise ValueError(f"WARC record {o} lacks segment {number}")
                sha.update(data)
                size += len(data)
                if total is not None:
                    if size + start != total:
                        raise ValueError(f"WARC record {o} has {size + start} bytes, not {total}")
                    out.append(done())
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "_found", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    parts = records.filter("segment IS NOT NULL").select(F.coalesce("origin", "record_id").alias("_origin"), "segment", "page_id", "payload_digest", "total_length", "block")
    ordered = parts.repartition("_origin").sortWithinPartitions("_origin", "segment")
    long = ordered.mapInArrow(run, "page_id long, payload_bytes long, _found string, payload_digest string, record_type string, refers_to long")
    every = single.union(again).union(long)
    checked = F.when(F.col("_found") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs on page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))).cast("string"))
    return every.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, path: str, size: int = CHUNK, small: int = SMALL, compression: str = "gzip") -> DataFrame:
    """Write ``pages`` to WARC archives under ``path``, read them back and return ``page_records``.

    Null payloads are empty; null ids and urls are left out of the headers and come back as null; repeated rows
    are written and returned again; other columns are ignored; an empty table gives an empty archive.
    """
    write_warc(pages, path, size, small, compression)
    return page_records(read_warc(pages.sparkSession, path))


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), f"{work_dir(spark)}/warc-{uuid.uuid4().hex}")


ORACLE = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {SMALL} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
