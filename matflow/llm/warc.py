"""WARC archives: writing, reading and revisit resolution.

Archives are gzipped WARC/1.1 files. They are written by Spark's text writer (a
record is one value, its last line feed the line separator), so any Hadoop file
system and its commit protocol serve, and a lost executor's attempt leaves
nothing behind. Files hold a bounded number of records (``FILE_BYTES`` by the
mean record size) and are read whole, one file a row, by Content-Length.

Revisit resolution (``deduplicate_archives``): the headers of all records are
read without payloads and shuffled by payload digest; of each digest's responses
the one with the smallest page id is the original, and every other response or
revisit of that digest is joined to it; the archives are then written anew, with
fresh headers, later responses as revisit records without payload. A hot digest
is pre-aggregated before its shuffle and the join back is open to Spark's skew
split, since only short headers take part.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matflow.llm.common import new_folder

#: Aimed size of one archive file before compression.
FILE_BYTES = 16 << 20
#: Payloads below this size are never made revisits.
MIN_REVISIT_BYTES = 100

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_TYPE = "application/http; msgtype=response"
# Extension fields for the integer page ids.
PAGE_FIELD = "X-Page-ID"
REFERS_PAGE_FIELD = "X-Refers-To-Page-ID"

HEADER_SCHEMA = ("file string, offset long, warc_type string, record_id string, target_uri string, "
                 "warc_date string, payload_digest string, payload_bytes long, page_id long, "
                 "refers_to_id string, refers_to_uri string, refers_to_date string, refers_to_page long")


def _clean(value: Column) -> Column:
    """A header value without the characters that could end its line."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def _field(name: str, value: Column) -> Column:
    """'Name: value CR LF', empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _records(df: DataFrame) -> DataFrame:
    """The text of each record, without the last line feed. ``payload`` is binary,
    null for revisits; the other columns are those of HEADER_SCHEMA."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("warc_type") == "response", F.coalesce(F.col("payload"), F.lit(b"")))
    length = F.length(http) + F.coalesce(F.octet_length(body), F.lit(0))
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        _field("WARC-Type", F.col("warc_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _field("WARC-Date", _clean(F.col("warc_date"))),
        _field("WARC-Target-URI", _clean(F.col("target_uri"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("WARC-Profile", F.when(F.col("warc_type") == "revisit", F.lit(PROFILE))),
        _field("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))),
        _field("WARC-Refers-To-Target-URI", _clean(F.col("refers_to_uri"))),
        _field("WARC-Refers-To-Date", _clean(F.col("refers_to_date"))),
        _field(PAGE_FIELD, F.col("page_id")),
        _field(REFERS_PAGE_FIELD, F.col("refers_to_page")),
        _field("Content-Type", F.lit(BLOCK_TYPE)),
        _field("Content-Length", length),
        F.lit("\r\n"), http)
    # raw bytes as a string: the text writer copies them as they are
    whole = F.concat(head.cast("binary"), F.coalesce(body, F.lit(b"")), F.lit(b"\r\n\r"))
    return df.select(whole.cast("string").alias("value"))


def _write(records: DataFrame, folder: str, mean_bytes: float, level: str = "DEFAULT_COMPRESSION") -> None:
    per_file = int(max(1, min(1_000_000, FILE_BYTES / max(mean_bytes, 1.0))))
    (_records(records).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file)
     .option("compression", "gzip").option("zlib.compress.level", level).text(folder))


def write_pages(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z",
                level: str = "DEFAULT_COMPRESSION") -> None:
    """One response record per row of (page_id, url, html); html null is an empty
    payload, a null url or page_id leaves its header out. Repeated rows give
    repeated records with ids of their own."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    key = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "url",
                             F.monotonically_increasing_id().cast("string")), 256)
    uuid = F.concat_ws("-", *[F.substring("__key", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = (pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"),
                         payload.alias("payload"), key.alias("__key"))
            .select("page_id", "target_uri", "payload", F.concat(F.lit("urn:uuid:"), uuid).alias("record_id"),
                    F.lit("response").alias("warc_type"), F.lit(date).alias("warc_date"),
                    F.sha2("payload", 256).alias("payload_digest"),
                    F.octet_length("payload").cast("long").alias("payload_bytes"),
                    F.lit(None).cast("string").alias("refers_to_id"),
                    F.lit(None).cast("string").alias("refers_to_uri"),
                    F.lit(None).cast("string").alias("refers_to_date"),
                    F.lit(None).cast("long").alias("refers_to_page")))
    _write(rows, folder, mean + 700, level)


def _parse(content: bytes) -> Iterator[tuple[int, dict[str, str], int, int]]:
    """(offset, header fields, start of the block, end of the block) of each record."""
    at, size = 0, len(content)
    while at < size:
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at}: wrong Content-Length")
        yield at, fields, start, stop
        at = stop + 4


def _reader(payloads: bool, flush: int = 8 << 20):
    names = [x.strip().split(" ")[0] for x in HEADER_SCHEMA.split(",")] + ["payload"] * payloads

    def number(text):
        return None if text is None else int(text)

    def read(batches):
        schema = pa.schema([(n, pa.int64() if n in ("offset", "payload_bytes", "page_id", "refers_to_page")
                             else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, held = [], 0
        for batch in batches:
            for path, buffer in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = buffer.as_buffer()
                content = gzip.decompress(content) if path.endswith(".gz") else content.to_pybytes()
                for at, f, start, stop in _parse(content):
                    body = content.find(b"\r\n\r\n", start, stop) + 4
                    http = content[start:body].decode("latin-1").lower()
                    length = int(http.split("content-length:", 1)[1].split("\r\n", 1)[0])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] == "response" and (
                            stop - body != length or hashlib.sha256(content[body:stop]).hexdigest() != digest):
                        raise ValueError(f"{path}: damaged payload at offset {at}")
                    row = [path, at, f["WARC-Type"], f["WARC-Record-ID"].strip("<>"), f.get("WARC-Target-URI"),
                           f.get("WARC-Date"), digest, length, number(f.get(PAGE_FIELD)),
                           f["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in f else None,
                           f.get("WARC-Refers-To-Target-URI"), f.get("WARC-Refers-To-Date"),
                           number(f.get(REFERS_PAGE_FIELD))]
                    if payloads:
                        row.append(content[body:stop] if f["WARC-Type"] == "response" else None)
                        held += stop - body
                    rows.append(row)
                    held += 300
                    if held >= flush:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                             schema=schema)
    return read


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archive files in ``folder``: HEADER_SCHEMA, and with
    ``payloads`` the binary payload (null for revisits). Payload digests and
    lengths of responses are checked against the bytes read; a damaged record
    raises. An empty folder gives an empty table."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
             .where("length > 0").select("path", "content"))
    return files.mapInArrow(_reader(payloads), HEADER_SCHEMA + (", payload binary" if payloads else ""))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record_id, warc_type, refers_to_*) for each record that becomes or stays a
    revisit of an original found in ``headers``.

    The original of a digest is its response with the smallest page id, null ids
    last, then the smallest record id. Records with payloads below ``min_bytes``
    are left alone, as are revisits whose original is not in these archives."""
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    first = (large.where("warc_type = 'response'").groupBy("payload_digest")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", "record_id",
                                 "target_uri", "warc_date")).alias("first"),
                  F.count(F.lit(1)).alias("n")))
    return (large.select("record_id", "payload_digest").join(first, "payload_digest")
            .where(F.col("record_id") != F.col("first.record_id"))
            .select("record_id", F.lit("revisit").alias("warc_type"),
                    F.col("first.record_id").alias("refers_to_id"),
                    F.col("first.target_uri").alias("refers_to_uri"),
                    F.col("first.warc_date").alias("refers_to_date"),
                    F.col("first.page_id").alias("refers_to_page")))


def deduplicate_archives(spark: SparkSession, folder: str, out: str,
                         min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the records of ``folder`` to ``out`` with later copies as revisits."""
    headers = read_archives(spark, folder)
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0.0
    again = resolve_revisits(headers, min_bytes)
    changed = ["warc_type", "refers_to_id", "refers_to_uri", "refers_to_date", "refers_to_page"]
    kept = read_archives(spark, folder, payloads=True)
    both = kept.alias("k").join(again.alias("a"), F.col("k.record_id") == F.col("a.record_id"), "left")
    hit = F.col("a.record_id").isNotNull()
    _write(both.select(*[F.col(f"k.{c}") for c in kept.columns if c not in changed],
                       *[F.when(hit, F.col(f"a.{c}")).otherwise(F.col(f"k.{c}")).alias(c) for c in changed]),
           out, mean + 700)


def archive_pages(pages: DataFrame, folder: str | None = None,
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, deduplicate them and read the result back:
    one row per page with page_id, payload_bytes, payload_digest, record_type and
    refers_to (the original's page id for revisits), and the record ids.

    Null or empty html is an empty payload (always a response); repeated page ids
    give a row each, of which only one is the response; columns other than
    page_id, url and html are ignored; no pages give no rows."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_pages(pages, f"{folder}/raw", level="BEST_SPEED")   # read once more, then superseded
    deduplicate_archives(spark, f"{folder}/raw", f"{folder}/dedup", min_bytes)
    back = read_archives(spark, f"{folder}/dedup")
    return back.select("page_id", "payload_bytes", "payload_digest",
                       F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM o
"""
