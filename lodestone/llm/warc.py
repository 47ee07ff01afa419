"""WARC archives: writing, reading, and revisit resolution.

A WARC file is written by Spark's text writer: each row is a record's header block and content, and the line
separator is the pair of line ends that closes a record. So archives go to any storage Spark writes to, by its
commit protocol. They are read as whole binary files of a bounded number of records, parsed by Content-Length.

Revisit resolution shuffles headers only, by payload digest: the record with the smallest id among equal payloads
is the original response, the others become revisit records that name it and carry no payload. Payloads move once,
to the writer of the new archives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, shuffles_dropped, written

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
#: Records in one archive file at most.
RECORDS_PER_FILE = 2000
RECORD_SCHEMA = (
    "id long, record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, "
    "refers_to_id string, payload string"
)


def record_id(id: Column, kind: str) -> Column:
    """A UUID URN made of the id and the kind of archive, so a rerun writes the same records."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(kind), F.coalesce(id.cast("string"), F.lit("null"))), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _one_line(c: Column) -> Column:
    """A header value: line ends inside it would end the header."""
    return F.regexp_replace(c, r"[\r\n]+", "%0A")


def write_archive(records: DataFrame, path: str) -> None:
    """Writes records (id, record_id, record_type, uri, date, payload_digest, payload_bytes, refers_to_id, payload) as
    gzipped WARC 1.1 files. A revisit has no payload; its payload_digest and payload_bytes are those of the original.
    Null ids and URIs leave their headers out."""
    http = F.when(F.col("record_type") == "response", F.concat(F.lit(HTTP + END), F.col("payload"))).otherwise(F.lit(HTTP + END))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), c)).otherwise("")
    revisit = lambda name, c: F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"\r\n{name}: "), c)).otherwise("")
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        line("WARC-Target-URI", _one_line(F.col("uri"))),
        F.lit("\r\nWARC-Date: "), F.col("date"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        line("X-Source-Id", F.col("id").cast("string")),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        revisit("WARC-Profile", F.lit(REVISIT_PROFILE)),
        revisit("WARC-Refers-To", F.col("refers_to_id")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"),
        F.lit(END), http,
    )
    with shuffles_dropped(records.sparkSession):
        records.select(value.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content block of each record of one file, gzipped or not."""
    held, rest, gz = bytearray(), memoryview(data), data[:2] == b"\x1f\x8b"
    unzip = zlib.decompressobj(31) if gz else None

    def more() -> bool:
        nonlocal rest, unzip
        if not len(rest):
            return False
        part, rest = rest[: 1 << 18], rest[1 << 18 :]
        if not gz:
            held.extend(part)
            return True
        while len(part):
            held.extend(unzip.decompress(part))
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        return True

    at = 0
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop and more():
            pass
        if len(held) < stop:
            raise ValueError("an archive ends within a record")
        yield fields, bytes(held[end + 4 : stop])
        at = stop + 4
        if at > 1 << 20:
            while len(held) < at and more():
                pass
            del held[:at]
            at = 0


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files under path, in the columns of RECORD_SCHEMA. A revisit's payload is null, and so
    are all with payloads=False. Reads through Spark, so from any storage; an empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches):
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                size = 0
                for f, block in _records(data.as_py()):
                    payload = None
                    if f.get("warc-type") == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    length = int(f["x-payload-length"]) if "x-payload-length" in f else len(payload or b"")
                    rows.append((int(f["x-source-id"]) if "x-source-id" in f else None, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, length, f.get("warc-refers-to"), payload.decode("utf-8", "replace") if payload is not None and payloads else None))
                    size += len(block)
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(parse, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def as_responses(pages: DataFrame, id: str, uri: str, payload: str, date: str) -> DataFrame:
    """Rows as response records; a null payload is empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(id).cast("long").alias("id"), record_id(F.col(id), "capture").alias("record_id"), F.lit("response").alias("record_type"),
        F.col(uri).alias("uri"), F.lit(date).alias("date"), F.sha2(body.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to_id"), body.alias("payload"),
    )


def resolve_revisits(records: DataFrame, date: str, least: int = LEAST_BYTES) -> DataFrame:
    """Response records with repeated payloads turned into revisits, all with fresh headers.

    Of responses with the same digest and at least `least` bytes, that with the smallest id stays a response (one of
    them, if several rows have that id: then that with the smallest record_id); the others are revisits of it."""
    head = records.where(F.col("payload_bytes") >= least).select("id", "record_id", "payload_digest")
    first = head.groupBy("payload_digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    # only headers of repeated payloads meet their original, and only revisits among them meet their record
    repeated = head.join(first.where("n > 1").select("payload_digest", "first"), "payload_digest")
    revisits = repeated.where(F.col("record_id") != F.col("first.record_id")).select(F.col("record_id").alias("own"), F.col("payload_digest").alias("own_digest"), F.col("first.id").alias("original")).distinct()
    # a table of known size: Spark broadcasts it below its threshold, and only else shuffles payloads
    revisits = written(revisits, "warc-revisits")
    joined = records.join(revisits, (records["record_id"] == revisits["own"]) & (records["payload_digest"] == revisits["own_digest"]), "left")
    again = F.col("own").isNotNull()
    return joined.select(
        "id", record_id(F.col("id"), "deduplicated").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "uri", F.lit(date).alias("date"), "payload_digest", "payload_bytes",
        F.when(again, record_id(F.col("original"), "deduplicated")).alias("refers_to_id"), F.when(~again, F.col("payload")).alias("payload"),
    )


def deduplicated_archive(pages: DataFrame, id: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages as response records, reads these archives, writes the archives with revisits resolved, reads those
    and joins each revisit to its original.

    Returns per row of pages: page_id, payload_bytes, payload_digest (of the full payload, checked against the
    payload read for responses), record_type, refers_to (the original's id for revisits), uri. Ids should be unique: rows
    that share an id, a null one included, have the same record id, and with equal payloads are responses or revisits
    together. An empty table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    raw, clean = shared_dir(spark, "warc-capture"), shared_dir(spark, "warc-deduplicated")
    write_archive(as_responses(pages, id, uri, payload, date), raw)
    write_archive(resolve_revisits(read_archive(spark, raw), date), clean)
    records = read_archive(spark, clean)
    # headers, and what the payload really is: one pass over the archives
    records = written(records.select("id", "record_id", "record_type", "uri", "refers_to_id", "payload_digest", "payload_bytes", F.sha2(F.col("payload").cast("binary"), 256).alias("found"), F.octet_length("payload").alias("found_bytes")), "warc-headers")
    originals = records.where(F.col("record_type") == "response").select(F.col("record_id").alias("original"), F.col("id").alias("refers_to"), F.col("payload_digest").alias("original_digest")).distinct()
    revisits = records.where(F.col("record_type") == "revisit")
    resolved = revisits.join(originals, (revisits["refers_to_id"] == originals["original"]) & (revisits["payload_digest"] == originals["original_digest"]), "left")
    broken = F.raise_error(F.concat(F.lit("the archive's record does not hold what its header says: "), F.col("record_id")))
    whole = (F.col("found") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("payload_bytes"))
    responses = records.where(F.col("record_type") == "response")
    pick = lambda df, digest, to: df.select(F.col("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", to.cast("long").alias("refers_to"), "uri")
    return pick(responses, F.when(whole, F.col("payload_digest")).otherwise(broken), F.lit(None)).unionByName(pick(resolved, F.when(F.col("original").isNotNull(), F.col("payload_digest")).otherwise(broken), F.col("refers_to")))


ORACLE = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to,
  url AS uri
FROM pages
"""
