"""WARC archives: chunked, segmented records written and reassembled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, fresh_path, left, small_batches, written

EOL = "\r\n"
#: Bytes of a record's block beyond which it continues in further records.
SEGMENT_BYTES = 16_384
#: Bytes of one transfer chunk.
CHUNK_BYTES = 4_096
#: Equal payloads shorter than this are stored again instead of as revisits.
MIN_REVISIT_BYTES = 1_000
#: Records of an archive file; with SEGMENT_BYTES this bounds what a reading task holds.
FILE_RECORDS = 800
_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "origin string, segment int, total long, type string, refers_to string, digest string, block binary"
PAYLOAD = "origin string, type string, refers_to string, digest string, payload binary, complete boolean"


# ------------------------------------------------------------------ framing


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` (at least 4) bytes that end where a UTF-8 character ends."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def framed(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding (RFC 9112, 7.1)."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in cut(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> tuple[bytes, bool]:
    """(payload, whole): chunk extensions and trailers are skipped; what is readable is kept."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return b"".join(out), False
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(out), False
        at = end + 2
        if n == 0:
            return b"".join(out), True
        out.append(body[at : at + n])
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return b"".join(out), False
        at += n + 2


def http_payload(block: bytes) -> tuple[bytes, bool]:
    """Payload of an HTTP response block; chunked framing is decoded."""
    head, mid, body = block.partition(b"\r\n\r\n")
    if not mid:
        return b"", False
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return unframed(body)
    return body, True


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, mid, value = line.partition(b":")
        if mid:
            yield name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()


# ------------------------------------------------------------------ writing


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}{EOL}" for k, v in fields)
    return f"WARC/1.1{EOL}{head}Content-Length: {len(block)}{EOL}{EOL}{block.decode()}"


def records_of(page: str, url: str, payload: bytes, refers_to: str | None, segment: int, chunk: int) -> Iterator[str]:
    """The record named ``page``, and its continuations if its block is longer than a segment."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    same = [("WARC-Target-URI", url), ("WARC-Date", _DATE), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK{EOL}{EOL}".encode()
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), *same, ("WARC-Profile", _PROFILE),
             ("WARC-Refers-To", f"<urn:page:{refers_to}>")], block,
        )
        return
    head = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Transfer-Encoding: chunked{EOL}{EOL}"
    block = head.encode() + framed(payload, chunk)
    parts = list(cut(block, segment))
    for n, part in enumerate(parts, 1):
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), *same]
            fields += [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{n}>"), ("WARC-Date", _DATE),
                      ("WARC-Segment-Origin-ID", f"<urn:page:{page}>"), ("WARC-Segment-Number", n)]
            fields += [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        yield _record(fields, part)


def write_warc(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Archives under ``path`` from (key string, url, html, refers_to string).

    A record ends with two line ends, which is the separator of Spark's text writer: files
    go to any store Spark reaches, and roll over after ``file_records`` records.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for x in batch.slice(at, 64).to_pylist():
                    url = (x["url"] or "").replace("\r", " ").replace("\n", " ")
                    out += records_of(x["key"], url, (x["html"] or "").encode(), x["refers_to"], segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_pydict({"value": out})

    out = pages.select("key", "url", "html", "refers_to").mapInArrow(rows, "value string")
    # compression none: files that a Range request can cut into
    out.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", file_records).option("compression", "none").text(path)


# ------------------------------------------------------------------ reading


def parsed(data: bytes) -> Iterator[dict]:
    """Records of an archive file; bytes that begin no record are skipped."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(_fields(data[at:end].split(b"\r\n")[1:]))
        try:
            n = max(0, int(fields.get("content-length", "0")))
        except ValueError:
            n = 0
        block = data[end + 4 : end + 4 + n]
        yield {
            "origin": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"),
            "segment": int(fields["warc-segment-number"]) if fields.get("warc-segment-number", "").isdigit() else None,
            "total": int(fields["warc-segment-total-length"]) if fields.get("warc-segment-total-length", "").isdigit() else None,
            "type": fields.get("warc-type"),
            "refers_to": fields.get("warc-refers-to"),
            "digest": fields.get("warc-payload-digest"),
            "block": block,
        }
        at = data.find(b"WARC/", end + 4 + n)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``; a task holds one file at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for x in parsed(batch.column(0)[i].as_py() or b""):
                    out.append(x)
                    size += len(x["block"])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=_schema(RECORD))
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_schema(RECORD))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, RECORD)


def _reassembled(parts: list[dict]) -> dict:
    """One payload of an origin's segments in order; the first copy of a number counts."""
    first = parts[0]
    numbers, blocks, total = set(), [], None
    for x in parts:
        total = x["total"] if x["total"] is not None else total
        if x["segment"] not in numbers:
            numbers.add(x["segment"])
            blocks.append(x["block"])
    block = b"".join(blocks)
    whole = numbers == set(range(1, len(numbers) + 1)) and total == len(block) and first["type"] == "response"
    payload, framed_whole = http_payload(block)
    return _decoded(first, payload, whole and framed_whole)


def _decoded(x: dict, payload: bytes, whole: bool) -> dict:
    said = (x["digest"] or "").partition(":")[2]
    fits = not said or said == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"origin": x["origin"], "type": "response", "refers_to": None, "digest": x["digest"], "payload": payload, "complete": whole and fits}


def reassemble(records: DataFrame) -> DataFrame:
    """(origin, type, refers_to, digest, payload, complete), one row per origin.

    Records with a segment number are grouped by origin identifier and ordered by number; the
    total length of the last segment, gapless numbers, the chunked framing and the payload
    digest decide ``complete``. A lone continuation gives an incomplete row. Revisits have no
    payload here. Groups are single documents; a task holds one at a time.
    """
    out = _schema(PAYLOAD)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                done = []
                for x in batch.slice(at, 64).to_pylist():
                    if x["type"] == "revisit":
                        done.append({"origin": x["origin"], "type": "revisit", "refers_to": x["refers_to"], "digest": x["digest"], "payload": None, "complete": True})
                    else:
                        done.append(_decoded(x, *http_payload(x["block"])))
                yield pa.RecordBatch.from_pylist(done, schema=out)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                done = []
                for x in batch.slice(at, 64).to_pylist():
                    if parts and parts[0]["origin"] != x["origin"]:
                        done.append(_reassembled(parts))
                        parts = []
                    parts.append(x)
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if parts:
            yield pa.RecordBatch.from_pylist([_reassembled(parts)], schema=out)

    one = records.where(F.col("segment").isNull() & F.col("type").isin("response", "revisit")).mapInArrow(single, PAYLOAD)
    many = records.where(F.col("segment").isNotNull()).repartition("origin").sortWithinPartitions("origin", "segment")
    return one.unionByName(many.mapInArrow(grouped, PAYLOAD))


def warc_round_trip(
    pages: DataFrame,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, complete.

    Of pages with equal payloads of ``min_revisit_bytes`` or more, the one with the largest
    page_id is the response and the others revisit it. Payload size and digest of a revisit
    are those of the response it names, read from the archive.

    Every row has a record of its own, named by its page_id and a number of the row: rows that
    share an id with other html, or repeat, are told apart, and null ids have records too. A null
    id is never the largest; if an equal payload has no other id, each row is a response, as are
    all rows that repeat the largest id. Null html is an empty payload, a null url an empty
    target. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html")})
    long = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
    # written, so that its size is known: Spark broadcasts it below its threshold and shuffles beyond
    long, long_path = written(long.where("copies > 1 AND response IS NOT NULL").select("digest", "response"), "payloads")
    rows = rows.join(long, "digest", "left")
    name = F.concat_ws(".", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string"))
    again = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    rows = rows.select(name.alias("key"), "url", "html", F.when(again, F.col("response")).cast("string").alias("refers_to"))
    path = fresh_path(spark, "warc")
    write_warc(rows, path, segment_bytes, chunk_bytes)
    back = reassemble(read_records(spark, path))
    page = lambda c: F.regexp_extract(c, r"page:(-?\d+)[.>]", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    back = back.select(
        number("origin").alias("page_id"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), F.col("digest").alias("said"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "complete",
    )
    back, back_path = written(back, "warc-read")
    dropped(spark, path, long_path)
    left(back_path)
    revisits = back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "said")
    held = back.where("record_type = 'response'")
    # a revisit names the page and the payload, so another page under the same id is not meant
    target = held.select(F.col("page_id").alias("refers_to"), "said", "payload_bytes", "payload_digest", "complete").dropDuplicates(["refers_to", "said"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return held.select(columns).unionByName(revisits.join(target, ["refers_to", "said"], "left").select(columns))
