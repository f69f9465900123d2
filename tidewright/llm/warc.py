"""WARC archives: written with revisit records and segments, read with segment reassembly.

The writer stores a page's payload as an HTTP response. Of equal payloads one is a response and
the others are revisit records that refer to it. Large messages use chunked transfer framing and are cut into a first record
and continuation records. The reader groups continuation records by the identifier of their origin,
orders them by segment number, verifies the total length, and decodes chunked transfer framing. Every
record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, filesystem, located, scratch, ship, spread, stage, table

#: Bytes of a message above which it is sent in chunks of CHUNK_BYTES and cut into segments of SEGMENT_BYTES.
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"
_RECORD = "record_id string, type string, page_id bigint, refers_to_id string, stated_digest string, bytes bigint, digest string, origin string, number bigint, total bigint, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(file: str, row: int) -> str:
    return f"<{uuid.uuid5(_NAMES, f'{file}#{row}').urn}>"


def chunked(body: bytes) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[k : k + CHUNK_BYTES] for k in range(0, len(body), CHUNK_BYTES))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """What chunked transfer framing holds; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at = end + 4 + size


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = message.partition(b"\r\n\r\n")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(fields: dict, block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def records_of_page(page_id: int | None, url: str | None, payload: bytes, rid: str, refers_to: str | None) -> Iterator[bytes]:
    """The record, or first and continuation records, of a page."""
    common = {"WARC-Date": _DATE, "WARC-Target-URI": "".join((url or "about:blank").split()), "Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}"}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": rid, "WARC-Refers-To": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common, "Content-Type": "application/http; msgtype=response"}, head)
        return
    large = len(payload) > SEGMENT_BYTES
    framing = "Transfer-Encoding: chunked" if large else f"Content-Length: {len(payload)}"
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{framing}\r\n\r\n".encode() + (chunked(payload) if large else payload)
    first = {"WARC-Type": "response", "WARC-Record-ID": rid, **common, "Content-Type": "application/http; msgtype=response"}
    if not large:
        yield record(first, message)
        return
    segments = [message[k : k + SEGMENT_BYTES] for k in range(0, len(message), SEGMENT_BYTES)]
    yield record(first | {"WARC-Segment-Number": 1}, segments[0])
    for n, s in enumerate(segments[1:], 2):
        total = len(message) if n == len(segments) else None
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{uuid.uuid5(_NAMES, f'{rid}/{n}').urn}>", "WARC-Date": _DATE, "WARC-Target-URI": common["WARC-Target-URI"], "WARC-Segment-Origin-ID": rid, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": total}, s)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in ``folder``; the written manifest has their ``path`` and number of records.

    Payloads are the html in UTF-8, empty for null. Of equal payloads (by SHA-256 and length; the SHA-1 of the records is broken) of ``least_bytes`` or more, the page with the smallest
    identifier (nulls last; of repeated rows the first by locator) is the response, the others revisit it. Other columns aren't
    read. An empty table gives no archives.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = located(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")), "file", "row")
    light = stage(rows.select("page_id", "file", "row", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").alias("bytes")), "payloads").where(F.col("bytes") >= least_bytes)
    first = light.groupBy("sha256", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "row")).alias("first"), F.count("*").alias("many")).where("many > 1")
    again = light.join(first, ["sha256", "bytes"]).where("file != first.file OR row != first.row")
    again = stage(again.select("file", "row", F.col("first.file").alias("to_file"), F.col("first.row").alias("to_row")), "revisits")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, many = None, 0
        for b in batches:
            for page_id, url, payload, file, row, to_file, to_row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "file", "row", "to_file", "to_row"))):
                if out is None:
                    uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                for r in records_of_page(page_id, url, payload, record_id(file, row), None if to_file is None else record_id(to_file, to_row)):
                    out.write(r)
                    many += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "records": pa.array([many], pa.int64())})

    spread(rows.join(bounded(again), ["file", "row"], "left")).mapInArrow(written, "path string, records bigint").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, records bigint").parquet(f"{folder}/manifest")


def parse(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzip stream, one record in memory at a time."""
    data, z, buffer = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not data and not (data := stream.read(step)):
            if buffer:
                raise ValueError("the archive is cut off")
            return
        buffer += z.decompress(data)
        data = z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)
            whole = bytes(buffer)
            buffer.clear()
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            if len(rest) < size:
                raise ValueError("a block is cut off")
            yield fields, rest[:size]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _RECORD.split(", ")])
    for b in batches:
        for uri in b.column("path").to_pylist():
            fs, path = filesystem(uri)
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as f:
                for fields, block in parse(f):
                    number = fields.get("warc-segment-number")
                    r = dict.fromkeys(names) | {"record_id": fields["warc-record-id"], "type": fields["warc-type"], "page_id": int(fields["page-id"]) if "page-id" in fields else None, "refers_to_id": fields.get("warc-refers-to"), "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                    if number is not None:
                        total = fields.get("warc-segment-total-length")
                        r |= {"origin": fields.get("warc-segment-origin-id", r["record_id"]), "number": int(number), "total": total and int(total), "block": block}
                    elif r["type"] == "response":
                        payload = payload_of(block)
                        r |= {"bytes": len(payload), "digest": digest_of(payload)}
                    rows.append(r)
                    held += len(block) if number else 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for origin, segments, total in zip(b.column("origin").to_pylist(), b.column("segments").to_pylist(), b.column("total").to_pylist()):
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                raise ValueError(f"{origin}: a segment is missing or comes twice")
            message = b"".join(s["block"] for s in segments)
            if total is None or total != len(message):
                raise ValueError(f"{origin}: {len(message)} bytes in segments, {total} stated")
            payload = payload_of(message)
            out.append({"record_id": origin, "bytes": len(payload), "digest": digest_of(payload), "payload": payload})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("record_id", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]))


def reassembled(records: DataFrame) -> DataFrame:
    """``record_id, bytes, digest, payload`` of segmented records (rows with origin, number, total, block).

    Segments are grouped by origin, ordered by number and must be complete and as long as stated; otherwise the job fails and says which record is
    damaged. A group is a single message, so it is as large as that.
    """
    ship(records.sparkSession)
    grouped = records.where("origin IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"), F.max("total").alias("total"))
    return grouped.mapInArrow(_reassemble, "record_id string, bytes bigint, digest string, payload binary")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each response and revisit record.

    The digest is computed from the payload as read and must equal the one stated. A revisit has the
    payload of the response that it refers to; where that is in none of the archives, its length and ``refers_to`` are null
    and the digest is the one that it states.
    """
    spark = manifest.sparkSession
    files = manifest.select("path")
    ship(spark)
    # Archives are dealt out one to a task: reading one is the unit of work here.
    records = stage(files.repartition(max(1, files.count()), "path").mapInArrow(_read, _RECORD), "records")
    parts = reassembled(records).drop("payload").withColumnRenamed("bytes", "whole_bytes").withColumnRenamed("digest", "whole_digest")
    light = records.where("type IN ('response', 'revisit')").drop("block")
    responses = light.where("type = 'response'").join(parts, "record_id", "left").select("record_id", "page_id", F.coalesce("bytes", "whole_bytes").alias("payload_bytes"), F.coalesce("digest", "whole_digest").alias("payload_digest"), "stated_digest")
    same = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "record_id")).cast("string"))
    responses = responses.withColumn("payload_digest", same)
    of = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("of_digest"))
    revisits = light.where("type = 'revisit'").select("page_id", "refers_to_id", "stated_digest").join(of, "refers_to_id", "left")
    same = F.when(F.col("of_digest").isNull() | (F.col("of_digest") == F.col("stated_digest")), F.col("stated_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "refers_to_id")).cast("string"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", same.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "archives")))
