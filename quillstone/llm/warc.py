"""WARC archives: a writer with revisit records, and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, if_small, scratch_path, shuffle_partitions, utf8, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on are stored once; bytes of a range that a task reads; bytes fetched beyond a range at a time.
REVISIT_BYTES, SPLIT_BYTES, STEP_BYTES = 1000, 8 << 20, 1 << 16
#: What a record's decoded header starts with.
VERSION = b"WARC/1."
DATE = "2000-01-01T00:00:00Z"


#: Schemes of Spark's file systems that Arrow knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A record as one gzip member: a response with its payload, or a revisit that names the page it refers to."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + pack.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive a task attempt, in the shared folder; the row that tells of it counts only if the attempt succeeds."""
    context = TaskContext.get()
    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    size = 0
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                made = record(row[0], row[1], utf8(row[2]), row[3], row[4])
                out.write(made)
                size += len(made)
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of a table with page_id, url and html; returns (path, bytes) of the archives.

    Of rows with equal payloads of REVISIT_BYTES or more the one with the largest page_id is a response and the others
    revisit it; all others are responses. Rows that repeat that page_id are responses too. A null html is an empty payload.

    Payloads stay where they are: only digests are counted, and those that repeat come back, by broadcast up to BROADCAST_ROWS.
    """
    arrow_limits(df.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = df.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    narrow = df.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    # only digests that repeat: one row each, however many copies; counts are combined before the shuffle
    first = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(if_small(written(first, "repeated")), "digest", "left").withColumn("refers_to", F.when(large & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    return written(marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda b: _write(b, folder), "path string, bytes long"), "archives")


class Range:
    """Bytes of a file from ``start`` on, fetched as they are asked for."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.start, self.size = file, start, size
        self.data = bytearray(file.read_at(min(end, size) - start, start))

    def upto(self, end: int) -> bool:
        """Hold the bytes before ``end`` if the file has them."""
        have = self.start + len(self.data)
        if end > have and have < self.size:
            self.data += self.file.read_at(min(max(end - have, STEP_BYTES), self.size - have), have)
        return self.start + len(self.data) >= end

    def drop(self, at: int) -> None:
        """Let go of the bytes before ``at``."""
        if at - self.start >= STEP_BYTES:
            del self.data[: at - self.start]
            self.start = at

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded gzip member at ``at`` and its end; None unless it decodes to a record and another one or the end
        of the file follows. A candidate is refused on its first decoded bytes, before the rest is read."""
        decode, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not decode.eof:
                if not self.upto(pos + 1):
                    return None
                piece = bytes(self.data[pos - self.start : pos - self.start + STEP_BYTES])
                out += decode.decompress(piece)
                pos += len(piece)
                if len(out) >= len(VERSION) and not out.startswith(VERSION):
                    return None
        except zlib.error:
            return None
        end = pos - len(decode.unused_data)
        if not out.startswith(VERSION) or (self.upto(end + len(MAGIC)) and self.data[end - self.start : end - self.start + len(MAGIC)] != MAGIC):
            return None
        return bytes(out), end


def members(source: Range, start: int, end: int) -> Iterator[bytes]:
    """Decoded members that start in [start, end): the first by search, each next where the last one ended."""
    at = start
    while at < end:
        source.upto(end + len(MAGIC) - 1)
        at = source.data.find(MAGIC, at - source.start)
        if at < 0 or (at := at + source.start) >= end:
            return
        if found := source.member(at):
            yield found[0]
            at = found[1]
            source.drop(at)
        else:
            at += 1


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A decoded record's headers (names in lower case) and its content."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", "0"))]


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


_COLUMNS = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def flushed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _COLUMNS)

    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            fs, name = _open(path)
            rows, held = [], 0
            with fs.open_input_file(name) as file:
                for data in members(Range(file, start, end, file.size()), start, end):
                    fields, body = parse(data)
                    kind = fields.get("warc-type")
                    if kind == "response":
                        digest, length = hashlib.sha1(body).hexdigest(), len(body)
                        if fields.get("warc-payload-digest") != f"sha1:{digest}":
                            raise ValueError(f"payload of {fields.get('warc-record-id')} in {path} does not have its digest")
                    else:
                        digest, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
                    refers = _page(fields.get("warc-refers-to"))
                    rows.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, digest, length, refers, body if with_payload else None))
                    held += len(body) if with_payload else 64
                    if held > 1 << 23:
                        yield flushed(rows)
                        rows, held = [], 0
            yield flushed(rows)


def read_archives(files: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a table (path, bytes): page_id, url, record_type, payload_digest, payload_bytes,
    refers_to and payload (empty for revisits, null without ``with_payload``).

    Tasks take byte ranges of ``split_bytes``, not files: each looks for gzip magic in its range, tries candidates by decoding
    their headers, and owns the records that start inside, reading on beyond its end where a record does. Every record has
    one owner, whatever the ranges. A member that is not a record, and one that ends where no member starts, is no record.

    Edge cases: empty archives and ranges without a start give no rows; payloads of any size are read whole.
    """
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", starts)
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    ranges = ranges.repartition(shuffle_partitions(spark), "path", "start")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return ranges.mapInArrow(lambda b: _read(b, with_payload), schema)


def round_trip(df: DataFrame) -> DataFrame:
    """Write the rows of a table with page_id, url and html to archives in the shared folder and read them back.

    Edge cases: a null html is an empty payload; a null page_id is written as such and read as null; repeated rows give a
    record each; other columns are ignored; an empty table gives an empty result.
    """
    files = write_archives(df.withColumn("page_id", F.col("page_id").cast("long")), scratch_path(df.sparkSession, "warc"))
    return read_archives(files, with_payload=False)
