"""Writing pages as WARC archives and reading archives back in byte ranges.

Writing. A record per row, each its own gzip member, through Spark's committed file writer, so a lost
executor leaves no half files. Of rows with equal payloads of at least ``min_revisit`` bytes the one with the largest
key is a ``response``; the others are ``revisit`` records that refer to it. Only digests are grouped, never payloads,
and the join back splits a digest that many rows share.

Reading. A file is cut into byte ranges. A task looks for the gzip magic in its range, tries each candidate by
decoding its first bytes, and takes those that start a WARC record; it owns all members that start inside
its range and reads past the end to finish the last one. Bytes inside a decoded member are skipped,
so a magic number in compressed data does no harm. A member that starts as a record and
then fails its checksum is an error, not a gap.

The archive's part files end each member with the text writer's line separator: the last byte of a gzip member is
the high byte of its size, always zero below 16 MB, and the separator is that zero byte. A larger
member is followed by an empty one, which gzip readers skip.

Defined results: a null payload counts as empty. A null key is written without key; it revisits the largest
non-null key of its payload. Rows that repeat the largest key are all responses. A null url is left out.
Extra columns are ignored. An empty table writes an archive without pages, which reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmate.llm.common import prepare, read_table
from shelfmate.operators.joins import splittable_join
from shelfmate.session import scratch_path

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD, REFERS_FIELD = "X-Row-Key", "X-Refers-To-Row-Key"

MIN_REVISIT = 1000
RANGE_BYTES = 8 << 20
#: Ranges grow beyond RANGE_BYTES where there would be more tasks than this.
MOST_RANGES = 100_000
_PROBE = 1 << 12
_STEP = 1 << 18
_BATCH = 4 << 20


# --- writing ---------------------------------------------------------------------------


def _record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{key}')}>"


def _clean(value: str) -> str:
    return "".join(c for c in value if c >= " " and c != "\x7f")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {_clean(value)}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """The gzip member less its last byte, which is zero and comes from the line separator."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = squeeze.compress(record) + squeeze.flush()
    if member[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += empty.flush()
    return member[:-1]


def page_record(key, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _record_id(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if key is not None:
        fields.append((KEY_FIELD, str(key)))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to)), (REFERS_FIELD, str(refers_to))]
    return _record(fields, http if is_revisit else http + payload)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest")
    )
    repeated = (
        rows.where(F.octet_length("_body") >= min_revisit)
        .groupBy("_digest")
        .agg(F.max("_key").alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_digest", "_largest")
    )
    marked = splittable_join(rows, repeated, ["_digest"], "left")
    revisit = F.col("_largest").isNotNull() & ~F.col("_largest").eqNullSafe(F.col("_key"))
    marked = marked.select("_key", "_url", "_body", "_largest", revisit.alias("_revisit"))

    def run(batches):
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
        yield pa.RecordBatch.from_pydict(
            {"member": [_member(_record([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))]}
        )
        for batch in batches:
            members, size = [], 0
            for row in zip(*(batch.column(i) for i in range(5))):
                row_key, row_url, row_body, largest, is_revisit = (x.as_py() for x in row)
                members.append(_member(page_record(row_key, row_url, row_body, largest, is_revisit, date)))
                size += len(members[-1])
                if size >= _BATCH:
                    yield pa.RecordBatch.from_pydict({"member": members})
                    members, size = [], 0
            if members:
                yield pa.RecordBatch.from_pydict({"member": members})

    # The text writer copies a string's bytes as they are; the cast does not touch them.
    marked.mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.text(path, lineSep="\x00")


# --- reading ---------------------------------------------------------------------------


def _open(path: str):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record in a decoded member."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if stop > len(data):
            raise ValueError("record is cut short")
        yield fields, data[start:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


def owned_members(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC members that start in [start, end)."""
    source.seek(start)
    window = source.read(end - start + len(MAGIC) - 1)
    at = window.find(MAGIC)
    while 0 <= at < end - start:
        try:
            probe = zlib.decompressobj(31).decompress(window[at : at + _PROBE], 16)
            if len(probe) < 16 and at + _PROBE > len(window):
                source.seek(start + at)
                probe = zlib.decompressobj(31).decompress(source.read(_PROBE), 16)
        except zlib.error:
            probe = b""
        if not probe.startswith(b"WARC/1."):
            at = window.find(MAGIC, at + 1)
            continue
        unzip, parts, taken = zlib.decompressobj(31), [], at
        try:
            while taken < len(window) and not unzip.eof:
                piece = window[taken : taken + _STEP]
                parts.append(unzip.decompress(piece))
                taken += len(piece) - len(unzip.unused_data)
            if not unzip.eof:
                source.seek(start + taken)
            while not unzip.eof:
                piece = source.read(_STEP)
                if not piece:
                    raise ValueError("the member is cut short")
                parts.append(unzip.decompress(piece))
                taken += len(piece) - len(unzip.unused_data)
        except (zlib.error, ValueError) as problem:
            raise ValueError(f"damaged WARC member at byte {start + at}: {problem}") from problem
        yield start + at, b"".join(parts)
        at = window.find(MAGIC, taken) if taken < len(window) else -1


def _split_http(fields: dict[str, str], block: bytes) -> tuple[str | None, bytes]:
    if not fields.get("Content-Type", "").startswith("application/http"):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    return head.decode("latin-1"), body


_READ = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()),
     ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.string()), ("payload", pa.binary())]
)
_SCHEMA = (
    "path string, offset long, warc_type string, target_uri string, headers map<string,string>, http_headers string, payload binary"
)


def _read_ranges(batches):
    for batch in batches:
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows, size = [], 0
            with _open(path) as source:
                for offset, data in owned_members(source, start, end):
                    for fields, block in parse_records(data):
                        http, payload = _split_http(fields, block)
                        rows.append((path, offset, fields.get("WARC-Type"), fields.get("WARC-Target-URI"), list(fields.items()), http, payload))
                        size += len(payload)
                    if size >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)


def range_size(total: int, most: int = MOST_RANGES) -> int:
    return max(RANGE_BYTES, -(-total // most))


def read_archive(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """All records: path, offset of the member, warc_type, target_uri, headers, http_headers, payload.

    A task reads ``range_bytes``; by default they follow from the size of all files. Members are read one by one, so a
    larger range takes longer but no more memory.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    if range_bytes is None:
        range_bytes = range_size(files.agg(F.sum("length")).first()[0] or 0)
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("length") / F.lit(range_bytes)))).first()[0] or 1
    return ranges.repartition(int(n), "path", "start").mapInArrow(_read_ranges, _SCHEMA)


def pages_of(records: DataFrame) -> DataFrame:
    """One row per page of an archive: key, size, digest, kind of record, and what it refers to."""
    revisit = F.col("warc_type") == "revisit"
    told = F.regexp_extract("http_headers", r"(?i)(?:^|\r\n)Content-Length: *(\d+)", 1).cast("long")
    return records.where(F.col("warc_type").isin("response", "revisit")).select(
        F.col("headers")[KEY_FIELD].cast("long").alias("page_id"),
        F.when(revisit, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, _hex_of_base32(F.substring(F.col("headers")["WARC-Payload-Digest"], 6, 32)))
        .otherwise(F.sha1("payload"))
        .alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(revisit, F.col("headers")[REFERS_FIELD].cast("long")).alias("refers_to"),
    )


def _hex_of_base32(text):
    """A SHA-1 in base 32 is 32 digits of five bits: eight groups of four digits, five hex digits each."""
    digits = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    groups = [F.lpad(F.lower(F.conv(F.substring(digits, 1 + 4 * i, 4), 32, 16)), 5, "0") for i in range(8)]
    return F.concat(*groups)


def query(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return pages_of(read_archive(spark, path))


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h,
  CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM d"""
