"""WARC archives: write with de-duplication, segment and chunk; read, reassemble, decode.

Writing. Each input row becomes one logical record. Of rows with equal
payloads of at least ``min_bytes`` bytes the one with the smallest key is a
``response`` and the others ``revisit`` records that name it; smaller
payloads are always ``response``. A response is an HTTP message with chunked
transfer framing. One longer than ``segment_bytes`` is cut: the first segment
is the response itself (WARC-Segment-Number 1), ``continuation`` records
carry the rest with WARC-Segment-Origin-ID and their number, the last one
WARC-Segment-Total-Length. Files are written by Spark's text sink with the
record separator as line end, so every file system and the task commit
protocol of Spark apply (a lost task's files are never seen).

Reading. Spark's text source cuts each file at the version line; a payload
may contain that line, so pieces are joined again by Content-Length inside
the (unsplittable, gzip) file: at most one record is held. Unsegmented
responses are decoded in place. Only segments are shuffled: grouped by
origin id, ordered by number, checked for gaps and for the total length, then
decoded.

Defined results: null payload = empty payload; null key = a record without
key, never chosen as the response that others refer to; rows that repeat the
smallest key of a payload are each a response; null URI = no URI header; an
empty table gives an empty archive. Broken archives (truncated record, gap,
wrong total length, wrong digest) raise, or give ``valid`` = false with
``on_error="flag"``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.common import map_arrow

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 4 * 1024
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 50_000

# Strings of the archive and transfer formats.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORD_SCHEMA = ("record_id string, record_type string, key long, refers_to long, uri string, digest string, "
                 "segment_number int, origin_id string, total_length long, block binary")
PAGE_SCHEMA = ("record_id string, record_type string, key long, refers_to long, uri string, "
               "payload_digest string, payload_bytes long, payload binary, valid boolean")


def plan_records(pages: DataFrame, key: str, payload: str, uri: str | None = None,
                 min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(key, uri, digest, n_bytes, refers_to, body): the record each row becomes; body null for revisits."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"),
                        (F.col(uri).cast("string") if uri else F.lit(None).cast("string")).alias("uri"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"),
                        body.alias("body"))
    shared = (rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.count("key").alias("keyed"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("last_key") > F.col("first_key")) | (F.col("keyed") < F.col("n")))  # held by that key alone: no entry
        .select("digest", "first_key"))
    shared = shared.repartition(F.xxhash64("digest"))  # its own deal, so a hot payload's rows can be split
    other = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return rows.join(shared, "digest", "left").select(
        "key", "uri", "digest", "n_bytes", F.when(other, F.col("first_key")).alias("refers_to"),
        F.when(~other, F.col("body")).alias("body"), F.monotonically_increasing_id().alias("row"))


def _headers(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + lines.encode() + b"Content-Length: %d" % length + END


def _clean_uri(uri: str | None) -> str | None:
    """Control characters and spaces would break the header line: percent-encode them."""
    if uri is None:
        return None
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in uri)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(part := body[i:i + size]), part) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = data.index(b"\r\n", at)
        size = int(data[at:eol].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = data[eol + 2:eol + 2 + size]
        if len(part) != size or data[eol + 2 + size:eol + 4 + size] != b"\r\n":
            raise ValueError("broken chunk framing")
        out.append(part)
        at = eol + 4 + size


def _urn(*parts: object) -> str:
    h = hashlib.md5("\0".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_bytes(key, uri, digest, n_bytes, refers_to, body, row, segment_bytes, chunk_bytes) -> list[bytes]:
    """The records (without the closing separator) of one row."""
    rid = _urn("record", row, key, digest)
    common = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", _clean_uri(uri)),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Key", key)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % n_bytes
        return [_headers([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE),
                          ("X-Refers-To-Key", refers_to)], len(block)) + block]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_headers([("WARC-Type", "response"), *common], len(block)) + block]
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_headers([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], len(parts[0])) + parts[0]]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(_headers([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(rid, n)), ("WARC-Date", DATE),
                             ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n),
                             ("WARC-Segment-Total-Length", total)], len(part)) + part)
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html",
                   uri: str | None = "url", min_bytes: int = MIN_REVISIT_BYTES,
                   segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as gzip WARC files under ``path`` (any file system Spark can write)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "uri", "digest", "n_bytes", "refers_to", "body", "row")]
            out = [r for row in zip(*cols) for r in record_bytes(*row, segment_bytes, chunk_bytes)]
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = map_arrow(plan_records(pages, key, payload, uri, min_bytes), make, "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_pieces(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of a file from its text between version lines (in order)."""
    held: list[bytes] = []
    size, need = 0, None
    for piece in pieces:
        if not held and not piece:
            continue  # before the first version line of a file
        if held:
            held.append(VERSION)
            size += len(VERSION)
        held.append(piece)
        size += len(piece)
        if need is None:
            if len(held) > 1:
                held = [b"".join(held)]
            cut = held[0].find(END)
            if cut < 0:
                continue
            head = dict(line.split(": ", 1) for line in held[0][:cut].decode().split("\r\n"))
            start = cut + len(END)
            need = start + int(head["Content-Length"]) + len(END)
        if size < need:
            continue
        if size > need:
            raise ValueError(f"record {head.get('WARC-Record-ID')} is longer than its Content-Length")
        data = b"".join(held)
        yield head | {"block": data[start:-len(END)]}
        held, size, need = [], 0, None
    if held:
        raise ValueError("truncated archive: the last record is incomplete")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, segments as stored."""
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (p for b in batches for p in b.column(0).to_pylist())
        rows: list[dict] = []
        size = 0
        for r in parse_pieces(pieces):
            num = lambda k: int(r[k]) if k in r else None  # noqa: B023, E731
            rows.append(dict(zip(names, (
                r["WARC-Record-ID"], r["WARC-Type"], num("X-Key"), num("X-Refers-To-Key"), r.get("WARC-Target-URI"),
                r.get("WARC-Payload-Digest", "").removeprefix("sha256:"), num("WARC-Segment-Number"),
                r.get("WARC-Segment-Origin-ID"), num("WARC-Segment-Total-Length"), r["block"]))))
            size += len(r["block"])
            if size > 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(RECORD_SCHEMA))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(RECORD_SCHEMA))

    raw = spark.read.schema("value string").option("lineSep", VERSION.decode()).text(path)
    return map_arrow(raw.select(F.col("value").cast("binary")), parse, RECORD_SCHEMA)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def decode_message(record: dict, parts: list[tuple[int, bytes]], total: int | None, keep: bool, strict: bool) -> dict:
    """One page from its ordered segments."""
    out = {k: record[k] for k in ("record_id", "record_type", "key", "refers_to", "uri")} | {
        "payload_digest": record["digest"], "payload_bytes": None, "payload": None, "valid": False}
    try:
        if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
            raise ValueError("segments are missing or repeated")
        block = b"".join(p for _, p in parts)
        if len(parts) > 1 and len(block) != total:
            raise ValueError(f"total length {total}, found {len(block)}")
        head, _, body = block.partition(END)
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("latin-1").split("\r\n")[1:])}
        if record["record_type"] == "revisit":
            return out | {"payload_bytes": int(fields["content-length"]), "valid": True}
        payload = unchunked(body) if fields.get("transfer-encoding") == "chunked" else body
        if hashlib.sha256(payload).hexdigest() != record["digest"]:
            raise ValueError("payload digest differs")
        return out | {"payload_bytes": len(payload), "payload": payload if keep else None, "valid": True}
    except (ValueError, KeyError) as e:
        if strict:
            raise ValueError(f"record {record['record_id']}: {e}") from e
        return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row per page of the archives: identity, type, digest, length and decoded payload."""
    strict, schema = on_error == "raise", _arrow(PAGE_SCHEMA)
    records = read_records(spark, path)
    segmented = F.col("segment_number").isNotNull()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist(
                [decode_message(r, [(1, r["block"])], None, with_payload, strict) for r in b.to_pylist()], schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                parts = [(p["segment_number"], p["block"]) for p in r["parts"]]
                yield pa.RecordBatch.from_pylist(
                    [decode_message(r, parts, r["total"], with_payload, strict)], schema)

    origin = F.coalesce("origin_id", "record_id")
    head = F.col("segment_number") == 1
    groups = (records.filter(segmented).withColumn("origin", origin).groupBy("origin").agg(
        *[F.max(F.when(head, F.col(c))).alias(c) for c in ("record_type", "key", "refers_to", "uri", "digest")],
        F.max("total_length").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment_number", "block"))).alias("parts"))
        .withColumnRenamed("origin", "record_id"))
    return map_arrow(records.filter(~segmented), whole, PAGE_SCHEMA).unionByName(
        map_arrow(groups, joined, PAGE_SCHEMA))
