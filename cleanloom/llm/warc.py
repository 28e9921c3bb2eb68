"""Content-addressed web archive: payloads once by verified digest, exact headers apart.

An archive is two tables. ``payloads`` holds each distinct payload once, compressed,
under its SHA-256. ``headers`` holds, for every record, the exact bytes of its WARC and
HTTP headers and the digest of its payload. Reading joins the two, rebuilds every
record, checks the stored digest and the digest in the header, and parses the record.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the largest
page_id is the response and the others are revisits of it; smaller payloads are stored
once too, but all their records are responses. A null html is an empty payload, a null
url leaves out the URI. Repeated rows are records of their own: of equal rows with the
largest page_id one is the response. A null page_id counts as less than any other and is
read back as null. Other columns of the input are ignored; an empty table gives an empty
archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch

MIN_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKED = "rid long, page_id long, url string, n_bytes long, sha1 string, digest binary, packed binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record binary, payload binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    names = [x.split()[0] for x in PACKED.split(",")]
    for batch in batches:
        payloads = [x.as_py() or b"" for x in batch.column(3).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(3)),
                pa.array([len(x) for x in payloads], pa.int64()),
                pa.array([hashlib.sha1(x).hexdigest() for x in payloads]),
                pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()),
                pa.array([squeeze.compress(x) for x in payloads], pa.binary()),
            ],
            names,
        )


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def header_bytes(
    rid: int, page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_rid: int | None, refers_to: int | None
) -> bytes:
    """The exact header block of one record, HTTP header included."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_rid is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{rid}>"]
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:record:{refers_rid}>", f"WARC-Profile: {PROFILE}"]
        lines += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields by lower-case name, HTTP header, payload) of one record; checks its length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its header")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
        made = pa.array([header_bytes(*row) for row in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("digest"), made], ["rid", "digest", "header"])


def write_archive(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as an archive below ``path``."""
    scratch = Scratch(spark, "warc")
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), "url", "html"
    )
    packed = scratch.cut(rows.mapInArrow(_pack, PACKED), "packed")
    packed.groupBy("digest").agg(F.first("packed").alias("packed")).write.parquet(f"{path}/payloads")
    first = (
        packed.where(F.col("n_bytes") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "rid")).alias("w"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("w.rid").alias("w_rid"), F.col("w.page_id").alias("w_id"))
    )
    first = scratch.cut(first, "first")
    other = F.col("w_rid") != F.col("rid")
    heads = packed.drop("packed").join(first, "digest", "left").select(
        "rid", "page_id", "url", "n_bytes", "sha1",
        F.when(other, F.col("w_rid")).alias("refers_rid"), F.when(other, F.col("w_id")).alias("refers_to"), "digest",
    )
    heads.mapInArrow(_headers, "rid long, digest binary, header binary").write.parquet(f"{path}/headers")
    scratch.drop(packed)
    scratch.free()


def _rebuild(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    loose = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in RECORDS.split(",")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        out = []
        for digest, header, packed in zip(*(batch.column(k) for k in ("digest", "header", "packed")), strict=True):
            stored = loose.decompress(packed.as_py())
            if hashlib.sha256(stored).digest() != digest.as_py():
                raise ValueError("a stored payload differs from its digest")
            revisit = b"\r\nWARC-Refers-To: " in header.as_py()
            record = header.as_py() + (b"" if revisit else stored) + b"\r\n\r\n"
            fields, _, payload = parse_record(record)
            payload = stored if fields["warc-type"] == "revisit" else payload
            sha1 = hashlib.sha1(payload)
            if fields["warc-payload-digest"] != "sha1:" + base64.b32encode(sha1.digest()).decode():
                raise ValueError(f"record {fields['warc-record-id']} doesn't have its payload")
            out.append(
                (number(fields.get("x-page-id")), fields.get("warc-target-uri"), len(payload), sha1.hexdigest(), fields["warc-type"],
                 number(fields.get("x-refers-to-page-id")), record if whole else None, payload if whole else None)
            )
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archive(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Every record of an archive, rebuilt, verified and parsed.

    ``record`` and ``payload`` hold the exact bytes, or null unless ``whole``.
    """
    heads = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    return heads.join(stored, "digest").mapInArrow(lambda it: _rebuild(it, whole), RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc-archive').root}"
    write_archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path, whole=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT h, max(page_id) AS w FROM p WHERE strlen(h) >= {MIN_REVISIT} GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN p.page_id <> w.w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> w.w THEN w.w END AS refers_to
FROM p LEFT JOIN w ON p.h = w.h
"""
