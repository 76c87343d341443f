"""Web archives: writing WARC records, reading them back, and assembling captures.

A capture is a request, a response or revisit, and a metadata record. Request and metadata name the
third by ``WARC-Concurrent-To``; the join on that identifier makes one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import pieces, utf8

DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SLOTS = 64
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, "
    "fields string, payload_bytes long, payload_digest string, payload binary"
)


def _uuid(*parts):
    digest = F.md5(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("\1")) for p in parts]))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _record(kind: str, ident: str, headers: list[tuple[str, str | None]], block: bytes) -> str:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ident}>",
        f"WARC-Date: {DATE}",
        *[f"{k}: {v}" for k, v in headers if v is not None],
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(size: int):
    """Records of the captures, dealt out to archives of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, held = TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches, 512):
            out: list[tuple[str, str]] = []
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "ident", "refers")]
            for page, url, ident, refers, html in zip(*columns, utf8(batch.column("html"))):
                payload = html or b""
                uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else None
                try:
                    split = urlsplit(uri or "")
                    host, path = split.netloc, (split.path or "/")
                except ValueError:
                    host, path = "", "/"
                digest = "sha1:" + sha1_base32(payload)
                target = ("WARC-Target-URI", uri)
                about = [("WARC-Concurrent-To", f"<{ident}>"), target]
                made = [
                    _record(
                        "request",
                        ident[:-1] + "q",
                        [*about, ("Content-Type", "application/http; msgtype=request")],
                        f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
                    ),
                    _record(
                        "response",
                        ident,
                        [
                            target,
                            ("WARC-Payload-Digest", digest),
                            ("Content-Type", "application/http; msgtype=response"),
                        ],
                        HTTP + payload,
                    )
                    if refers is None
                    else _record(
                        "revisit",
                        ident,
                        [
                            target,
                            ("WARC-Payload-Digest", digest),
                            ("WARC-Refers-To", f"<{refers}>"),
                            ("WARC-Profile", PROFILE),
                            ("Content-Type", "application/http; msgtype=response"),
                        ],
                        HTTP,
                    ),
                    _record(
                        "metadata",
                        ident[:-1] + "m",
                        [*about, ("Content-Type", "application/warc-fields")],
                        b"" if page is None else f"page_id: {page}\r\n".encode(),
                    ),
                ]
                for text in made:
                    out.append((f"{part:06d}-{archive:06d}", text))
                held += 2 * 512 + len(payload)
                if held > size:
                    archive, held = archive + 1, 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], names=["archive", "record"]
                )

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16_000_000) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzipped WARC archives under ``path``.

    Of equal payloads the one with the smallest page_id (then url) is a response and the others
    are revisits that refer to it. Null html is an empty payload; null ids come last; a null url
    gives records without a target. Rows alike in id, url and payload are one capture. Other
    columns are not read. An archive is bounded by ``archive_bytes`` and one record.

    Which capture a payload goes back to is settled on ids and digests alone; the payloads
    themselves are shuffled once, by capture, so a payload of a third of all pages is spread out.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    ).withColumn("sum", F.sha2(F.coalesce("html", F.lit("")), 256))
    base = base.withColumn("ident", _uuid(F.col("page_id"), F.col("url"), F.col("sum")))
    order = F.struct(
        F.col("page_id").isNull().alias("n"), "page_id", F.coalesce("url", F.lit("")).alias("u"), "url", "ident"
    )
    first = base.groupBy(F.col("sum").alias("s")).agg(F.min(order)["ident"].alias("first"))
    revisits = (
        base.select("sum", F.col("ident").alias("i"))
        .join(first, F.col("sum") == F.col("s"))
        .filter("i != first")
        .select("i", F.col("first").alias("refers"))
        .distinct()
    )
    captures = base.drop("sum").dropDuplicates(["ident"])
    ready = captures.join(revisits, F.col("ident") == F.col("i"), "left").select(
        "page_id", "url", "html", "ident", "refers"
    )
    (
        ready.mapInArrow(_write(archive_bytes), "archive string, record string")
        .write.partitionBy("archive")
        .option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one uncompressed archive, by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin = end + 4
        at = begin + int(head["content-length"])
        block, at = data[begin:at], at + 4
        kind = head["warc-type"]
        payload = None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = sha1_base32(payload) if payload is not None else None
        said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if digest is not None and said is not None and digest != said:
            raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
        yield (
            head["warc-record-id"].strip("<>"),
            kind,
            head.get("warc-concurrent-to", "").strip("<>") or None,
            head.get("warc-refers-to", "").strip("<>") or None,
            head.get("warc-target-uri"),
            block.decode("utf-8") if kind == "metadata" else None,
            None if payload is None else len(payload),
            said if digest is None else digest,
            payload,
        )


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in pieces(batches, 1):
            data = zlib.decompress(batch.column(0)[0].as_py(), 31)
            rows = []
            for row in parse(data):
                rows.append(row if with_payload else (*row[:-1], None))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                    )
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                )

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; a task holds one archive at a time."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.gz")
        .load(path)
    )
    return files.select("content").mapInArrow(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``request``, ``response``, ``metadata``.

    ``response`` is the response or revisit record; for a revisit ``payload_bytes`` and
    ``refers_to_page`` come from the response that it refers to. Parts that an archive lacks are
    null. ``page_id`` is read from the metadata.
    """
    parts = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def part(*kinds: str):
        content = F.struct(
            "record_id", "type", "uri", "fields", "refers_to", "payload_bytes", "payload_digest", "payload"
        )
        return F.max(F.when(F.col("type").isin(*kinds), content))

    captures = (
        parts.filter(F.col("type").isin("request", "response", "revisit", "metadata"))
        .groupBy("capture_id")
        .agg(
            part("request").alias("request"),
            part("response", "revisit").alias("response"),
            part("metadata").alias("metadata"),
        )
        .withColumn(
            "page_id",
            F.expr("try_cast(regexp_extract(metadata.fields, 'page_id: (-?[0-9]+)', 1) as long)"),
        )
    )
    origins = captures.filter("response.type = 'response'").select(
        F.col("capture_id").alias("origin"),
        F.col("page_id").alias("refers_to_page"),
        F.col("response.payload_bytes").alias("origin_bytes"),
    )
    # A response with very many revisits is looked up once per slot, not once per revisit.
    slotted = captures.withColumn("slot", F.pmod(F.xxhash64("capture_id"), F.lit(SLOTS)))
    wanted = (
        slotted.filter("response.type = 'revisit'")
        .select(F.col("response.refers_to").alias("origin"), F.col("slot").alias("at"))
        .distinct()
    )
    found = wanted.join(origins, "origin")
    here = (F.col("response.refers_to") == F.col("origin")) & (F.col("slot") == F.col("at"))
    return (
        slotted.join(found, here, "left")
        .withColumn("payload_bytes", F.coalesce("response.payload_bytes", "origin_bytes"))
        .drop("origin", "origin_bytes", "slot", "at")
    )
