"""From image files to crops: listing, decoding, regions of marked pixels, replacing one run's images.

Files come through Spark's binary source, so any store that Spark reads will do. Pixels are bytes in
rows, blue before green before red. A file that cannot be decoded stays as a row with the reason.
Many small files are better kept as members of tar archives: a store creates, lists and opens each
file by itself.
"""

from __future__ import annotations

import io
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.boxes import cluster_boxes
from tallyframe.operators.dbscan import dbscan
from tallyframe.session import cut_lineage
from tallyframe.sources.images import crop_pixels

ARCHIVE = 4_000_000  # bytes of members after which an archive is closed
SLOTS = 256  # folders of an image table; an image's slot follows from its id

_DECODED = "image_id string, width int, height int, n_channels int, data binary, reason string"
_HEAD = re.compile(rb"(P[2356])((?:\s|#[^\n]*\n)+)(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
PNG_MARK = b"\x89PNG\r\n\x1a\n"  # fixed value: how every PNG file starts
TAR_MARK = b"ustar"  # fixed value: stands 257 bytes into every tar archive
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: samples of a pixel by PNG colour type


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive as one text, without its last byte, which is the line end of the writer."""
    packed = None

    def closed():
        names, buffer, archive = packed
        archive.close()
        body = buffer.getvalue()[:-1].decode()
        ident = f"{zlib.crc32(repr(names).encode()):08x}-{zlib.crc32(body.encode()):08x}"
        return pa.RecordBatch.from_arrays([pa.array([ident]), pa.array([body])], names=["archive", "value"])

    for batch in batches:
        for name, value in zip(*(batch.column(k).to_pylist() for k in range(2))):
            if packed is None:
                buffer = io.BytesIO()
                packed = [], buffer, tarfile.open(fileobj=buffer, mode="w", format=tarfile.GNU_FORMAT)
            body = (value or "").encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            packed[2].addfile(info, io.BytesIO(body))
            packed[0].append(name)
            if packed[1].tell() >= ARCHIVE:
                yield closed()
                packed = None
    if packed is not None:
        yield closed()


def write_text_archives(files: DataFrame, path: str) -> None:
    """Text files (name, value) as members of tar archives of bounded size below a folder.

    Names and texts are stored in UTF-8; null is an empty file. Every task fills archives of its own.
    """
    made = files.select(F.col("name").cast("string"), F.col("value").cast("string"))
    made.mapInArrow(_archives, "archive string, value string").write.partitionBy("archive").option(
        "lineSep", "\0"
    ).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(name: str, content: bytes):
        if content[257:262] != TAR_MARK:
            yield name, content
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as archive:
                for member in archive:
                    if member.isfile():
                        yield f"{name}/{member.name}", archive.extractfile(member).read()
        except tarfile.TarError:
            yield name, content

    for batch in batches:
        found, held = [], 0
        for name, content in zip(*(c.to_pylist() for c in batch.columns)):
            for row in rows(name, content or b""):
                found.append(row)
                held += len(row[1])
                if held >= ARCHIVE or len(found) >= 10_000:
                    yield _file_batch(found)
                    found, held = [], 0
        if found:
            yield _file_batch(found)


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, contents = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["image_id", "content"]
    )


def list_files(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Paths and sizes of the files below a folder, or of the first by path; none is opened.

    Spark passes over files without any bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    names = files.select("path", "length")
    return names.orderBy("path").limit(first) if first is not None else names


def read_files(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Files as (image_id, content); with ``first``, only so many are opened.

    The members of a tar archive are files of their own, called by the archive's path and their
    name in it; for ``first`` an archive is one file. An archive that is damaged stays as a file.
    The listing is cut before any content is read; the chosen paths, ``first`` at most, name the
    files of the second read.
    """
    reader = spark.read.format("binaryFile")
    if first is None:
        files = reader.option("recursiveFileLookup", True).load(folder)
    else:
        chosen = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r.path) for r in list_files(spark, folder, first).collect()]
        if not chosen:
            return spark.createDataFrame([], "image_id string, content binary")
        files = reader.load(chosen)
    named = files.select(F.col("path").alias("image_id"), "content")
    return named.mapInArrow(_members, "image_id string, content binary")


def _portable_map(content: bytes) -> np.ndarray:
    head = _HEAD.match(content)
    if not head:
        raise ValueError("no header")
    kind, width, height, most = head[1], int(head[3]), int(head[4]), int(head[5])
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < most < 256:
        raise ValueError("more than a byte a sample")
    body = content[head.end() :]
    if kind in (b"P5", b"P6"):
        values = np.frombuffer(body, np.uint8)
    else:
        values = np.array(re.sub(rb"#[^\n]*", b"", body).split(), dtype=np.int64)
    size = width * height * channels
    if not size or len(values) < size or values[:size].max() > most:
        raise ValueError("pixels missing or too large")
    return values[:size].astype(np.uint8).reshape(height, width, channels)


def _png(content: bytes) -> np.ndarray:
    at, packed, head = 8, b"", None
    while at + 8 <= len(content):
        length, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + length]
        if zlib.crc32(name + body) != int.from_bytes(content[at + 8 + length : at + 12 + length], "big"):
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + length
    if head is None or head[2] != 8 or head[3] not in PNG_CHANNELS or head[6]:
        raise ValueError("not 8 bits a sample in plain order")
    width, height, channels = head[0], head[1], PNG_CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height + 1, width * channels + channels), np.int64)  # a margin of zeros
    for y, (kind, line) in enumerate(zip(lines[:, 0], lines[:, 1:].astype(np.int64)), 1):
        row, up = out[y], out[y - 1]
        if kind == 0:
            row[channels:] = line
        elif kind == 2:
            row[channels:] = (line + up[channels:]) & 255
        else:
            for x, value in enumerate(line, channels):
                a, b, c = row[x - channels], up[x], up[x - channels]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (value + guess) & 255
    pixels = out[1:, channels:].astype(np.uint8).reshape(height, width, channels)
    return pixels[:, :, :1] if channels == 2 else pixels


def decode_bytes(content: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """Pixels (blue, green, red) of a PNG or portable map, or the reason why there are none."""
    if not content:
        return None, "empty file"
    try:
        if content.startswith(PNG_MARK):
            pixels = _png(content)
        elif content[:2] in (b"P2", b"P3", b"P5", b"P6"):
            pixels = _portable_map(content)
        else:
            return None, "unknown format"
    except (ValueError, struct.error, zlib.error, OverflowError) as error:
        return None, f"damaged: {error}"
    if pixels.shape[2] >= 3:
        pixels = np.concatenate([pixels[:, :, 2::-1], pixels[:, :, 3:]], axis=2)
    return pixels, None


def decode(files: DataFrame) -> DataFrame:
    """(image_id, content) as (image_id, width, height, n_channels, data, reason).

    ``reason`` is null for a decoded image; else it says what is wrong and the rest is null.
    """

    schema = pa.schema(
        [
            ("image_id", pa.string()),
            ("width", pa.int32()),
            ("height", pa.int32()),
            ("n_channels", pa.int32()),
            ("data", pa.binary()),
            ("reason", pa.string()),
        ]
    )

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("image_id", "content"))):
                pixels, reason = decode_bytes(content)
                height, width, channels = pixels.shape if reason is None else (None,) * 3
                data = None if pixels is None else pixels.tobytes()
                rows.append((name, width, height, channels, data, reason))
                held += len(data or b"")
                if held >= ARCHIVE:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return files.select("image_id", "content").mapInArrow(run, _DECODED)


def marked_pixels(images: DataFrame, level: int) -> DataFrame:
    """Pixels whose first channel is at least ``level``, as (image_id, key, x, y); key is y·width + x."""

    def made(names: list, keys: list, xs: list, ys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(names, object), [len(k) for k in keys]), pa.string()),
                pa.array(np.concatenate(keys)),
                pa.array(np.concatenate(xs).astype(np.float64)),
                pa.array(np.concatenate(ys).astype(np.float64)),
            ],
            names=["image_id", "key", "x", "y"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, xs, ys, held = [], [], [], [], 0
            for r in batch.to_pylist():
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], -1)
                y, x = np.nonzero(pixels[:, :, 0] >= level)
                names.append(r["image_id"])
                keys.append(y.astype(np.int64) * r["width"] + x)
                xs.append(x)
                ys.append(y)
                held += len(x)
                if held >= 1 << 17:
                    yield made(names, keys, xs, ys)
                    names, keys, xs, ys, held = [], [], [], [], 0
            if names:
                yield made(names, keys, xs, ys)

    fine = images.filter(F.col("data").isNotNull()).select("image_id", "width", "height", "data")
    return fine.mapInArrow(run, "image_id string, key long, x double, y double")


def crop_files(
    spark: SparkSession,
    folder: str,
    level: int,
    eps: float = 1.0,
    min_samples: int = 1,
    first: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Crops around the density clusters of marked pixels, and the files that could not be read.

    Crops are (image_id, cluster, left, top, width, height, n_channels, data); a cluster is named
    by its first pixel. Pixels that belong to no cluster have no crop. The second table is
    (image_id, reason).
    """
    decoded = cut_lineage(decode(read_files(spark, folder, first)), "decoded")
    images = decoded.filter("reason is null").drop("reason")
    points = cut_lineage(marked_pixels(images, level), "marked")
    found = dbscan(points, "key", "x", "y", eps, min_samples, "image_id")
    boxes = cluster_boxes(found.filter("cluster is not null"), ["image_id", "cluster"], "x", "y")
    rects = boxes.select(
        "image_id",
        "cluster",
        F.col("x0").cast("int").alias("left"),
        F.col("y0").cast("int").alias("top"),
        (F.col("x1") - F.col("x0") + 1).cast("int").alias("width"),
        (F.col("y1") - F.col("y0") + 1).cast("int").alias("height"),
    )
    rects = cut_lineage(rects, "rects")
    crops = crop_pixels(images, rects).join(
        rects.select("image_id", "cluster", "left", "top"), ["image_id", "cluster"]
    )
    return crops, decoded.filter("reason is not null").select("image_id", "reason")


def replace_images(
    images: DataFrame, path: str, run: DataFrame | None = None, slots: int = SLOTS
) -> None:
    """Put a run's images in place of what the table at ``path`` holds of them; keep all others.

    ``run`` lists the ids (image_id) of the run, by default those of ``images``; an image of the
    run without rows vanishes. Only the slots of the run's images are written again, from a
    staged copy, by a dynamic overwrite of their partitions; give every run the same ``slots``.
    """
    spark = images.sparkSession
    slot = F.pmod(F.xxhash64("image_id"), F.lit(slots)).cast("int").alias("slot")
    ids = (run if run is not None else images).select("image_id").distinct()
    touched = ids.select(slot).distinct()
    new = images.select("*", slot)
    # a slot that would end up empty must be written all the same
    marks = touched.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in images.schema.fields], "slot"
    )
    try:
        old = spark.read.parquet(path).select(*images.columns, "slot")
        kept = old.filter(F.col("image_id").isNotNull()).join(touched, "slot", "left_semi")
        kept = kept.join(ids, "image_id", "left_anti").select(*new.columns)
        new = new.unionByName(kept)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    staged = cut_lineage(new.unionByName(marks), "images")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "slot"
    ).parquet(path)


def image_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``replace_images`` keeps at a path."""
    return spark.read.parquet(path).filter(F.col("image_id").isNotNull()).drop("slot")
