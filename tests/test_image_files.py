"""Image files to crops, and tables of which a run replaces its own images."""

import struct
import zlib

import numpy as np
import pytest

from tallyframe.sources import image_files
from tallyframe.sources.image_files import (
    crop_files,
    decode_bytes,
    image_table,
    list_files,
    read_files,
    replace_images,
    write_text_archives,
)


def png(pixels, kinds):
    """A PNG file whose lines use the given filters in turn."""
    height, width, channels = pixels.shape
    lines, before = [], np.zeros((width, channels), int)
    for y in range(height):
        now, kind = pixels[y].astype(int), kinds[y % len(kinds)]
        left = np.vstack([np.zeros((1, channels), int), now[:-1]])
        corner = np.vstack([np.zeros((1, channels), int), before[:-1]])
        p = left + before - corner
        near = [abs(p - left), abs(p - before), abs(p - corner)]
        paeth = np.where(
            (near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], before, corner)
        )
        guess = [0 * now, left, before, (left + before) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes())
        before = now

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    packed = zlib.compress(b"".join(lines))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    found, reason = decode_bytes(png(pixels, [0, 1, 2, 3, 4]))
    assert reason is None
    if channels >= 3:
        assert (found[:, :, :3] == pixels[:, :, 2::-1]).all()
    else:
        assert (found == pixels[:, :, :1]).all()


def test_portable_maps():
    assert decode_bytes(b"P2 # grey\n2 1\n255\n7 # x\n9")[0].tolist() == [[[7], [9]]]
    assert decode_bytes(b"P6\n1 1\n255\n\x01\x02\x03")[0].tolist() == [[[3, 2, 1]]]
    assert decode_bytes(b"P5 1 2 255 \x05\x06")[0].tolist() == [[[5]], [[6]]]
    assert decode_bytes(b"P3 1 1 9 1 2 3")[0].tolist() == [[[3, 2, 1]]]


@pytest.mark.parametrize(
    "content,reason",
    [
        (None, "empty"), (b"", "empty"), (b"GIF89a", "unknown"), (b"P2\n2 2\n255\n1 2", "damaged"),
        (b"P5\n1 1\n65535\n\0\0", "damaged"), (b"P2\n1 1\n10\n11", "damaged"), (b"P2 x", "damaged"),
        (b"\x89PNG\r\n\x1a\n", "damaged"), (png(np.zeros((3, 3, 1), np.uint8), [0])[:-20] + b"x" * 8, "damaged"),
        (b"P2\n0 0\n255\n", "damaged"), (b"P2\n1 1\n255\nx", "damaged"),
    ],
)
def test_unreadable(content, reason):
    assert decode_bytes(content)[1].startswith(reason)


def test_files_to_crops(spark, tmp_path):
    image = np.zeros((6, 8, 1), np.uint8)
    image[1:3, 1:4], image[4, 6:8], image[0, 0] = 200, 210, 190
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a [1].png").write_bytes(png(image, [4]))
    (tmp_path / "b.pgm").write_bytes(b"P2\n2 1\n255\n0 255")
    (tmp_path / "c.txt").write_bytes(b"no image")
    (tmp_path / "d.png").write_bytes(b"")
    crops, unread = crop_files(spark, str(tmp_path), 150)
    found = {(r.image_id.split("/")[-1][:1], r.cluster): (r.left, r.top, r.width, r.height, bytes(r.data)) for r in crops.collect()}
    assert found == {
        ("a", 0): (0, 0, 1, 1, b"\xbe"),
        ("a", 9): (1, 1, 3, 2, b"\xc8" * 6),
        ("a", 38): (6, 4, 2, 1, b"\xd2" * 2),
        ("b", 1): (1, 0, 1, 1, b"\xff"),
    }
    assert [r.reason for r in unread.collect()] == ["unknown format"]
    assert list_files(spark, str(tmp_path)).count() == 3  # Spark passes over files without bytes
    names = [r.image_id.split("/")[-1] for r in read_files(spark, str(tmp_path), 2).collect()]
    assert sorted(names) == ["b.pgm", "c.txt"]
    brackets = read_files(spark, str(tmp_path / "sub"), 1).collect()
    assert len(brackets) == 1 and bytes(brackets[0].content).startswith(b"\x89PNG")
    (tmp_path / "none").mkdir()
    assert read_files(spark, str(tmp_path / "none"), 3).collect() == []


def test_a_run_replaces_its_own_images(spark, tmp_path):
    path = str(tmp_path / "table")

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "image_id string, v int")

    def held():
        return sorted((r.image_id, r.v) for r in image_table(spark, path).collect())

    replace_images(rows(*[(str(k), 1) for k in range(40)], ("0", 5)), path, slots=4)
    assert len(held()) == 41
    replace_images(rows(("0", 2), ("50", 2)), path, slots=4)
    assert held() == sorted([("0", 2), ("50", 2), *[(str(k), 1) for k in range(1, 40)]])
    # a run that found nothing in its images takes them out, also when a slot is left empty
    everything = rows(*[(str(k), 0) for k in range(60)])
    replace_images(rows(), path, everything, slots=4)
    assert held() == []


def test_archives_hold_image_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(image_files, "ARCHIVE", 60_000)
    files = {f"id={k}/image.pgm": f"P2\n2 1\n255\n{k % 256} 200\n" for k in range(300)}
    files |= {"é" * 90: "x" * 512, "empty": "", "none": None, "late/" + "n" * 120: "P2 1 1 9 1"}
    rows = spark.createDataFrame(list(files.items()), "name string, value string").repartition(3)
    write_text_archives(rows, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").rglob("*.txt"))) < 20
    found = read_files(spark, str(tmp_path / "packed")).collect()
    names = {r.image_id.split("archive=")[1].split("/", 2)[2]: bytes(r.content) for r in found}
    assert len(found) == len(files)
    assert names == {k: (v or "").encode() for k, v in files.items()}
    crops, unread = crop_files(spark, str(tmp_path / "packed"), 150)
    assert crops.count() == 300  # the pixel of 200, with its neighbour where that is bright
    assert {r.image_id.rsplit("/", 1)[-1]: r.reason.split(":")[0] for r in unread.collect()} == {
        "é" * 90: "unknown format", "empty": "empty file", "none": "empty file"
    }


def test_damaged_archive(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b"x" * 257 + b"ustar" + b"y" * 600)
    assert [r.reason for r in crop_files(spark, str(tmp_path), 150)[1].collect()] == ["unknown format"]


def test_query_writes_few_files(spark, tmp_path, monkeypatch):
    from tallyframe.plans import all_queries, clusters

    signs = [[(k * j % 7) / 20 for j in range(64)] for k in range(200)]
    rows = [*enumerate(signs), (5, signs[5]), (200, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(clusters, "shared_path", lambda spark, name: str(tmp_path / name))
    found = all_queries()["image_files_to_crops"](spark, str(tmp_path)).collect()
    assert len(list((tmp_path / "image-files").rglob("*.txt"))) < 20
    assert {r.vec_id for r in found if r.reason == "unknown format"} == {*range(4, 200, 9), 200}
    assert {r.vec_id for r in found if (r.reason or "").startswith("damaged")} == {5}
