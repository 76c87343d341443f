"""Images as rows: reading a folder, grey conversion, cropping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# fixed values: weights of blue, green and red in a grey value
GREY_WEIGHTS = (0.114, 0.587, 0.299)

_CROP = "image_id string, cluster long, width int, height int, n_channels int, data binary"


def read_images(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Images of a folder as (image_id, width, height, n_channels, data); unreadable ones skipped.

    ``first`` keeps the first files by name.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    rows = images.select(
        F.col("image.origin").alias("image_id"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )
    return rows.orderBy("image_id").limit(first) if first is not None else rows


@F.pandas_udf(BinaryType())
def _grey(data: pd.Series, n_channels: pd.Series) -> pd.Series:
    def one(pixels: bytes, n: int) -> bytes:
        values = np.frombuffer(pixels, dtype=np.uint8)
        if n == 1:
            return pixels
        blue_green_red = values.reshape(-1, n)[:, :3].astype(float)
        return np.floor(blue_green_red @ np.array(GREY_WEIGHTS) + 0.5).astype(np.uint8).tobytes()

    return pd.Series([one(p, n) for p, n in zip(data, n_channels)])


def to_grey(images: DataFrame) -> DataFrame:
    """One grey byte per pixel, rounded; blue, green and red come in that order."""
    grey: Column = _grey(F.col("data"), F.col("n_channels"))
    return images.withColumn("data", grey).withColumn("n_channels", F.lit(1))


def crop_pixels(images: DataFrame, rects: DataFrame) -> DataFrame:
    """The pixels of each rectangle (image_id, cluster, left, top, width, height).

    A rectangle is cut to the image; one that lies outside has no pixels and is left out.
    """
    wanted = rects.select(
        "image_id",
        F.col("cluster").cast("bigint").alias("cluster"),
        F.greatest(F.col("left"), F.lit(0)).alias("x0"),
        F.greatest(F.col("top"), F.lit(0)).alias("y0"),
        (F.col("left") + F.col("width")).alias("x1"),
        (F.col("top") + F.col("height")).alias("y1"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, dtype=np.uint8)
                pixels = pixels.reshape(r.height, r.width, r.n_channels)
                part = pixels[r.y0 : max(r.y1, 0), r.x0 : max(r.x1, 0)]
                if part.size:
                    h, w, n = part.shape
                    out.append((r.image_id, r.cluster, w, h, n, part.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CROP.split(", ")])

    return wanted.join(images, "image_id").mapInPandas(run, _CROP)


def write_images(images: DataFrame, path: str) -> None:
    """Pixels as Parquet; replaces what the path held. Many images share a file."""
    images.write.mode("overwrite").parquet(path)
