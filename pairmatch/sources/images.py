"""Image folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.operators.images import filter_channels


def scan_images(
    spark: SparkSession, path: str, extensions: Sequence[str] = ("jpg", "png")
) -> DataFrame:
    """(origin, image): decodable three-channel images of a folder."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(path)
    )
    return filter_channels(images).select(F.col("image.origin").alias("origin"), "image")


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """(post_id, filename, path) of all files below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("post_id"), F.element_at(parts, -1).alias("filename"), "path"
    )
