"""Media files of a folder as a table; contents are only hashed, never decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan.operators.ingest import catalogue_scan, identify


class NoMediaError(ValueError):
    """The folder holds no usable media file."""


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, sha256, rejected) of the media files directly in ``folder``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select(
            "path",
            F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"),
            F.col("length").alias("size"),
            F.sha2("content", 256).alias("sha256"),
        )
    )
    return catalogue_scan(files)


def discover_media(spark: SparkSession, folder: str) -> DataFrame:
    """Identified media files; refuses an empty folder or an empty file."""
    media = list_media(spark, folder)
    if media.isEmpty():
        raise NoMediaError(f"no media files in '{folder}'")
    broken = media.where("rejected").select("name").take(1)
    if broken:
        raise NoMediaError(f"'{broken[0]['name']}' is empty (0 bytes)")
    return identify(media.drop("rejected"))
