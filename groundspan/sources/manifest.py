"""The ingest manifest as a Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan import schemas
from groundspan.operators.ingest import current_manifest
from groundspan.staging import stage_table

# How Spark and its Parquet reader name a file that is not Parquet or is cut off.
CORRUPT = ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "CANNOT_READ_FILE.PARQUET")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Current-version records; a missing manifest is an empty one, and so is one
    with a file that is no Parquet. Any other failure to read it is raised."""
    empty = spark.createDataFrame([], schemas.MANIFEST)
    try:
        manifest = spark.read.schema(schemas.MANIFEST).parquet(path)
        manifest.select(*[F.count(F.col(c)) for c in manifest.columns]).collect()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    except Exception as exc:
        if not any(sign in str(exc) for sign in CORRUPT):
            raise
        return empty
    return current_manifest(manifest)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Replace the manifest; staged first since it may be derived from the old one."""
    stage_table(manifest, "manifest").write.mode("overwrite").parquet(path)
