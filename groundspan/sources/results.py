"""Evaluation cases in, run records and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from groundspan import schemas
from groundspan.operators.evaluation import normalise_cases, validate_cases
from groundspan.operators.ordering import with_global_index
from groundspan.operators.runs import latest_records
from groundspan.staging import stage_table


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Validated cases from JSON lines; ids default to the position in the file."""
    lines = read_lines(spark, path, schemas.CASE).withColumnRenamed("line", "_line")
    cases = normalise_cases(with_global_index(lines, "_line"))
    problems = stage_table(validate_cases(cases), "case-problems")
    count = problems.count()
    if count:
        path = problems.inputFiles()[0].rsplit("/", 1)[0]
        raise ValueError(f"{count} problems, all of them in {path}; first: {problems.first()['problem']}")
    if cases.isEmpty():
        raise ValueError(f"{path} contains no cases")
    return cases


def write_run(records: DataFrame, summary: DataFrame, root: str, label: str) -> None:
    """``raw``: one JSON line per case; ``summary``: one line."""
    target = f"{root}/run_label={label}"
    records.write.mode("overwrite").json(f"{target}/raw")
    summary.coalesce(1).write.mode("overwrite").json(f"{target}/summary")


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with ``line``, which orders them as they stand in their files.

    Files come by name. Inside a file it is the place of the split and the order within
    it that count, so the order is the same for any size of splits.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return spark.read.schema(schema).json(path).select("*", place.alias("line"))


def read_run(
    spark: SparkSession, root: str, label: str, record_schema: str | StructType, summary_schema: str | StructType
) -> tuple[DataFrame, DataFrame]:
    """Records (the last one of each case id) and summary of a named run."""
    target = f"{root}/run_label={label}"
    records = latest_records(read_lines(spark, f"{target}/raw", record_schema).withColumn("run_label", F.lit(label)))
    summary = spark.read.schema(summary_schema).json(f"{target}/summary")
    return records.drop("line", "run_label"), summary
