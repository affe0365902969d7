"""Comparing two evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundspan.functions import fixed_values as fv


def latest_records(records: DataFrame) -> DataFrame:
    """Last record of each (run, case) by its ``line``, which may be a struct."""
    whole = F.max_by(F.struct(*records.columns), F.col("line")).alias("r")
    return records.groupBy("run_label", "id").agg(whole).select("r.*")


def _format(value: Column, kind: str, signed: bool) -> Column:
    sign = "+" if signed else ""
    if kind == "pct":
        return F.format_string(f"%{sign}.1f%%", F.round(value * 100, 1))
    if kind == "score":
        return F.format_string(f"%{sign}.2f", F.round(value, 2))
    if kind == "ms":
        return F.format_string(f"%{sign}.2fs", F.round(value / 1000, 2))
    if kind == "usd":
        return F.format_string(f"%{sign}.4f" if signed else "$%.4f", F.round(value, 4))
    return F.format_string(f"%{sign}d", value.cast("bigint"))


def compare_metrics(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """Metric rows with both values, the change, and whether it is for the better.

    Each input is a one-row summary; metrics missing from both are left out.
    """

    def rows(summary: DataFrame, into: str) -> DataFrame:
        cells = [
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias(into))
            for name, _, _ in fv.COMPARED_METRICS
            if name in summary.columns
        ]
        return summary.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

    spark = baseline.sparkSession
    kinds = spark.createDataFrame(
        fv.COMPARED_METRICS, "metric string, kind string, higher_is_better boolean"
    )
    both = rows(baseline, "before").join(rows(improved, "after"), "metric", "full_outer")
    change = F.col("after") - F.col("before")
    moved = F.abs(change) >= 1e-9

    def text(value: Column, signed: bool = False) -> Column:
        shown = F.lit(None).cast("string")
        for kind in ("pct", "score", "ms", "usd", "int"):
            shown = F.when(F.col("kind") == kind, _format(value, kind, signed)).otherwise(shown)
        return shown

    return (
        both.where(F.col("before").isNotNull() | F.col("after").isNotNull())
        .join(F.broadcast(kinds), "metric")
        .withColumn("delta", change)
        .withColumn("before_text", F.coalesce(text(F.col("before")), F.lit("—")))
        .withColumn("after_text", F.coalesce(text(F.col("after")), F.lit("—")))
        .withColumn(
            "delta_text",
            F.when(change.isNull(), "—").when(~moved, "0").otherwise(text(change, signed=True)),
        )
        .withColumn(
            "improved", F.when(moved, F.when(F.col("higher_is_better"), change > 0).otherwise(change < 0))
        )
    )


def compare_categories(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """passed/total per category on both sides; categories of either run appear."""

    def side(df: DataFrame, into: str) -> DataFrame:
        return df.where(F.col("category").isNotNull()).select(
            "category",
            F.concat_ws("/", F.col("passed").cast("string"), F.col("total").cast("string")).alias(
                into
            ),
        )

    return side(baseline, "baseline").join(side(improved, "improved"), "category", "full_outer")


def case_movement(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """Cases in both runs whose verdict changed, with reasons for regressions."""
    was = baseline.select("id", F.col("passed").alias("was"))
    now = improved.select("id", F.col("passed").alias("now"), "failures", "error")
    reasons = F.coalesce(
        F.nullif(F.array_join("failures", "; "), F.lit("")), F.col("error"), F.lit("")
    )
    return (
        was.join(now, "id")
        .where(F.col("was") != F.col("now"))
        .select(
            "id",
            F.when(F.col("now"), "fixed").otherwise("regressed").alias("movement"),
            F.when(F.col("now"), "").otherwise(reasons).alias("reasons"),
        )
    )
