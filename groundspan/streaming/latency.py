"""Event-time windows over timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundspan.staging import stage_path


def windowed_latency(timings: DataFrame, time: str, window: str, lateness: str) -> DataFrame:
    """Per window and stage: count, sum and maximum of ``ms``.

    Runs over what the source holds now. Each batch writes the windows it
    changed with its number; the newest row of a window is its result, so a batch
    that is repeated after a failure changes nothing.
    """
    spark = timings.sparkSession
    target = stage_path(spark, "windows")
    counted = (
        timings.withWatermark(time, lateness)
        .groupBy(F.window(time, window).alias("w"), "stage")
        .agg(F.count("*").alias("n"), F.sum("ms").alias("sum_ms"), F.max("ms").alias("max_ms"))
        .select(F.col("w.start").alias("window_start"), "stage", "n", "sum_ms", "max_ms")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    (
        counted.writeStream.outputMode("update")
        .option("checkpointLocation", stage_path(spark, "windows-checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
    last = F.max_by(F.struct("n", "sum_ms", "max_ms"), "batch").alias("r")
    return spark.read.parquet(target).groupBy("window_start", "stage").agg(last).select("window_start", "stage", "r.*")
