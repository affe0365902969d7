"""Exact quantiles per group without gathering a group's values anywhere.

Equal values are counted first, before anything moves. The distinct (group, value)
rows are range-partitioned, so a group of any size spreads over tasks; a value's rank is
what stands before it in its partition plus the counts of the partitions before. Only
the two values at the ranks a quantile lies between go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundspan.staging import stage_table


def exact_quantiles(df: DataFrame, keys: list[str], value: str, share: float, into: str) -> DataFrame:
    """(keys, ``into``): the ``share`` quantile of each group, linear between two ranks.

    Null values do not count; a group with no others has none. NaN is the largest value.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    # one key that is never null, as joins drop null keys
    names, keys = keys, ["_key"]
    df = df.select(F.to_json(F.struct(*names)).alias("_key"), F.struct(*names).alias("_names"), value)
    named = df.groupBy("_key").agg(F.any_value("_names").alias("_names"))
    held = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = stage_table(
        held.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "quantile-values"
    )
    # a row per partition and group in it
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"),
    )
    place = (F.col("_total") - 1) * F.lit(float(share))
    wanted = stage_table(offsets.join(sizes, [*keys, "_part"]).withColumn("_place", place), "quantile-places")
    # only partitions that hold one of the two ranks are looked at again
    reached = (F.col("_offset") <= F.ceil("_place")) & (F.col("_offset") + F.col("_size") > F.floor("_place"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(wanted.where(reached), [*keys, "_part"]).withColumn(
        "_first", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    last = F.col("_first") + F.col("_n") - 1
    at = lambda rank: F.max(F.when((F.col("_first") <= rank) & (last >= rank), F.col("_v")))
    low, high, rest = F.col("_low"), F.col("_high"), F.col("_rest")
    return (
        ranked.groupBy(*keys)
        .agg(at(F.floor("_place")).alias("_low"), at(F.ceil("_place")).alias("_high"), F.max(F.col("_place") - F.floor("_place")).alias("_rest"))
        .select(*keys, F.when(rest == 0, low).otherwise(low + (high - low) * rest).alias(into))
        .join(named, "_key")
        .select("_names.*", into)
    )
