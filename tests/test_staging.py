"""Joins with a side past the bound of a broadcast."""

import pytest
from pyspark.sql import functions as F

from groundspan import staging


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_copies_of_a_large_side_are_not_broadcast(spark, how):
    big = spark.createDataFrame([(i % 700 if i % 9 else None, f"t{i % 5}", f"text {i}") for i in range(2000)], "k long, s string, text string")
    small = spark.createDataFrame([(i, f"t{j}", i + j) for i in range(0, 900, 3) for j in (1, 2)] + [(None, "t1", 0)], "k long, s string, y int")
    for on, rows in (("k", small.where("s = 't1'").drop("s")), (["k", "s"], small)):
        found, plain = staging.join_checked(big, rows, on, how, salt_by="text", max_rows=5), big.join(rows, on, how)
        assert found.columns == plain.columns
        assert sorted(found.collect(), key=repr) == sorted(plain.collect(), key=repr)
        # all that is broadcast is the map of the keys
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any("BroadcastHashJoin" in line and "_salt" in line for line in plan.splitlines())


def test_rows_that_cannot_match_stay_behind(spark):
    big = spark.range(10_000).select(F.col("id").alias("k"), F.lit("x").alias("a b"))
    small = spark.range(0, 20_000, 100).select(F.col("id").alias("k"))
    kept = {r["k"] for r in staging.may_match(big, small, ["k"]).collect()}
    assert set(range(0, 10_000, 100)) <= kept and len(kept) < 110
    other = small.select(F.col("k").cast("int").alias("k"))  # equal, with other hashes
    assert staging.may_match(big, other, ["k"]).count() == 10_000
    assert staging.may_match(big, small.limit(0), ["k"]).count() == 0
