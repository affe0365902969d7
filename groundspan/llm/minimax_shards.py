"""Minimax contiguous shards: the smallest capacity that greedy filling can keep.

Groups of equal keys stay together. They stand in the order of their key; sizes
are summed along that order with a range shuffle, a window inside each range and
one offset per range. A shard is a run of groups, so all that matters is the set
of running sums at which groups end.

The capacity is found by binary search. Checking a capacity greedily takes one
step per shard: the largest running sum within the capacity. The driver knows a
bounded outline of the running sums and the gaps between the ones it knows. A
step that ends in a gap has a lowest and a highest possible end; if the check
comes out the same for both, the gap needs no look. Only gaps that leave a check
open are outlined further, each by at most ``OUTLINE`` sums, by a filter that
the stored table's statistics prune. So the search takes a handful of small
jobs at any size, and its result is exact.

Cases: a null text counts as an empty one (size 1, crc32 0). A group larger than
all else sets the capacity by itself. Rows, repeated ones included, each get
their own slot. With fewer groups than shards the last shards stay empty. An
empty table gives no rows. Results carry only their own columns.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundspan.staging import stage_table

OUTLINE = 512


class RunningSums:
    """The running sums known so far, of those in ``table`` (column ``cum``)."""

    def __init__(self, table: DataFrame, total: int):
        self.table, self.total = table, total
        self.known: list[int] = [0, total]
        self.whole: set[int] = set()  # starts of gaps that hold no further sum

    def ends(self, limit: int) -> tuple[int, int, int | None]:
        """Lowest and highest possible largest sum up to ``limit``, and the open gap."""
        at = bisect_right(self.known, limit) - 1
        low = self.known[at]
        if low == limit or at + 1 == len(self.known) or low in self.whole:
            return low, low, None
        return low, limit, low

    def check(self, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether ``shards`` runs within ``capacity`` hold everything, and the gaps in doubt."""
        low = high = 0
        gaps: set[int] = set()
        for _ in range(shards):
            first, _, gap = self.ends(low + capacity)
            _, last, other = self.ends(high + capacity)
            gaps |= {g for g in (gap, other) if g is not None}
            low, high = first, last
        if low >= self.total:
            return True, gaps
        return (False if high < self.total else None), gaps

    def outline(self, gaps: set[int]) -> None:
        """Learn up to ``OUTLINE`` more sums in each gap: the largest of each part of it."""
        bounds = [(g, self.known[bisect_right(self.known, g)]) for g in sorted(gaps)]
        part = None
        for begin, end in bounds:
            width = max(1, -(-(end - begin) // OUTLINE))
            inside = (F.col("cum") > begin) & (F.col("cum") < end)
            step = F.struct(F.lit(begin).alias("g"), F.floor((F.col("cum") - begin) / width).alias("p"))
            part = F.when(inside, step) if part is None else part.when(inside, step)
        inside = " or ".join(f"(cum > {b} and cum < {e})" for b, e in bounds)
        found = self.table.where(inside).groupBy(part.alias("part")).agg(F.max("cum").alias("cum")).collect()
        sums = sorted(r["cum"] for r in found)
        self.known = sorted({*self.known, *sums})
        for begin, end in bounds:
            if end - begin <= OUTLINE:  # parts of one
                at = self.known.index(begin)
                self.whole |= {k for k in self.known[at:] if k < end}
            elif not any(begin < s < end for s in sums):
                self.whole.add(begin)


def smallest_capacity(sums: RunningSums, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running sums at which its shards end."""
    low = max(-(-sums.total // shards), largest)
    high = low + largest  # always feasible
    while low < high:
        middle = (low + high) // 2
        fits, gaps = sums.check(middle, shards)
        if fits is None:
            sums.outline(gaps)
        elif fits:
            high = middle
        else:
            low = middle + 1
    cuts, at = [], 0
    while len(cuts) < shards:
        _, _, gap = sums.ends(at + high)
        if gap is not None:
            sums.outline({gap})
            continue
        at = sums.ends(at + high)[0]
        cuts.append(at)
    return high, cuts


def with_running_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``cum`` (sizes up to and with this row) and ``row`` (from 0)."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(*order)
    summed = stage_table(
        placed.withColumns(
            {
                "_cum": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "_row": F.row_number().over(inside).cast("bigint"),
            }
        ),
        "running-sums",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of the shuffle
    offsets = (
        summed.groupBy("_range")
        .agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        )
    )
    return (
        summed.join(F.broadcast(offsets), "_range")
        .withColumns({"cum": F.col("_cum") + F.col("_bytes"), "row": F.col("_row") - 1 + F.col("_rows")})
        .drop("_cum", "_row", "_bytes", "_rows", "_range")
    )


def contiguous_shards(rows: DataFrame, key: str, tie: str, size: str, shards: int) -> tuple[DataFrame, int]:
    """``rows`` (narrow: they are shuffled and stored) with ``shard`` and ``slot``; the capacity."""
    summed = stage_table(with_running_sums(rows, [key, tie], size), "shard-rows")
    ends = stage_table(
        summed.groupBy(key).agg(F.max("cum").alias("cum"), F.sum(size).alias("held")).select("cum", "held"),
        "group-ends",
    )
    sizes = ends.agg(F.max("held").alias("largest"), F.max("cum").alias("total")).first()
    if sizes["total"] is None:
        empty = F.lit(None)
        return summed.withColumns({"shard": empty.cast("int"), "slot": empty.cast("bigint")}), 0
    capacity, cuts = smallest_capacity(RunningSums(ends, sizes["total"]), sizes["largest"], shards)
    shard: Column = sum((F.col("cum") > cut).cast("int") for cut in cuts[:-1]) if shards > 1 else F.lit(0)
    placed = summed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))  # one row per shard
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("row") - F.col("_first"))
        .drop("cum", "row", "_first"),
        capacity,
    )


def sharding_query(docs: DataFrame, shards: int = 16) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("text_key"),
    )
    placed, _ = contiguous_shards(rows, "text_key", "doc_id", "size", shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
