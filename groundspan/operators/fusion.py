"""Reciprocal rank fusion and per-episode balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Sum of ``1 / (k + rank)`` per (query_id, item_id) over any number of lists."""
    return ranked.groupBy("query_id", "item_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")
    )


def rrf_fuse(dense: DataFrame, lexical: DataFrame | None, k: int = 60) -> DataFrame:
    """Fuse both hit lists, keeping each rank and score (NULL where absent).

    A union and one grouping replace the full outer join. ``fused_rank`` orders
    by fused score, then dense rank, then lexical rank, then passage id.
    """
    hits = dense
    if lexical is not None:
        hits = dense.unionByName(lexical, allowMissingColumns=True)
    else:
        hits = hits.withColumn("bm25_score", F.lit(None).cast("double")).withColumn(
            "bm25_rank", F.lit(None).cast("int")
        )

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    fused = (
        hits.groupBy("query_id", "chunk_id")
        .agg(
            F.max("dense_rank").alias("dense_rank"),
            F.max("dense_score").alias("dense_score"),
            F.max("bm25_rank").alias("bm25_rank"),
            F.max("bm25_score").alias("bm25_score"),
        )
        .withColumn("score", share("dense_rank") + share("bm25_rank"))
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"),
        F.asc_nulls_last("dense_rank"),
        F.asc_nulls_last("bm25_rank"),
        F.asc("chunk_id"),
    )
    return fused.withColumn("fused_rank", F.row_number().over(order))


def balanced_topk(candidates: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Round-robin over episodes: every episode's best, then every second best.

    ``candidates`` is the bounded pool of a query, with ``pool_rank``. Episodes
    take turns in the order of their first candidate's score (rerank score
    where known, else fused score).
    """
    inside = Window.partitionBy("query_id", "episode_id").orderBy("pool_rank")
    best = F.coalesce("rerank_score", "score")
    turn = Window.partitionBy("query_id").orderBy(
        F.asc("_depth"), F.desc("_head"), F.asc("_head_rank")
    )
    return (
        candidates.withColumn("_depth", F.row_number().over(inside))
        .withColumn("_head", F.first(best).over(inside))
        .withColumn("_head_rank", F.first("pool_rank").over(inside))
        .withColumn(rank, F.row_number().over(turn))
        .where(F.col(rank) <= k)
        .drop("_depth", "_head", "_head_rank")
    )
