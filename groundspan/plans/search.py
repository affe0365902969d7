"""Hybrid search of a whole table of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from groundspan.functions.text import strip_ws
from groundspan.operators.dense import Embedder, dense_topk, embed_column, hashing_embedder
from groundspan.operators.dense_approx import approx_topk
from groundspan.operators.fusion import balanced_topk, rrf_fuse
from groundspan.operators.lexical import bm25_topk
from groundspan.operators.rerank import Scorer, below_evidence, rerank
from groundspan.plans.index import SearchIndex
from groundspan.settings import Settings
from groundspan.staging import join_checked, stage_table


@dataclass(frozen=True)
class SearchResult:
    """``hits``: selected passages; ``diagnostics``: one row per question;
    ``rejects``: questions that were blank."""

    hits: DataFrame
    pool: DataFrame
    diagnostics: DataFrame
    rejects: DataFrame


def split_blank(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    blank = F.coalesce(F.length(strip_ws(F.col("query"))) == 0, F.lit(True))
    return questions.where(~blank), questions.where(blank)


def candidate_lists(
    questions: DataFrame,
    index: SearchIndex,
    settings: Settings,
    embedder: Embedder | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The dense and (in hybrid mode) the lexical ranking of every question.

    ``embedder`` embeds the questions; the passages have been embedded by the one
    that the index was built with, so a model may treat the two apart.
    """
    embedder = embedder or hashing_embedder(settings.embed_dim)
    vectors = embed_column(
        questions.select("query_id", "query", "scope"), embedder, text="query"
    )
    nearest = approx_topk if settings.dense_search == "buckets" else dense_topk
    dense = nearest(vectors, index.passages, settings.dense_k)
    if settings.retrieval_mode != "hybrid":
        return dense, None
    lexical = bm25_topk(
        questions.select("query_id", "query", "scope"),
        index.passages,
        index.stats,
        index.facts,
        settings.bm25_k,
        settings,
    )
    return dense, lexical


def hybrid_search(
    questions: DataFrame,
    index: SearchIndex,
    settings: Settings | None = None,
    embedder: Embedder | None = None,
    scorer: Scorer | None = None,
) -> SearchResult:
    """Dense and lexical top-k, fused, reranked and cut (or balanced).

    ``questions``: (query_id, query, mode, scope); mode ``compare`` balances
    over episodes when no scope is set.
    """
    settings = settings or index.settings
    valid, rejects = split_blank(questions)
    dense, lexical = candidate_lists(valid, index, settings, embedder)
    fused = rrf_fuse(dense, lexical, settings.rrf_k)

    # At most dense_k + bm25_k rows per question from here on.
    per_query = Window.partitionBy("query_id")
    pool = (
        fused.withColumn("dense_hits", F.count("dense_rank").over(per_query))
        .withColumn("bm25_hits", F.count("bm25_rank").over(per_query))
        .withColumn("max_dense_similarity", F.max("dense_score").over(per_query))
        .where(F.col("fused_rank") <= max(settings.fusion_k, settings.top_k))
    )
    pool = stage_table(pool, "fused-pool")
    passages = index.passages.select(
        "chunk_id", "episode_id", "episode_title", "start", "end", "text", "source_file", "tf"
    )
    wanted = pool.select("chunk_id").distinct()
    needed = join_checked(passages, wanted, "chunk_id", "left_semi", salt_by="chunk_id")
    ranked = rerank(
        pool.join(needed, "chunk_id"),
        valid,
        index.stats,
        index.facts,
        scorer,
        settings.enable_rerank,
    ).drop("tf")
    ranked = stage_table(
        ranked.join(valid.select("query_id", "mode", "scope"), "query_id"), "ranked-pool"
    )

    balance = F.lit(False)
    if settings.enable_compare_mode:
        balance = (F.col("mode") == "compare") & F.col("scope").isNull()
    plain = (
        ranked.where(~balance)
        .withColumn("rank", F.col("pool_rank"))
        .where(F.col("rank") <= settings.top_k)
    )
    hits = plain.unionByName(balanced_topk(ranked.where(balance), settings.top_k))

    facts = ranked.groupBy("query_id").agg(
        F.max("dense_hits").alias("dense_hits"),
        F.max("bm25_hits").alias("bm25_hits"),
        F.count("*").alias("fusion_pool"),
        F.max("max_dense_similarity").alias("max_dense_similarity"),
        F.max("rerank_score").alias("max_rerank_score"),
    )
    selected = hits.groupBy("query_id").agg(
        F.count("*").alias("num_selected"),
        F.countDistinct("episode_id").alias("num_episodes"),
        F.max_by("score", -F.col("rank")).alias("top_score"),
    )
    diagnostics = (
        valid.select("query_id", "mode", "scope")
        .join(facts, "query_id", "left")
        .join(selected, "query_id", "left")
        .na.fill(0, ["dense_hits", "bm25_hits", "fusion_pool", "num_selected", "num_episodes"])
        .na.fill(0.0, ["top_score"])
        .withColumn("rerank_enabled", F.col("max_rerank_score").isNotNull())
        .withColumn("relevance_gate", F.lit(index.gate).cast("double"))
        .withColumn(
            "not_covered",
            below_evidence(
                F.col("num_selected"),
                F.col("max_rerank_score"),
                F.col("relevance_gate"),
                F.col("max_dense_similarity"),
                settings,
            ),
        )
    )
    return SearchResult(hits, ranked, diagnostics, rejects)


def episodes_in_result(hits: DataFrame) -> DataFrame:
    """Distinct episodes of each result: sorted ids and titles in order of appearance.

    A result holds at most top_k rows, so the arrays are bounded.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "episode_title")))
    return hits.groupBy("query_id").agg(
        F.sort_array(F.collect_set("episode_id")).alias("episode_ids"),
        F.array_distinct(F.transform(ordered, lambda r: r["episode_title"])).alias("episodes"),
    )
