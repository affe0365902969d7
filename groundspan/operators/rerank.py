"""Second-stage relevance, the corpus-calibrated gate, and the refusal decision."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import normalize_query, tokenize
from groundspan.operators.lexical import SCORE_DP, CorpusFacts, query_terms
from groundspan.settings import Settings

# Scores (topic, passage text) pairs; one call per Arrow batch.
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def topic_weights(queries: DataFrame, stats: DataFrame, facts: CorpusFacts) -> DataFrame:
    """Per query the distinct topic terms with their idf, as one sorted array."""
    terms = query_terms(
        queries.withColumn("query", normalize_query(F.col("query"))), stats
    ).select(
        "query_id",
        F.struct(
            "term", F.coalesce("idf", F.lit(facts.idf_of_unseen())).alias("idf")
        ).alias("t"),
    )
    # The array holds the terms of one question.
    return terms.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("topic"))


def matched_share(topic: Column, passage_terms: Column) -> Column:
    """Share of the topic's idf mass found in the passage; 0 without topic terms."""

    def mass(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["idf"])

    found = F.filter(topic, lambda t: F.array_contains(passage_terms, t["term"]))
    return F.coalesce(F.try_divide(mass(found), mass(topic)), F.lit(0.0))


def rerank(
    pool: DataFrame,
    queries: DataFrame,
    stats: DataFrame,
    facts: CorpusFacts,
    scorer: Scorer | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Score the small fused pool and order it; adds rerank_score and pool_rank.

    ``pool`` carries ``text`` and ``tf`` of each passage. Without a scorer the
    share of matched idf is used. When reranking is disabled the score stays
    NULL and the fused order stands.
    """
    if not enabled:
        scored = pool.withColumn("rerank_score", F.lit(None).cast("double"))
    elif scorer is None:
        weights = topic_weights(queries, stats, facts)
        scored = pool.join(weights, "query_id", "left").withColumn(
            "rerank_score",
            F.round(matched_share(F.col("topic"), F.col("tf.term")), SCORE_DP),
        ).drop("topic")
    else:

        @F.pandas_udf("double")
        def score(topics: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series(list(scorer(topics.tolist(), texts.tolist())), dtype="float64")

        topics = queries.select("query_id", normalize_query(F.col("query")).alias("topic"))
        scored = (
            pool.join(topics, "query_id")
            .withColumn("rerank_score", F.round(score("topic", "text"), SCORE_DP))
            .drop("topic")
        )
    order = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last("rerank_score"), F.asc("fused_rank")
    )
    return scored.withColumn("pool_rank", F.row_number().over(order))


def probe_queries(spark: SparkSession) -> DataFrame:
    rows = [(i, text, None) for i, text in enumerate(fv.NEGATIVE_PROBES)]
    return spark.createDataFrame(rows, "query_id int, query string, scope string")


def probe_scores(indexed: DataFrame, stats: DataFrame, facts: CorpusFacts) -> DataFrame:
    """Best built-in score of each fixed probe over all passages (0 if none match).

    An equi-join on the probes' few terms: passages without any of them score 0
    and never leave the scan.
    """
    probes = probe_queries(indexed.sparkSession)
    idf = query_terms(probes, stats, constant=True).select(
        "query_id",
        "term",
        F.coalesce("idf", F.lit(facts.idf_of_unseen())).alias("idf"),
    )
    mass = idf.groupBy("query_id").agg(F.sum("idf").alias("mass"))
    postings = indexed.select("chunk_id", F.explode("tf.term").alias("term"))
    best = (
        postings.join(F.broadcast(idf), "term")  # eight short probes
        .groupBy("query_id", "chunk_id")
        .agg(F.sum("idf").alias("found"))
        .groupBy("query_id")
        .agg(F.max("found").alias("found"))
    )
    return (
        probes.join(mass, "query_id", "left")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            F.col("query").alias("probe"),
            F.round(F.coalesce(F.col("found") / F.col("mass"), F.lit(0.0)), SCORE_DP).alias(
                "best_score"
            ),
        )
    )


def probe_scores_with(passages: DataFrame, scorer: Scorer) -> DataFrame:
    """Best score of each probe under a user scorer; probes are scored verbatim."""
    probes = list(fv.NEGATIVE_PROBES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                texts = batch["text"].tolist()
                best = [max(scorer([p] * len(texts), texts)) for p in probes]
                yield pd.DataFrame(
                    {"query_id": range(len(probes)), "probe": probes, "best_score": best}
                )

    per_batch = passages.select("text").mapInPandas(
        run, "query_id int, probe string, best_score double"
    )
    return per_batch.groupBy("query_id", "probe").agg(F.max("best_score").alias("best_score"))


def calibrate_gate(scores: DataFrame, margin: float) -> DataFrame:
    """One row: the score band of unanswerable probes, and the gate above it."""
    return scores.agg(
        F.count("*").alias("probes"), F.max("best_score").alias("not_covered_band_max")
    ).withColumn("relevance_gate", F.round(F.col("not_covered_band_max") + F.lit(margin), 4))


def below_evidence(
    n_hits: Column, max_rerank: Column, gate: Column, max_dense: Column, settings: Settings
) -> Column:
    """True when retrieval is too weak to answer from.

    No hits refuse. With a rerank score and a gate these decide; else the best
    cosine does against the fixed minimum; with neither the gate stays open.
    """
    return (
        F.when(F.coalesce(n_hits, F.lit(0)) == 0, True)
        .when(max_rerank.isNotNull() & gate.isNotNull(), max_rerank < gate)
        .otherwise(F.coalesce(max_dense < settings.min_relevance, F.lit(False)))
    )
