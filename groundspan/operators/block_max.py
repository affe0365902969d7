"""BM25 top-k that skips passages which cannot get in.

Passages lie in blocks, one row each with their postings inside. For every term a
block keeps the largest saturation of its passages, so the sum of a question's term
weights times these bounds what any passage of the block can score.

1. Every question's blocks get their bounds: a join of its terms with (term, block),
   which is much smaller than the postings.
2. The blocks with the highest bounds are scored; the k-th score found is a floor.
3. Of the rest only blocks whose bound reaches the floor are scored.

Questions travel to blocks, in slices of bounded size; a block moves once per phase, and
its postings never leave it. What goes on are k rows per question and block.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from groundspan.operators.lexical import SCORE_DP, CorpusFacts, query_terms, rank_topk
from groundspan.settings import Settings
from groundspan.staging import join_checked, stage_table

PASSAGES, SLICE, SEED_BLOCKS = 256, 512, 3
# Seconds of an episode that stay together, so that a block holds what belongs together.
STRETCH = 1_800
# Scores are rounded before they are ranked; a bound may be so much too low.
MARGIN = 2 * 10.0**-SCORE_DP


@dataclass(frozen=True)
class BlockIndex:
    """``blocks``: one row each; ``bounds``: (term, block, top); ``episodes``: (episode_id, block)."""

    blocks: DataFrame
    bounds: DataFrame
    episodes: DataFrame


def build_blocks(
    indexed: DataFrame, facts: CorpusFacts, settings: Settings = Settings(), passages: int = PASSAGES
) -> BlockIndex:
    """``indexed`` has (chunk_id, episode_id, start, dl, tf)."""
    count = max(1, -(-facts.passages // passages))
    k1, b = settings.bm25_k1, settings.bm25_b
    mean_length = facts.mean_length

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        terms = [p["term"] for tf in rows["tf"] for p in tf]
        times = np.array([p["tf"] for tf in rows["tf"] for p in tf], float)
        owner = np.repeat(np.arange(len(rows)), [len(tf) for tf in rows["tf"]])
        norm = k1 * (1 - b + b * rows["dl"].to_numpy(float) / mean_length)
        saturation = times / (times + norm[owner])
        names, number = np.unique(np.array(terms, object), return_inverse=True) if terms else (np.array([], object), np.array([], int))
        order = np.argsort(number, kind="stable")
        sizes = np.bincount(number, minlength=len(names))
        tops = np.zeros(len(names))
        np.maximum.at(tops, number, saturation)
        return pd.DataFrame(
            {
                "block": [rows["block"].iloc[0]],
                "chunk_ids": [rows["chunk_id"].tolist()],
                "episode_ids": [rows["episode_id"].tolist()],
                "terms": [names.tolist()],
                "tops": [tops.tolist()],
                "sizes": [sizes.astype(np.int32).tobytes()],
                "owners": [owner[order].astype(np.int32).tobytes()],
                "saturation": [saturation[order].tobytes()],
            }
        )

    shape = (
        "block bigint, chunk_ids array<string>, episode_ids array<string>, terms array<string>, tops array<double>, "
        "sizes binary, owners binary, saturation binary"
    )
    place = F.pmod(F.xxhash64("episode_id", F.floor(F.col("start") / STRETCH)), F.lit(count))
    blocks = stage_table(
        indexed.select(place.alias("block"), "chunk_id", "episode_id", "dl", "tf").groupBy("block").applyInPandas(pack, shape),
        "passage-blocks",
    )
    bounds = blocks.select("block", F.explode(F.arrays_zip("terms", "tops")).alias("t")).select(
        F.col("t.terms").alias("term"), "block", F.col("t.tops").alias("top")
    )
    episodes = blocks.select(F.explode(F.array_distinct("episode_ids")).alias("episode_id"), "block")
    return BlockIndex(blocks, stage_table(bounds, "block-bounds"), stage_table(episodes, "block-episodes"))


def _scores(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for batch in batches for r in batch.itertuples()):
            place = {t: i for i, t in enumerate(r.terms)}
            ends = np.cumsum(np.frombuffer(r.sizes, np.int32))
            begins = ends - np.frombuffer(r.sizes, np.int32)
            owners, saturation = np.frombuffer(r.owners, np.int32), np.frombuffer(r.saturation, float)
            chunk_ids, episodes = np.array(r.chunk_ids, object), np.array(r.episode_ids, object)
            out = []
            for q in r.asked:
                raw = np.zeros(len(chunk_ids))
                for w in q["weights"]:
                    at = place.get(w["term"])
                    if at is not None:
                        own = slice(begins[at], ends[at])
                        raw[owners[own]] += w["weight"] * saturation[own]
                fits = raw > 0
                if q["scope"] is not None:
                    fits &= episodes == q["scope"]
                found = np.flatnonzero(fits)
                if len(found) > k:  # those that may be among the first k once rounded
                    edge = np.partition(raw[found], len(found) - k)[len(found) - k]
                    found = found[raw[found] >= edge - MARGIN]
                out += [(q["query_id"], chunk_ids[i], float(raw[i])) for i in found]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "chunk_id", "raw"])

    return run


def bm25_topk_blocks(
    queries: DataFrame,
    index: BlockIndex,
    stats: DataFrame,
    k: int,
    settings: Settings = Settings(),
    seed_blocks: int = SEED_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """(what ``bm25_topk`` gives with an exact scope, (query_id, blocks, scored) per question)."""
    spark = queries.sparkSession
    weights = stage_table(
        query_terms(queries, stats)
        .where(F.col("idf").isNotNull())
        .select("query_id", "scope", "term", (F.col("idf") * F.col("qtf") * (settings.bm25_k1 + 1)).alias("weight")),
        "query-weights",
    )
    asked = weights.groupBy("query_id", "scope").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    asked = stage_table(asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(-(-max(1, asked.count()) // SLICE)))), "questions")
    bounded = (
        join_checked(index.bounds, weights, "term", "inner", salt_by="block")
        .groupBy("query_id", "scope", "block")
        .agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"))
        .where("bound > 0")
    )
    own = index.episodes.withColumnRenamed("episode_id", "scope")
    pairs = stage_table(
        bounded.where("scope is null").unionByName(bounded.join(own, ["scope", "block"], "left_semi")).drop("scope"),
        "question-blocks",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    ranked = stage_table(pairs.withColumn("place", F.row_number().over(best)), "ranked-blocks")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16_000_000)

    def scored(some: DataFrame) -> DataFrame:
        fields = F.collect_list(F.struct("query_id", "scope", "weights")).alias("asked")
        sliced = join_checked(some.select("query_id", "block"), asked, "query_id", "inner", salt_by="block").groupBy("block", "slice").agg(fields)
        met = sliced.drop("slice").join(index.blocks.drop("tops"), "block")
        return met.mapInPandas(_scores(k), "query_id string, chunk_id string, raw double")

    score = F.round("raw", SCORE_DP).alias("bm25_score")
    first = stage_table(scored(ranked.where(F.col("place") <= seed_blocks)).select("query_id", "chunk_id", score), "first-scores")
    floor = rank_topk(first, "bm25_score", "rank", k).where(F.col("rank") == k).select("query_id", F.col("bm25_score").alias("floor"))
    rest = ranked.where(F.col("place") > seed_blocks).join(floor, "query_id", "left")
    rest = stage_table(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN)), "open-blocks")
    found = first.unionByName(scored(rest).select("query_id", "chunk_id", score))
    visited = (
        ranked.join(rest.select("query_id", "block", F.lit(True).alias("open")), ["query_id", "block"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("blocks"), F.count_if((F.col("place") <= seed_blocks) | F.col("open")).alias("scored"))
    )
    return rank_topk(found, "bm25_score", "bm25_rank", k).select("query_id", "chunk_id", "bm25_score", "bm25_rank"), visited
