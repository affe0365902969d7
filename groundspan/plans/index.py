"""Building the search tables of a corpus, once, in shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundspan.operators.dense import Embedder, embed_column, hashing_embedder
from groundspan.operators.lexical import CorpusFacts, term_statistics, with_terms
from groundspan.operators.rerank import (
    Scorer,
    calibrate_gate,
    probe_scores,
    probe_scores_with,
)
from groundspan.operators.segments import chunk_segments
from groundspan.settings import Settings
from groundspan.staging import stage_table


@dataclass(frozen=True)
class SearchIndex:
    """Passages with term counts and vectors, term statistics, and the gate."""

    passages: DataFrame
    stats: DataFrame
    facts: CorpusFacts
    gate: float | None
    settings: Settings

    def meta(self) -> DataFrame:
        """One row about the index; the episode list itself is ``episodes()``."""
        return self.passages.agg(
            F.count("*").alias("num_chunks"),
            F.countDistinct("episode_id").alias("num_episodes"),
            F.lit(self.settings.embed_dim).cast("bigint").alias("embed_dimension"),
            F.lit(self.gate).cast("double").alias("relevance_gate"),
        )

    def episodes(self) -> DataFrame:
        return self.passages.select("episode_id").distinct().orderBy("episode_id")


def build_index(
    transcripts: DataFrame,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
    scorer: Scorer | None = None,
) -> SearchIndex:
    """Transcripts to search tables.

    Passages, term counts and vectors come out of one narrow pass over the
    transcripts; only the term counts need a shuffle.
    """
    chunks = chunk_segments(transcripts, settings)
    return index_passages(chunks, settings, embedder, scorer)


def index_passages(
    chunks: DataFrame,
    settings: Settings = Settings(),
    embedder: Embedder | None = None,
    scorer: Scorer | None = None,
) -> SearchIndex:
    embedder = embedder or hashing_embedder(settings.embed_dim)
    passages = stage_table(embed_column(with_terms(chunks), embedder), "passages")
    raw_stats, facts = term_statistics(passages, settings)
    stats = stage_table(raw_stats, "term-stats")
    if settings.gate_override is not None:
        gate = settings.gate_override
    elif facts.passages == 0 or not settings.enable_rerank:
        gate = None
    else:
        probes = (
            probe_scores(passages, stats, facts)
            if scorer is None
            else probe_scores_with(passages, scorer)
        )
        gate = calibrate_gate(probes, settings.gate_margin).first()["relevance_gate"]
    return SearchIndex(passages, stats, facts, gate, settings)
