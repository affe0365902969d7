"""One plain dataclass with every tunable of the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # passage building (seconds)
    chunk_target_seconds: float = 75.0
    chunk_max_seconds: float = 110.0
    chunk_overlap_seconds: float = 15.0

    # retrieval cascade: 20 + 20 -> 8 -> 5
    dense_k: int = 20
    bm25_k: int = 20
    fusion_k: int = 8
    top_k: int = 5
    rrf_k: int = 60
    retrieval_mode: str = "hybrid"  # or "dense"
    dense_search: str = "exact"  # or "buckets": approximate, by bucketed random projections
    enable_rerank: bool = True
    enable_compare_mode: bool = True
    # False reproduces the historical behaviour of filtering a scoped lexical
    # search after the top 3k; True filters before ranking and loses nothing.
    exact_scope: bool = True

    # lexical model
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    # refusal
    min_relevance: float = 0.30
    gate_override: float | None = None
    # The built-in scorer lives in 0..1, so its margin is a tenth of the one
    # that suits an unbounded model score.
    gate_margin: float = 0.1

    # conversation and prompt
    max_context_chars: int = 16_000
    history_turns: int = 8
    prompt_history_turns: int = 4
    rewrite_context_messages: int = 4
    rewrite_message_chars: int = 400
    rewrite_max_chars: int = 300
    enable_query_rewrite: bool = True

    # citations
    citation_tolerance_seconds: float = 5.0

    # dense vectors from the built-in hashing embedder
    embed_dim: int = 64

    # ingest identity
    asr_provider: str = "local"
    asr_model: str = "medium"
    asr_language: str = "en"

    @property
    def asr_fingerprint(self) -> str:
        return f"{self.asr_provider}:{self.asr_model}:{self.asr_language}"

    @property
    def hard_max_seconds(self) -> float:
        return max(self.chunk_max_seconds, self.chunk_target_seconds)

    @property
    def overlap_seconds(self) -> float:
        return min(self.chunk_overlap_seconds, self.chunk_target_seconds / 2)
