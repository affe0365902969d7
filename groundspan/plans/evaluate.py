"""Running a case table through search or answering, and scoring it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundspan.functions.text import detect_mode
from groundspan.operators.evaluation import (
    full_checks,
    outcomes,
    retrieval_checks,
    retrieval_metrics,
    retrieved_context,
)
from groundspan.plans.index import SearchIndex
from groundspan.plans.search import SearchResult, hybrid_search
from groundspan.settings import Settings


def case_questions(cases: DataFrame) -> DataFrame:
    """The scored (last) turn of every case as a search question."""
    asked = F.get("turns", F.size("turns") - 1)
    return cases.select(
        F.col("id").alias("query_id"),
        asked.alias("query"),
        F.when(detect_mode(asked) == "compare", "compare").otherwise("default").alias("mode"),
        F.lit(None).cast("string").alias("scope"),
    )


def search_cases(
    cases: DataFrame, index: SearchIndex, settings: Settings | None = None
) -> SearchResult:
    return hybrid_search(case_questions(cases), index, settings)


def evaluate_retrieval(
    cases: DataFrame, index: SearchIndex, settings: Settings | None = None
) -> DataFrame:
    """Outcome rows of a run that stops after the gate; no model is called."""
    found = search_cases(cases, index, settings)
    metrics = retrieval_metrics(cases, retrieved_context(found.hits), found.diagnostics)
    checks = retrieval_checks(metrics).select(
        "id", "category", "refusal", "episode_hit", "term_coverage", "num_retrieved",
        "num_episodes_retrieved", "top_score", "max_dense_similarity", "not_covered",
        "failures", "checks_passed",
    )
    return outcomes(cases, checks, None, None)


def evaluate_answers(
    cases: DataFrame,
    found: SearchResult,
    answers: DataFrame,
    judged: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Outcome rows of answered cases. ``answers`` is keyed by answer_id = case id."""
    metrics = retrieval_metrics(
        cases, retrieved_context(found.hits), found.diagnostics
    ).drop("not_covered")
    given = answers.select(
        F.col("answer_id").alias("id"),
        "answer",
        "not_covered",
        "num_citations",
        "num_invalid",
        "citation_validity",
        "reasons",
    )
    checked = full_checks(metrics.join(given, "id")).drop(
        "turns", "expected_episodes", "must_retrieve", "key_points", "clarify_ok",
        "must_cite", "forbidden_claims", "context",
    )
    return outcomes(cases, checked, judged, errors)
