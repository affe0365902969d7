"""Answering a table of messages: search, gate, prompt, model, citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.prompts import build_user_turn, cap_context, passages_of
from groundspan.functions.text import detect_mode, marker_found, strip_marker, strip_ws
from groundspan.operators.citations import (
    answer_sources,
    citation_summary,
    extract_citations,
    strip_citations,
    validate_citations,
)
from groundspan.operators.dense import Embedder
from groundspan.operators.model_hooks import Completer, batch_complete
from groundspan.operators.rerank import Scorer
from groundspan.plans.index import SearchIndex
from groundspan.plans.search import SearchResult, hybrid_search
from groundspan.settings import Settings
from groundspan.sources.replies import complete_once
from groundspan.staging import stage_table


@dataclass(frozen=True)
class Prompts:
    """The caller's instructions to the model."""

    system: str
    compare_note: str
    locate_note: str


@dataclass(frozen=True)
class AskResult:
    answers: DataFrame
    citations: DataFrame
    sources: DataFrame
    search: SearchResult


def plan_questions(messages: DataFrame, mode: str | None = None) -> DataFrame:
    """(query_id, message, query, mode, scope) out of messages with optional rewrites.

    ``mode`` forces a mode, as for a request to be taken to a place in the audio.
    """
    message = strip_ws(F.coalesce("message", F.lit("")))
    return messages.select(
        "query_id",
        message.alias("message"),
        F.coalesce("rewritten", message).alias("query"),
        (F.lit(mode) if mode else detect_mode(message)).alias("mode"),
        "scope",
        "history",
    )


def compose_prompts(
    questions: DataFrame, hits: DataFrame, prompts: Prompts, settings: Settings
) -> DataFrame:
    """The chat messages sent to the model for each question."""
    shown = passages_of(cap_context(hits, settings.max_context_chars))
    turn = build_user_turn(
        F.col("message"), F.col("passages"), F.col("mode"), F.col("query"),
        prompts.compare_note, prompts.locate_note,
    )
    recent = F.slice(
        "history",
        F.greatest(F.size("history") - 2 * settings.prompt_history_turns + 1, F.lit(1)),
        2 * settings.prompt_history_turns,
    )
    return (
        questions.join(shown, "query_id", "left")
        .withColumn("prompt", turn)
        .withColumn(
            "messages",
            F.concat(
                recent,
                F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))),
            ),
        )
    )


def finish_answers(
    raw: DataFrame, shown: DataFrame, episodes: DataFrame, settings: Settings
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model texts to checked answers: marker, citations, sources.

    ``raw``: (answer_id, raw_answer); ``shown``: passages in the prompt.
    """
    marked = raw.withColumn("not_covered", marker_found(F.col("raw_answer"))).withColumn(
        "answer", strip_marker(F.col("raw_answer"))
    )
    citations = stage_table(
        validate_citations(
            extract_citations(marked), shown, episodes, settings.citation_tolerance_seconds
        ),
        "citations",
    )
    answers = citation_summary(marked, citations).withColumn(
        "answer", strip_ws(
            F.when(F.col("num_invalid") > 0, strip_citations(F.col("answer"), F.col("invalid_raws")))
            .otherwise(F.col("answer"))
        ),
    )
    covered = shown.join(
        marked.where(~F.col("not_covered")).select("answer_id"), "answer_id", "left_semi"
    )
    sources = answer_sources(covered, citations, settings.citation_tolerance_seconds)
    return answers.drop("invalid_raws"), citations, sources


def ask(
    messages: DataFrame,
    index: SearchIndex,
    episodes: DataFrame,
    completer: Completer | None,
    prompts: Prompts,
    settings: Settings | None = None,
    embedder: Embedder | None = None,
    scorer: Scorer | None = None,
    mode: str | None = None,
    ledger: str | None = None,
) -> AskResult:
    """Answer every message. Without a completer the turn stops at the gate and
    open questions get an empty answer; the columns are the same.

    ``messages``: (query_id string, message, rewritten, scope, history). Refused
    questions are filtered out before the model stage, so they cost no call; with a
    ``ledger`` (a folder) what was answered before costs none either.
    """
    settings = settings or index.settings
    questions = plan_questions(messages, mode)
    search = hybrid_search(
        questions.withColumn(
            "mode", F.when(F.col("mode") == "compare", "compare").otherwise("default")
        ),
        index,
        settings,
        embedder,
        scorer,
    )
    verdict = stage_table(search.diagnostics.select("query_id", "not_covered"), "verdict")
    gated = questions.join(verdict, "query_id")
    base = questions.select("query_id", F.col("message").alias("question"), "query", "mode")
    refused = gated.where("not_covered").select(
        F.col("query_id").alias("answer_id"),
        F.lit(True).alias("not_covered"),
        F.lit(fv.NOT_COVERED_MESSAGE).alias("answer"),
    )
    blank = search.rejects.select(
        F.col("query_id").alias("answer_id"),
        F.lit(False).alias("not_covered"),
        F.lit(fv.EMPTY_QUESTION_MESSAGE).alias("answer"),
    )
    shown = cap_context(search.hits, settings.max_context_chars).withColumnRenamed(
        "query_id", "answer_id"
    )
    open_questions = gated.where(~F.col("not_covered"))
    if completer is None:
        none = F.lit(None).cast("string")
        replies = open_questions.select(
            F.col("query_id").alias("request_id"), F.lit("").alias("text"), none.alias("model"),
            F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
            none.alias("usage_cost"), none.alias("error"),
        )
    else:
        requests = compose_prompts(open_questions, search.hits, prompts, settings).select(
            F.col("query_id").alias("request_id"), F.lit(prompts.system).alias("system"), "messages"
        )
        called = complete_once(requests, completer, ledger) if ledger else batch_complete(requests, completer)
        replies = stage_table(called, "replies")
    done, citations, sources = finish_answers(
        replies.select(
            F.col("request_id").alias("answer_id"), F.coalesce("text", F.lit("")).alias("raw_answer")
        ),
        shown,
        episodes,
        settings,
    )
    answers = done.drop("raw_answer").join(
        replies.select(F.col("request_id").alias("answer_id"), "model", "input_tokens",
                       "output_tokens", "usage_cost", "error"),
        "answer_id",
    ).unionByName(refused.unionByName(blank), allowMissingColumns=True)
    answers = answers.join(base.withColumnRenamed("query_id", "answer_id"), "answer_id")
    return AskResult(answers, citations, sources, search)
