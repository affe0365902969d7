"""Every registered query: name -> function of (spark, data folder)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions import timefmt
from groundspan.functions.prompts import (
    build_judge_prompt,
    build_user_turn,
    cap_context,
    passages_of,
    render_context,
)
from groundspan.functions.text import (
    contains_term,
    context_dependent,
    derive_title,
    detect_mode,
    marker_found,
    normalize_query,
    redact_map,
    slug_id,
    strip_marker,
    tokenize,
)
from groundspan.operators import citations as cit
from groundspan.operators import evaluation as ev
from groundspan.operators import ingest as ing
from groundspan.operators import model_hooks as hooks
from groundspan.operators import runs, sessions
from groundspan.operators.block_max import bm25_topk_blocks, build_blocks
from groundspan.operators.dense import dense_topk, embed_column, hashing_embedder
from groundspan.operators.dense_approx import approx_topk
from groundspan.operators.fusion import balanced_topk, rrf, rrf_fuse
from groundspan.operators.lexical import bm25_topk
from groundspan.operators.long_episodes import chunk_long
from groundspan.operators.rerank import below_evidence, calibrate_gate, probe_scores
from groundspan.operators.segments import (
    chunk_segments,
    episode_outline,
    episode_stats,
    transcript_text,
)
from groundspan.plans.ask import Prompts, ask
from groundspan.plans.evaluate import evaluate_answers, evaluate_retrieval
from groundspan.plans.rewrite import rewrite_turns
from groundspan.plans.search import candidate_lists, episodes_in_result
from groundspan.sources import chunk_store, results
from groundspan.sources.transcripts import read_transcripts, render_transcript, write_transcripts
from groundspan.staging import stage_path, stage_table
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(array, sep: str = ","):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


# --- sources and identity ---------------------------------------------------
@query
def catalogue_scan(spark, sf):
    """Pages as files: known media suffixes only."""
    return ing.catalogue_scan(fx.files(spark, sf)).select("name", "size", "rejected")


@query
def content_hash(spark, sf):
    return fx.files(spark, sf).select("page_id", F.sha2("html", 256).alias("sha256"))


@query
def slug_ids(spark, sf):
    return fx.files(spark, sf).select("name", slug_id(F.col("name")).alias("slug"))


@query
def derive_titles(spark, sf):
    return fx.files(spark, sf).select("name", derive_title(F.col("name")).alias("title"))


@query
def slug_dedup(spark, sf):
    return ing.identify(fx.shared_names(spark, sf)).select(
        "name", "slug", "episode_id", "title"
    )


# --- segments and passages --------------------------------------------------
def _segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("episode_id", F.explode("segments").alias("s")).select(
        "episode_id", "s.id", "s.start", "s.end", "s.text"
    )


@query
def clean_segments(spark, sf):
    return _segments(fx.transcripts(spark, sf))


@query
def chunk_passages(spark, sf):
    return chunk_segments(fx.transcripts(spark, sf), fx.SETTINGS).select(
        "chunk_id", "episode_id", "episode_title", "start", "end", "text", "source_file",
        joined("segment_ids").alias("segment_ids"),
    )


@query
def long_passages(spark, sf):
    """The same passages from flat segments, in blocks of a hundred side by side."""
    flat = fx.transcripts(spark, sf).select("episode_id", "episode_title", "source_file", F.explode("segments").alias("s")).select(
        "episode_id", "episode_title", "source_file", "s.id", "s.start", "s.end", "s.text"
    )
    return chunk_long(flat, fx.SETTINGS, block=100).withColumn("segment_ids", joined("segment_ids"))


@query
def per_episode_stats(spark, sf):
    return episode_stats(fx.transcripts(spark, sf), fx.search_index(spark, sf).passages)


@query
def transcript_texts(spark, sf):
    return fx.transcripts(spark, sf).select(
        "episode_id", F.md5(transcript_text(F.col("segments"))).alias("text_md5")
    )


@query
def render_transcripts(spark, sf):
    return fx.transcripts(spark, sf).select(
        "episode_id", F.md5(render_transcript()).alias("rendered_md5")
    )


@query
def outline(spark, sf):
    return episode_outline(fx.episodes(spark, sf), fx.search_index(spark, sf).passages)


@query
def read_transcript_files(spark, sf):
    """Transcripts written as JSON and read back with the declared schema."""
    path = stage_path(spark, "transcripts-json")
    write_transcripts(fx.transcripts(spark, sf), path)
    return _segments(read_transcripts(spark, path)[0])


@query
def chunk_store_roundtrip(spark, sf):
    path = stage_path(spark, "chunk-store")
    chunk_store.write_chunks(chunk_segments(fx.transcripts(spark, sf), fx.SETTINGS), path)
    return chunk_store.read_chunks(spark, path).select("chunk_id", "episode_id", "start", "end")


# --- incremental ingest -----------------------------------------------------
def _present(spark, sf):
    return fx.transcripts(spark, sf).select(
        "episode_id", F.col("source_sha256").alias("sha256")
    )


def _stored(spark, sf):
    """Transcripts of very short documents are missing from the store."""
    return fx.transcripts(spark, sf).where("duration >= 20").select("episode_id")


def _plan(spark, sf):
    return ing.ingest_plan(
        _present(spark, sf),
        fx.previous_manifest(spark, sf),
        _stored(spark, sf),
        fx.SETTINGS.asr_fingerprint,
    )


@query
def manifest_current(spark, sf):
    return ing.current_manifest(fx.previous_manifest(spark, sf)).select(
        "episode_id", "sha256", "asr_fingerprint"
    )


@query
def ingest_plan(spark, sf):
    return _plan(spark, sf).select("episode_id", "sha256", "action", "reason")


@query
def prune_removed(spark, sf):
    return ing.removed_episodes(fx.previous_manifest(spark, sf), _present(spark, sf)).select(
        "episode_id", "title"
    )


def _next_manifest(spark, sf):
    return ing.next_manifest(
        fx.transcripts(spark, sf), fx.search_index(spark, sf).passages, fx.SETTINGS.asr_fingerprint
    )


@query
def ingest_stats(spark, sf):
    return ing.ingest_stats(_plan(spark, sf), _next_manifest(spark, sf))


@query
def episode_catalogue(spark, sf):
    return ing.episode_catalogue(_next_manifest(spark, sf))


@query
def index_meta(spark, sf):
    return fx.search_index(spark, sf).meta()


# --- scalar functions -------------------------------------------------------
@query
def tokenized(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id",
        F.size(tokenize(F.col("text"))).cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(tokenize(F.col("text")), " ")).alias("tokens_md5"),
    )


@query
def normalized_queries(spark, sf):
    return fx.messages(spark, sf).select(
        "id", normalize_query(F.col("message")).alias("topic")
    )


@query
def message_modes(spark, sf):
    """Mode of every benchmark message and every conversation message."""
    both = fx.messages(spark, sf).select("id", "message").unionByName(
        fx.table(spark, sf, "conversations").select(
            F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("message")
        )
    )
    return both.select(
        "id",
        detect_mode(F.col("message")).alias("mode"),
        context_dependent(F.col("message")).alias("context_dependent"),
    )


@query
def formatted_times(spark, sf):
    seg = _segments(fx.transcripts(spark, sf))
    start, end = F.col("start"), F.col("end")
    return seg.select(
        "episode_id",
        "id",
        timefmt.format_ts(start * 10).alias("ts"),
        timefmt.format_range(start, end).alias("range"),
        timefmt.format_duration(end * 7).alias("duration"),
        timefmt.parse_ts(timefmt.format_ts(start * 10)).alias("parsed"),
        timefmt.parse_ts(F.concat(timefmt.format_ts(end), F.lit("."), F.col("id").cast("string"))).alias(
            "parsed_fraction"
        ),
        timefmt.parse_ts(F.substring("text", 1, 4)).alias("parsed_text"),
    )


@query
def contained_terms(spark, sf):
    """Whether the expected terms of a case occur in its own gold documents."""
    cases = fx.cases(spark, sf).select("id", F.explode("must_retrieve").alias("term"))
    docs = fx.documents(spark, sf).select(F.col("doc_id").cast("string").alias("episode_id"), "text")
    return (
        fx.gold(spark, sf)
        .join(docs, "episode_id")
        .join(cases, "id")
        .select(
            "id", "episode_id", "term",
            contains_term(F.col("text"), F.col("term")).alias("found"),
        )
    )


@query
def redacted(spark, sf):
    payload = F.create_map(
        F.lit("K"), F.get_json_object("props", "$.k"),
        F.concat("event_type", F.lit("_Token")), F.col("props"),
        F.lit("api_key"), F.col("user_id").cast("string"),
    )
    clean = redact_map(payload)
    return fx.table(spark, sf, "events").select(
        "event_id",
        joined(F.map_keys(clean)).alias("keys"),
        joined(F.map_values(clean), "|").alias("vals"),
    )


# --- retrieval --------------------------------------------------------------
@query
def bm25_stats(spark, sf):
    return fx.search_index(spark, sf).stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_top(spark, sf):
    ix = fx.search_index(spark, sf)
    return bm25_topk(fx.questions(spark, sf), ix.passages, ix.stats, ix.facts, 20, fx.SETTINGS)


def _block_search(spark, sf):
    ix = fx.search_index(spark, sf)
    blocks = fx.remember(spark, sf, "blocks", lambda: build_blocks(ix.passages, ix.facts, fx.SETTINGS))
    return bm25_topk_blocks(fx.questions(spark, sf), blocks, ix.stats, 20, fx.SETTINGS)


@query
def bm25_top_blocks(spark, sf):
    """The same ranking without scoring passages that cannot get in."""
    return _block_search(spark, sf)[0]


@query
def bm25_blocks_scored(spark, sf):
    """Blocks that hold a question's words, and how many of them were scored."""
    return _block_search(spark, sf)[1]


@query
def scoped_search(spark, sf):
    """BM25 with the scope applied before ranking (exact)."""
    ix = fx.search_index(spark, sf)
    asked = fx.questions(spark, sf, fx.scopes(spark, sf))
    return bm25_topk(asked, ix.passages, ix.stats, ix.facts, 20, fx.SETTINGS)


@query
def scoped_search_post_filter(spark, sf):
    """BM25 with the scope applied after the top 3k."""
    from dataclasses import replace

    ix = fx.search_index(spark, sf)
    asked = fx.questions(spark, sf, fx.scopes(spark, sf))
    return bm25_topk(
        asked, ix.passages, ix.stats, ix.facts, 20, replace(fx.SETTINGS, exact_scope=False)
    )


def _lists(spark, sf):
    def make():
        dense, lexical = candidate_lists(
            fx.questions(spark, sf), fx.search_index(spark, sf), fx.SETTINGS
        )
        return stage_table(dense, "dense-list"), stage_table(lexical, "lexical-list")

    return fx.remember(spark, sf, "lists", make)


@query
def dense_top(spark, sf):
    """Question vectors against all passage vectors."""
    ix = fx.search_index(spark, sf)
    asked = embed_column(fx.questions(spark, sf), hashing_embedder(64), text="query")
    return dense_topk(asked, ix.passages, 20)


@query
def dense_top_approx(spark, sf):
    """The same by bucketed random projections: the passages that share a bucket."""
    ix = fx.search_index(spark, sf)
    asked = embed_column(fx.questions(spark, sf), hashing_embedder(64), text="query")
    return approx_topk(asked, ix.passages, 20)


@query
def dense_top_vectors(spark, sf):
    """The mean vector of every label against the whole embeddings table."""
    vectors = fx.table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    asked = means.select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("query_id"),
        F.transform("v", lambda p: F.round(p["x"], 6).cast("float")).alias("vector"),
        F.lit(None).cast("string").alias("scope"),
    )
    passages = vectors.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label").cast("string").alias("episode_id"),
        F.col("embedding").alias("vector"),
    )
    return dense_topk(asked, passages, 20)


@query
def dense_top_scoped(spark, sf):
    """The same, each label limited to its own vectors before ranking."""
    ix = fx.search_index(spark, sf)
    asked = embed_column(
        fx.questions(spark, sf, fx.scopes(spark, sf)), hashing_embedder(64), text="query"
    )
    return dense_topk(asked, ix.passages, 20)


@query
def embed_passages(spark, sf):
    """Vectors of all passages, checked through their components."""
    return fx.search_index(spark, sf).passages.select(
        "chunk_id", F.posexplode("vector").alias("slot", "v")
    ).select("chunk_id", "slot", F.round(F.col("v").cast("double"), 5).alias("v"))


@query
def rrf_scores(spark, sf):
    dense, lexical = _lists(spark, sf)
    ranked = dense.select(
        "query_id", F.col("chunk_id").alias("item_id"), F.col("dense_rank").alias("rank")
    ).unionByName(
        lexical.select(
            "query_id", F.col("chunk_id").alias("item_id"), F.col("bm25_rank").alias("rank")
        )
    )
    return rrf(ranked, 60).withColumn("score", F.round("score", 8))


@query
def rrf_fused(spark, sf):
    dense, lexical = _lists(spark, sf)
    return rrf_fuse(dense, lexical, 60).withColumn("score", F.round("score", 8))


def _hits(df):
    return df.select(
        "query_id", "rank", "chunk_id", "episode_id", F.round("score", 6).alias("score"),
        "dense_rank", "bm25_rank", "dense_score", "bm25_score", "rerank_score",
    )


@query
def reranked(spark, sf):
    return fx.question_search(spark, sf).pool.select(
        "query_id", "chunk_id", "fused_rank", "rerank_score", "pool_rank"
    )


@query
def balanced_top(spark, sf):
    """Every question's pool balanced over the sources its passages come from."""
    pool = fx.question_search(spark, sf).pool.withColumn(
        "episode_id", F.split("source_file", "/")[0]
    )
    return balanced_topk(pool, 5).select("query_id", "rank", "chunk_id", "episode_id")


@query
def hybrid_search(spark, sf):
    return _hits(fx.question_search(spark, sf).hits)


@query
def query_diagnostics(spark, sf):
    return fx.question_search(spark, sf).diagnostics.select(
        "query_id", "mode", "dense_hits", "bm25_hits", "fusion_pool", "max_dense_similarity",
        "max_rerank_score", "num_selected", "num_episodes",
        F.round("top_score", 6).alias("top_score"), "relevance_gate",
    )


@query
def episodes_found(spark, sf):
    return episodes_in_result(fx.question_search(spark, sf).hits).select(
        "query_id",
        joined("episode_ids").alias("episode_ids"),
        joined("episodes", "|").alias("episodes"),
    )


@query
def gate_calibration(spark, sf):
    ix = fx.search_index(spark, sf)
    return calibrate_gate(
        probe_scores(ix.passages, ix.stats, ix.facts), fx.SETTINGS.gate_margin
    )


@query
def probe_best_scores(spark, sf):
    ix = fx.search_index(spark, sf)
    return probe_scores(ix.passages, ix.stats, ix.facts).select("probe", "best_score")


@query
def evidence_gate(spark, sf):
    """Refusal with the gate, without it (cosine), and without any hit."""
    d = fx.question_search(spark, sf).diagnostics
    n, best, gate, dense = (
        F.col("num_selected"), F.col("max_rerank_score"), F.col("relevance_gate"),
        F.col("max_dense_similarity"),
    )
    null = F.lit(None).cast("double")
    return d.select(
        "query_id",
        below_evidence(n, best, gate, dense, fx.SETTINGS).alias("by_gate"),
        below_evidence(n, null, gate, dense, fx.SETTINGS).alias("by_cosine"),
        below_evidence(n, null, null, null, fx.SETTINGS).alias("unknown"),
        below_evidence(F.lit(0), best, gate, dense, fx.SETTINGS).alias("no_hits"),
    )


# --- conversations ----------------------------------------------------------
@query
def turn_history(spark, sf):
    done = sessions.turn_history(fx.turns(spark, sf), 4)
    return done.select(
        "conv_id", "turn",
        F.size("history").cast("bigint").alias("n_messages"),
        F.md5(
            F.array_join(
                F.transform("history", lambda m: F.concat_ws("=", m["role"], m["content"])), "\n"
            )
        ).alias("history_md5"),
        sessions.is_followup(F.col("history")).alias("is_followup"),
    )


@query
def last_turns(spark, sf):
    return sessions.last_turn(fx.turns(spark, sf))


@query
def scored_turns(spark, sf):
    return sessions.scored_turn(fx.table(spark, sf, "conversations"))


@query
def sticky_scopes(spark, sf):
    return sessions.sticky_scope(fx.scoped_turns(spark, sf)).select("conv_id", "turn", "scope")


@query
def rewrite_contexts(spark, sf):
    done = sessions.turn_history(fx.turns(spark, sf), fx.SETTINGS.history_turns)
    return done.select(
        "conv_id", "turn",
        F.md5(sessions.rewrite_prompt(F.col("history"), F.col("question"), fx.SETTINGS)).alias(
            "prompt_md5"
        ),
    )


@query
def rewrite_plan(spark, sf):
    """Which questions are rewritten, and the query used when the reply text of
    the previous exchange is offered as the rewrite."""
    done = sessions.turn_history(fx.turns(spark, sf), fx.SETTINGS.history_turns)
    history, question = F.col("history"), F.col("question")
    plan = sessions.needs_rewrite(
        history, question, F.lit(False), F.lit(True), fx.SETTINGS
    )
    offered = F.get(history, F.size(history) - 1)["content"]
    return done.select(
        "conv_id", "turn", plan.alias("rewrite"),
        F.when(plan, sessions.accept_rewrite(question, offered, fx.SETTINGS))
        .otherwise(question)
        .alias("query"),
    )


@query
def resolve_scopes(spark, sf):
    """Scope arguments: positions, ids, titles, clearing words and nonsense."""
    kind = F.pmod(F.length("text"), F.lit(6))
    item = F.col("item_id").cast("string")
    requests = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.when(kind == 0, F.concat(F.lit(" doc "), item, F.lit(" ")))
        .when(kind == 1, item)
        .when(kind == 2, F.lit("ALL"))
        .when(kind == 3, (F.length("text") * 100).cast("string"))
        .when(kind == 4, F.concat(F.lit("DOC "), F.length("text").cast("string")))
        .otherwise(F.concat(F.lit("Show "), item))
        .alias("argument"),
    )
    return sessions.resolve_scope(requests, fx.episodes(spark, sf)).select(
        "request_id", "argument", "episode_id", "error"
    )


# --- prompts ----------------------------------------------------------------
@query
def capped_context(spark, sf):
    return cap_context(fx.question_search(spark, sf).hits, 3000).select(
        "query_id", "rank", "chunk_id"
    )


@query
def rendered_context(spark, sf):
    return passages_of(fx.question_search(spark, sf).hits).select(
        "query_id", F.md5(render_context(F.col("passages"))).alias("context_md5")
    )


@query
def user_prompts(spark, sf):
    """Prompts with the topic as retrieval query; task notes in short form."""
    asked = fx.messages(spark, sf).withColumnRenamed("id", "query_id")
    shown = passages_of(fx.question_search(spark, sf).hits)
    prompt = build_user_turn(
        F.col("message"), F.col("passages"), detect_mode(F.col("message")),
        normalize_query(F.col("message")), "compare them", "locate it",
    )
    return asked.join(shown, "query_id", "left").select("query_id", F.md5(prompt).alias("prompt_md5"))


@query
def judge_prompts(spark, sf):
    shown = passages_of(fx.case_search(spark, sf).hits).withColumnRenamed("query_id", "id")
    answers = fx.finished_answers(spark, sf)[0].select(F.col("answer_id").alias("id"), "answer")
    prompt = build_judge_prompt(
        F.col("passages"), F.col("turns"), F.col("refusal"), F.col("clarify_ok"),
        F.col("key_points"), F.col("answer"),
    )
    return (
        fx.cases(spark, sf).join(shown, "id", "left").join(answers, "id")
        .select("id", F.md5(prompt).alias("prompt_md5"))
    )


# --- citations --------------------------------------------------------------
@query
def extracted_citations(spark, sf):
    marked = fx.raw_answers(spark, sf).select(
        "answer_id", F.col("raw_answer").alias("answer")
    )
    return cit.formatted(cit.extract_citations(marked))


@query
def validated_citations(spark, sf):
    return fx.finished_answers(spark, sf)[1]


@query
def stripped_answers(spark, sf):
    return fx.finished_answers(spark, sf)[0].select("answer_id", "answer", "not_covered")


@query
def stripped_markers(spark, sf):
    return fx.raw_answers(spark, sf).select(
        "answer_id",
        strip_marker(F.col("raw_answer")).alias("answer"),
        marker_found(F.col("raw_answer")).alias("not_covered"),
    )


@query
def answer_sources(spark, sf):
    return fx.finished_answers(spark, sf)[2].select(
        "answer_id", "chunk_id", "episode_id", "start", "end", "timestamp", "source_file",
        F.round("score", 6).alias("score"),
    )


@query
def citation_validity(spark, sf):
    return fx.finished_answers(spark, sf)[0].select(
        "answer_id", "num_citations", "num_invalid",
        F.round("citation_validity", 6).alias("citation_validity"),
    )


@query
def failure_reasons(spark, sf):
    return fx.finished_answers(spark, sf)[0].select("answer_id", "reasons")


def scripted_answer(requests):
    """Stands in for a model: cites the first passage it is shown."""
    replies = []
    for request in requests:
        content = request["messages"][-1]["content"]
        shown = re.search(r'Episode: "([^"]+)"\nTimestamp: ([0-9:]+)\W([0-9:]+)', content)
        text = f'As they say (Ep. "{shown[1]}" {shown[2]}-{shown[3]}).' if shown else "NOT_COVERED"
        replies.append({"text": text, "model": "gpt-4o", "input_tokens": len(content), "output_tokens": len(text)})
    return replies


@query
def answer(spark, sf):
    """Every benchmark message from search to checked citations."""
    asked = fx.messages(spark, sf).select(
        F.col("id").alias("query_id"), "message", F.lit(None).cast("string").alias("rewritten"),
        F.lit(None).cast("string").alias("scope"),
        F.expr("cast(array() as array<struct<role: string, content: string>>)").alias("history"),
    )
    prompts = Prompts("Answer from the passages.", "compare them", "locate it")
    done = ask(asked, fx.search_index(spark, sf), fx.episodes(spark, sf), scripted_answer, prompts)
    return done.answers.select(
        "answer_id", "not_covered", "answer", "num_citations", "num_invalid", "model", "input_tokens", "output_tokens", "error"
    )


def scripted_rewriter(requests):
    """Stands in for a model: the last words of the learner's first line and the message."""
    replies = []
    for request in requests:
        content = request["messages"][-1]["content"]
        said = re.search(r"Learner: (.*)", content)
        asked = content.split("FOLLOW-UP MESSAGE: ", 1)[1].rsplit("\n\nStandalone", 1)[0]
        words = (said[1].split()[:4] if said else []) + asked.split()[:12]
        replies.append({"text": " ".join(words), "model": "gpt-4o-mini", "input_tokens": len(content), "output_tokens": len(words)})
    return replies


def _rewritten_turns(spark, sf):
    def make():
        turns = fx.turns(spark, sf).withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
        ledger = stage_path(spark, "rewrite-ledger")
        for _ in range(2):  # the second run finds every reply in the ledger
            done = rewrite_turns(turns, scripted_rewriter, "Rewrite the message.", fx.SETTINGS, ledger)
        return stage_table(done, "rewritten-turns")

    return fx.remember(spark, sf, "rewritten", make)


@query
def rewritten_turns(spark, sf):
    """Follow-ups that refer back, rewritten by the model through a ledger of replies."""
    return _rewritten_turns(spark, sf).select("query_id", "question", "rewritten", F.size("history").cast("bigint").alias("n_messages"))


@query
def answer_turns(spark, sf):
    """Every turn of every conversation: rewrite, search, answer and checked citations."""
    asked = _rewritten_turns(spark, sf).select(
        "query_id", F.col("question").alias("message"), "rewritten", F.lit(None).cast("string").alias("scope"), "history"
    )
    prompts = Prompts("Answer from the passages.", "compare them", "locate it")
    done = ask(
        asked, fx.search_index(spark, sf), fx.episodes(spark, sf), scripted_answer, prompts, ledger=stage_path(spark, "answer-ledger")
    )
    return done.answers.select("answer_id", "query", "not_covered", "answer", "num_citations", "num_invalid", "model", "error")


# --- evaluation -------------------------------------------------------------
@query
def validated_cases(spark, sf):
    return ev.validate_cases(ev.normalise_cases(fx.raw_cases(spark, sf)))


@query
def selected_cases(spark, sf):
    return ev.select_cases(fx.cases(spark, sf), ["cross_episode", "case_0", "case_7"]).select(
        "id", "category", joined("expected_episodes").alias("expected_episodes"),
        joined("must_retrieve").alias("must_retrieve"),
        joined("forbidden_claims").alias("forbidden_claims"), "refusal", "must_cite",
    )


def _metrics(spark, sf):
    found = fx.case_search(spark, sf)
    return ev.retrieval_metrics(
        fx.cases(spark, sf), ev.retrieved_context(found.hits), found.diagnostics
    )


@query
def episode_hit(spark, sf):
    return _metrics(spark, sf).select("id", F.round("episode_hit", 6).alias("episode_hit"))


@query
def retrieval_metrics(spark, sf):
    return _metrics(spark, sf).select(
        "id", F.round("episode_hit", 6).alias("episode_hit"),
        F.round("term_coverage", 6).alias("term_coverage"),
        "num_retrieved", "num_episodes_retrieved",
        F.round("top_score", 6).alias("top_score"), "max_dense_similarity",
    )


@query
def forbidden_claims(spark, sf):
    answers = fx.finished_answers(spark, sf)[0].select(F.col("answer_id").alias("id"), "answer")
    leaked = ev.forbidden_claims(
        F.col("forbidden_claims"), F.col("answer"), F.array_join("turns", " ")
    )
    return fx.cases(spark, sf).join(answers, "id").select("id", F.explode(leaked).alias("claim"))


@query
def retrieval_checks(spark, sf):
    return ev.retrieval_checks(_metrics(spark, sf)).select(
        "id", "evidence_gate_fired", "retrieved_expected_episode", "term_coverage_ok",
        "evidence_gate_open", joined("failures", "; ").alias("failures"), "checks_passed",
    )


def _answered(spark, sf, settings=fx.SETTINGS) -> DataFrame:
    def make():
        done = evaluate_answers(
            fx.cases(spark, sf), fx.case_search(spark, sf, settings), fx.finished_answers(spark, sf, settings)[0],
            fx.judged(spark, sf),
        )
        cost = F.round(F.length("answer") / 1000.0, 3)
        return stage_table(
            done.withColumn("latency_ms", F.length("answer").cast("double")).withColumn(
                "cost_usd", cost
            ),
            "answered-outcomes",
        )

    return fx.remember(spark, sf, f"answered-{settings}", make)


@query
def full_checks(spark, sf):
    return _answered(spark, sf).select(
        "id", "non_empty_answer", "refused_correctly", "answered_when_covered",
        "no_forbidden_claims", "has_citation", "citations_valid",
        "retrieved_expected_episode", joined("failures", "; ").alias("failures"), "checks_passed",
    )


@query
def outcomes(spark, sf):
    return _answered(spark, sf).select("id", "category", "checks_passed", "judge_passed", "passed")


def _run(spark, sf, name, settings) -> DataFrame:
    return fx.remember(
        spark, sf, name,
        lambda: stage_table(
            evaluate_retrieval(fx.cases(spark, sf), fx.search_index(spark, sf), settings), name
        ),
    )


def baseline_run(spark, sf):
    return _run(spark, sf, "run-baseline", fx.BASELINE)


def improved_run(spark, sf):
    return _run(spark, sf, "run-improved", fx.SETTINGS)


@query
def eval_retrieval(spark, sf):
    return improved_run(spark, sf).select(
        "id", "category", "passed", F.round("episode_hit", 6).alias("episode_hit"),
        F.round("term_coverage", 6).alias("term_coverage"), "not_covered",
    )


@query
def eval_summary(spark, sf):
    return ev.run_summary(improved_run(spark, sf))


@query
def eval_latency_cost(spark, sf):
    return ev.latency_and_cost(_answered(spark, sf))


@query
def eval_by_category(spark, sf):
    return ev.by_category(improved_run(spark, sf))


@query
def eval_category_cases(spark, sf):
    return ev.category_cases(improved_run(spark, sf))


@query
def refusal_metrics(spark, sf):
    return ev.refusal_metrics(improved_run(spark, sf))


@query
def citation_metrics(spark, sf):
    return ev.citation_metrics(_answered(spark, sf))


@query
def hallucination_metrics(spark, sf):
    return ev.hallucination_metrics(_answered(spark, sf))


@query
def judge_passes(spark, sf):
    return fx.table(spark, sf, "labels").select("doc_id", *fx.grades())


@query
def judge_summary(spark, sf):
    return ev.judge_summary(fx.table(spark, sf, "labels").select("doc_id", *fx.grades()))


@query
def compare_metrics(spark, sf):
    """Every compared metric of two answered runs."""
    return runs.compare_metrics(
        ev.run_report(_answered(spark, sf, fx.BASELINE)), ev.run_report(_answered(spark, sf))
    ).select(
        "metric", "before", "after", F.round("delta", 6).alias("delta"),
        "before_text", "after_text", "delta_text", "improved",
    )


@query
def compare_categories(spark, sf):
    return runs.compare_categories(
        ev.by_category(baseline_run(spark, sf)), ev.by_category(improved_run(spark, sf))
    )


@query
def compare_cases(spark, sf):
    return runs.case_movement(baseline_run(spark, sf), improved_run(spark, sf))


def _written_run(spark, sf):
    """A run written as JSON lines and read back: its records and its one-line report."""

    def make():
        run = _answered(spark, sf)
        report = ev.run_report(run)
        root = stage_path(spark, "results")
        results.write_run(run, report, root, "improved")
        return results.read_run(spark, root, "improved", run.schema, report.schema)

    return fx.remember(spark, sf, "written-run", make)


@query
def write_results(spark, sf):
    records = _written_run(spark, sf)[0]
    lists = {n: joined(n, "; ") for n, kind in records.dtypes if kind.startswith("array")}
    return records.withColumns(lists)


@query
def run_report(spark, sf):
    """Every metric of the answered run, as read back."""
    return _written_run(spark, sf)[1]


# --- model hooks, spend, timings --------------------------------------------
def scripted_judge(requests):
    """Stands in for a model: grades by the length of the answer it is shown."""
    replies = []
    for request in requests:
        text = request["messages"][-1]["content"]
        n = len(text)
        if n % 7 == 0:
            raise ValueError("no reply")
        body = (
            '{"faithfulness": %d, "completeness": "%d", "citation_correctness": 4.5, '
            '"refusal_correctness": null, "clarity": 9, '
            '"unsupported_claims": ["a {b}", "c"], "rationale": "len %d"}' % (n % 6, n % 4, n)
        )
        shape = n % 5
        if shape == 0:
            body = "```json\n" + body + "\n```"
        elif shape == 1:
            body = "Here you go: " + body + " Done."
        elif shape == 2:
            body = body[:-1]
        elif shape == 3:
            body = "no grades"
        replies.append({"text": body, "model": "gpt-4o", "input_tokens": n, "output_tokens": 10})
    return replies


def _requests(spark, sf):
    """Every document as one grading request."""
    return fx.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.lit("Grade it.").alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias(
            "messages"
        ),
    )


@query
def batch_complete(spark, sf):
    return hooks.batch_complete(_requests(spark, sf), scripted_judge)


@query
def judge_parse(spark, sf):
    parsed = hooks.judge_parse(hooks.batch_complete(_requests(spark, sf), scripted_judge))
    return parsed.select(
        "request_id", "error", "faithfulness", "completeness", "citation_correctness",
        "refusal_correctness", "clarity", joined("unsupported_claims", "|").alias("claims"),
        "rationale", "judge_error",
    )


@query
def llm_cost(spark, sf):
    priced = hooks.llm_cost(fx.model_calls(spark, sf), hooks.price_table(spark))
    return priced.select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query
def llm_cost_by_case(spark, sf):
    priced = hooks.llm_cost(fx.model_calls(spark, sf), hooks.price_table(spark))
    return hooks.cost_by(priced, "case_id")


@query
def stage_latency(spark, sf):
    return ev.stage_latency(fx.timings(spark, sf))


# --- streams ----------------------------------------------------------------
@query
def stream_latency(spark, sf):
    """Events read as a stream: counts and times per hour and type."""
    from groundspan.streaming.latency import windowed_latency

    events = spark.readStream.schema(fx.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return windowed_latency(timed, "ts", "1 hour", "10 minutes").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "stage", "n", "max_ms", F.round("sum_ms", 4).alias("sum_ms")
    )


def _raw_segments(spark, sf):
    raw = fx.raw_transcripts(spark, sf).select(
        "episode_id", "episode_title", "source_file", F.posexplode("segments").alias("id", "s"), F.size("segments").alias("n")
    )
    arrived = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 60)")
    return raw.select(
        "episode_id", "episode_title", "source_file", "id", "s.start", "s.end", "s.text",
        (F.col("id") == F.col("n") - 1).alias("last"), arrived.alias("arrived"),
    )


@query
def stream_chunks(spark, sf):
    """Raw segments out of order as a stream of several batches, cut into passages."""
    from groundspan.streaming.chunks import chunk_stream, write_chunk_stream

    source, store = stage_path(spark, "incoming-segments"), stage_path(spark, "streamed-passages")
    segments = _raw_segments(spark, sf)
    segments.withColumn("part", F.pmod(F.xxhash64("episode_id", "id"), F.lit(4))).write.partitionBy("part").parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    stream = spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(source)
    write_chunk_stream(chunk_stream(stream, fx.SETTINGS), store, stage_path(spark, "segments-checkpoint"))
    return spark.read.parquet(store).withColumn("segment_ids", joined("segment_ids"))


@query
def stream_ingest(spark, sf):
    """Two runs of the ingest stream: by the length of its text a document is new in the
    second, has lost its first segment, is gone, comes again unchanged, or stays away."""
    from groundspan.streaming.ingest import ingest_stream

    source, root = stage_path(spark, "incoming"), stage_path(spark, "ingested")
    kind = F.pmod((F.col("duration") * fx.CHARS_PER_SECOND).cast("bigint"), F.lit(5))
    every = fx.transcripts(spark, sf).withColumn("arrived", F.lit(1))
    changed = F.when(kind == 2, F.lit(None)).when(kind == 1, F.slice("segments", 2, 1_000_000_000)).otherwise(F.col("segments"))
    sha = F.when(kind == 1, F.sha2(F.concat("source_sha256", F.lit("-cut")), 256)).otherwise(F.col("source_sha256"))
    later = every.where(kind < 4).withColumns({"segments": changed, "source_sha256": sha, "arrived": F.lit(2)})
    for rows in (every.where(kind > 0), later):
        rows.write.mode("append").parquet(source)
        ingest_stream(spark.readStream.schema(every.schema).parquet(source), root, fx.SETTINGS)
    return chunk_store.read_chunks(spark, f"{root}/chunks").select("chunk_id", "episode_id", "start", "end", "text")
