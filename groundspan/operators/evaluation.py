"""Scoring answered cases and summarising a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import contains_term, strip_ws
from groundspan.operators.quantiles import exact_quantiles
from groundspan.schemas import JUDGE_DIMENSIONS


def _no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


# --- cases ------------------------------------------------------------------
def normalise_cases(raw: DataFrame) -> DataFrame:
    """Fill the defaults of a case table and unify its two spellings.

    ``raw`` has an ``index`` column with the position of each case in the file.
    """
    given = F.when(F.size("turns") > 0, F.col("turns")).when(
        F.length("input") > 0, F.array("input")
    )
    expected = F.coalesce(
        F.col("expected.episodes"),
        F.when(F.col("expected.episode").isNotNull(), F.array("expected.episode")),
        _no_strings(),
    )
    return raw.select(
        F.coalesce(
            F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("case_"), F.col("index").cast("string"))
        ).alias("id"),
        F.coalesce("category", F.lit("uncategorised")).alias("category"),
        F.coalesce(given, _no_strings()).alias("turns"),
        expected.alias("expected_episodes"),
        F.coalesce("expected.must_retrieve", _no_strings()).alias("must_retrieve"),
        F.coalesce("expected.key_points", _no_strings()).alias("key_points"),
        F.coalesce("expected.refusal", F.lit(False)).alias("refusal"),
        F.coalesce("expected.clarify_ok", F.lit(False)).alias("clarify_ok"),
        F.coalesce("must_cite", F.lit(False)).alias("must_cite"),
        F.coalesce("forbidden_claims", _no_strings()).alias("forbidden_claims"),
    )


def validate_cases(cases: DataFrame) -> DataFrame:
    """One row per problem: a repeated id, or a case without any turn."""
    repeated = (
        cases.groupBy("id")
        .count()
        .where("count > 1")
        .select("id", F.concat(F.lit(fv.CASE_DUPLICATE), "id").alias("problem"))
    )
    silent = cases.where(F.size("turns") == 0).select(
        "id",
        F.concat(F.lit("case '"), "id", F.lit(fv.CASE_SILENT)).alias(
            "problem"
        ),
    )
    return repeated.unionByName(silent)


def select_cases(cases: DataFrame, only: list[str]) -> DataFrame:
    """Cases whose id or category is named."""
    return cases.where(F.col("id").isin(only) | F.col("category").isin(only))


# --- per-case metrics -------------------------------------------------------
def retrieved_context(hits: DataFrame) -> DataFrame:
    """Text, episodes and counts of each result; a result holds at most top_k rows."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("context"),
        F.collect_set("episode_id").alias("episodes"),
        F.count("*").alias("num_retrieved"),
        F.max_by("score", -F.col("rank")).alias("top_score"),
    )


def share_of(items: Column, hit) -> Column:
    """Fraction of array items that satisfy ``hit``; 1.0 for an empty array."""
    return F.coalesce(
        F.try_divide(F.size(F.filter(items, hit)), F.size(items)), F.lit(1.0)
    )


def retrieval_metrics(
    cases: DataFrame, contexts: DataFrame, diagnostics: DataFrame
) -> DataFrame:
    """Cases with episode_hit, term_coverage and the retrieval numbers."""
    joined = (
        cases.join(contexts.withColumnRenamed("query_id", "id"), "id", "left")
        .join(
            diagnostics.select(
                F.col("query_id").alias("id"), "max_dense_similarity", "not_covered"
            ),
            "id",
            "left",
        )
        .na.fill("", ["context"])
        .na.fill(0, ["num_retrieved"])
        .na.fill(0.0, ["top_score", "max_dense_similarity"])
        .withColumn("episodes", F.coalesce("episodes", _no_strings()))
    )
    return (
        joined.withColumn(
            "episode_hit",
            share_of(
                F.col("expected_episodes"), lambda e: F.array_contains(F.col("episodes"), e)
            ),
        )
        .withColumn(
            "term_coverage",
            share_of(F.col("must_retrieve"), lambda t: contains_term(F.col("context"), t)),
        )
        .withColumn("num_episodes_retrieved", F.size("episodes").cast("bigint"))
        .drop("episodes")
    )


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def _checked(df: DataFrame, checks: dict[str, Column], failures: list[Column]) -> DataFrame:
    """Add one boolean per check (NULL: not applicable), the failure texts, and passed."""
    for name, outcome in checks.items():
        df = df.withColumn(name, outcome)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.coalesce(F.col(name), F.lit(True))
    return df.withColumn("failures", F.array_compact(F.array(*failures))).withColumn(
        "checks_passed", passed
    )


def retrieval_checks(metrics: DataFrame) -> DataFrame:
    """Scores retrieval alone: gate fired, or right episodes and enough terms."""
    refusal, refused = F.col("refusal"), F.col("not_covered")
    found = F.col("episode_hit") >= 0.999
    covered = F.col("term_coverage") >= 0.5
    checks = {
        "evidence_gate_fired": F.when(refusal, refused),
        "retrieved_expected_episode": F.when(~refusal, found),
        "term_coverage_ok": F.when(~refusal, covered),
        "evidence_gate_open": F.when(~refusal, ~refused),
    }
    failures = [
        F.when(
            refusal & ~refused,
            F.concat(
                F.lit(fv.FAIL_GATE_SILENT),
                F.format_string("%.3f", F.round("max_dense_similarity", 3)),
                F.lit(")"),
            ),
        ),
        F.when(
            ~refusal & ~found,
            F.concat(F.lit(fv.FAIL_MISSED), _percent(F.col("episode_hit")), F.lit(")")),
        ),
        F.when(
            ~refusal & ~covered,
            F.concat(
                F.lit(fv.FAIL_COVERED_ONLY),
                _percent(F.col("term_coverage")),
                F.lit(fv.FAIL_COVERED_END),
            ),
        ),
        F.when(~refusal & refused, F.lit(fv.FAIL_GATE_WRONG)),
    ]
    return _checked(metrics, checks, failures)


def forbidden_claims(claims: Column, answer: Column, asked: Column) -> Column:
    """Claims stated in the answer that the question did not bring up itself."""
    return F.filter(claims, lambda c: contains_term(answer, c) & ~contains_term(asked, c))


def full_checks(answered: DataFrame) -> DataFrame:
    """Every deterministic check of an answered case.

    ``answered``: retrieval metrics plus answer, not_covered, num_citations,
    num_invalid, reasons.
    """
    refusal, refused = F.col("refusal"), F.col("not_covered")
    answer = F.coalesce("answer", F.lit(""))
    nonempty = F.length(strip_ws(answer)) > 0
    df = answered.withColumn(
        "leaked_claims",
        forbidden_claims(F.col("forbidden_claims"), answer, F.array_join("turns", " ")),
    )
    clean = F.size("leaked_claims") == 0
    must_cite = F.col("must_cite") & ~refused
    cited = F.col("num_citations") > 0
    valid = F.col("num_invalid") == 0
    found = F.col("episode_hit") >= 0.999
    checks = {
        "non_empty_answer": nonempty,
        "refused_correctly": F.when(refusal, refused),
        "answered_when_covered": F.when(~refusal, ~refused),
        "no_forbidden_claims": clean,
        "has_citation": F.when(must_cite, cited),
        "citations_valid": valid,
        "retrieved_expected_episode": F.when(~refusal, found),
    }
    failures = [
        F.when(~nonempty, F.lit(fv.FAIL_EMPTY)),
        F.when(
            refusal & ~refused, F.lit(fv.FAIL_NOT_REFUSED)
        ),
        F.when(
            ~refusal & refused, F.lit(fv.FAIL_REFUSED)
        ),
        F.when(
            ~clean,
            F.concat(
                F.lit(fv.FAIL_CLAIMS), F.array_join("leaked_claims", ", ")
            ),
        ),
        F.when(must_cite & ~cited, F.lit(fv.FAIL_NO_CITATION)),
        F.when(
            ~valid,
            F.concat(
                F.col("num_invalid").cast("string"),
                F.lit(fv.FAIL_CITATIONS),
                F.col("reasons"),
            ),
        ),
        F.when(
            ~refusal & ~found,
            F.concat(
                F.lit(fv.FAIL_RETRIEVAL),
                _percent(F.col("episode_hit")),
                F.lit(")"),
            ),
        ),
    ]
    return _checked(df, checks, failures)


# --- outcomes and summaries -------------------------------------------------
def outcomes(
    cases: DataFrame, checks: DataFrame, judged: DataFrame | None, errors: DataFrame | None
) -> DataFrame:
    """One row per case: what it produced and whether it passed.

    A case fails on an error, on a missing or failed check, or on a readable
    judge verdict below the bar.
    """
    df = cases.select("id", "category", "refusal").join(
        checks.drop("category", "refusal"), "id", "left"
    )
    if judged is None:
        for name in JUDGE_DIMENSIONS:
            df = df.withColumn(name, F.lit(None).cast("int"))
        df = df.withColumn("judge_passed", F.lit(None).cast("boolean")).withColumn(
            "num_unsupported", F.lit(0)
        )
    else:
        df = df.join(judged, "id", "left")
    if errors is None:
        df = df.withColumn("error", F.lit(None).cast("string"))
    else:
        df = df.join(errors.select("id", "error"), "id", "left")
    return df.withColumn(
        "passed",
        F.col("error").isNull()
        & F.coalesce("checks_passed", F.lit(False))
        & F.coalesce("judge_passed", F.lit(True)),
    ).withColumn("scored", F.col("checks_passed").isNotNull() & F.col("error").isNull())


def _mean_where(value: Column, condition: Column, dp: int) -> Column:
    return F.round(F.coalesce(F.avg(F.when(condition, value.cast("double"))), F.lit(0.0)), dp)


def _run_metrics() -> list[Column]:
    scored, refusal = F.col("scored"), F.col("refusal")
    return [
        F.count("*").alias("num_cases"),
        F.count_if("passed").alias("passed"),
        _mean_where(F.col("passed"), F.lit(True), 4).alias("pass_rate"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        _mean_where(F.col("episode_hit"), scored & ~refusal, 4).alias("mean_episode_hit"),
        _mean_where(F.col("term_coverage"), scored & ~refusal, 4).alias("mean_term_coverage"),
        _mean_where(F.col("top_score"), scored, 6).alias("mean_top_score"),
        F.count_if(scored & refusal).alias("num_refusal_cases"),
        _mean_where(F.col("passed"), scored & refusal, 4).alias("refusal_accuracy"),
        F.count_if(scored & ~refusal & F.col("not_covered")).alias("false_refusals"),
    ]


def run_summary(results: DataFrame, *keys: str) -> DataFrame:
    """The retrieval and refusal metrics of a run, over everything or per key."""
    return results.groupBy(*keys).agg(*_run_metrics()) if keys else results.agg(*_run_metrics())


def run_report(results: DataFrame) -> DataFrame:
    """One row with every metric of a run, in a single aggregation.

    Metrics whose columns the run does not have (a run without answers, a judge or
    costs) are NULL.
    """
    groups = [
        (set(), _run_metrics()),
        ({"citation_validity", "num_citations", "num_invalid"}, _citation_metrics()),
        ({"no_forbidden_claims", "num_unsupported"}, _hallucination_metrics()),
        ({"faithfulness", "judge_passed"}, _judge_metrics()),
        ({"latency_ms", "cost_usd"}, _cost_metrics()),
    ]
    there = set(results.columns)
    known = [m for needs, metrics in groups if needs <= there for m in metrics]
    report = results.agg(*known)
    missing = [name for name, _, _ in fv.COMPARED_METRICS if name not in report.columns]
    return report.withColumns({name: F.lit(None).cast("double") for name in missing})


def refusal_metrics(results: DataFrame) -> DataFrame:
    return run_summary(results).select("num_refusal_cases", "refusal_accuracy", "false_refusals")


def _cost_metrics() -> list[Column]:
    return [
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("mean_ms"),
        F.round(F.coalesce(F.max("latency_ms"), F.lit(0.0)), 1).alias("max_ms"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("estimated_usd"),
    ]


def latency_and_cost(results: DataFrame) -> DataFrame:
    """Mean and maximum latency of answered cases and the total spend."""
    return results.agg(*_cost_metrics())


def by_category(results: DataFrame) -> DataFrame:
    """Totals and pass rate per category, and overall (category NULL)."""
    return results.rollup("category").agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
    )


def category_cases(results: DataFrame) -> DataFrame:
    """The cases behind each category, as rows so that any category size works."""
    failures = F.when(
        F.col("scored"), F.array_join("failures", "; ")
    ).otherwise(F.col("error"))
    return results.select("category", "id", "passed", failures.alias("failures")).orderBy(
        "category", "id"
    )


def _citation_metrics() -> list[Column]:
    scored = F.col("scored")
    return [
        _mean_where(F.coalesce("citation_validity", F.lit(1.0)), scored, 4).alias(
            "mean_citation_validity"
        ),
        F.coalesce(F.sum(F.when(scored, F.col("num_citations"))), F.lit(0)).alias(
            "total_citations"
        ),
        F.coalesce(F.sum("num_invalid"), F.lit(0)).alias("invalid_citations"),
    ]


def citation_metrics(results: DataFrame) -> DataFrame:
    return results.agg(*_citation_metrics())


def _hallucination_metrics() -> list[Column]:
    return [
        F.count_if(F.col("scored") & ~F.col("no_forbidden_claims")).alias(
            "forbidden_claim_violations"
        ),
        F.coalesce(F.sum("num_unsupported"), F.lit(0)).cast("bigint").alias(
            "judge_unsupported_claims"
        ),
    ]


def hallucination_metrics(results: DataFrame) -> DataFrame:
    return results.agg(*_hallucination_metrics())


def _judge_metrics() -> list[Column]:
    readable = F.col("faithfulness").isNotNull()
    return [
        F.count_if(readable).alias("num_judged"),
        _mean_where(F.col("judge_passed"), readable, 4).alias("judge_pass_rate"),
        *[_mean_where(F.col(name), readable, 3).alias(f"mean_{name}") for name in JUDGE_DIMENSIONS],
    ]


def judge_summary(judged: DataFrame) -> DataFrame:
    """Means of the five grades and the share that passed, over readable verdicts."""
    return judged.agg(*_judge_metrics())


def stage_latency(timings: DataFrame, *keys: str) -> DataFrame:
    """Per stage of a turn: count, mean, maximum and the exact p95.

    ``timings`` has one row per (turn, stage, ms); maps are exploded first with
    ``explode_timings``.
    """
    by = ["stage", *keys]
    told = timings.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.max("ms").alias("max_ms")
    )
    p95 = exact_quantiles(timings, by, "ms", 0.95, "p95_ms").withColumn("p95_ms", F.round("p95_ms", 6))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by]
    joined = told.alias("t").join(p95.alias("p"), reduce(lambda x, y: x & y, same), "left")
    return joined.select(*[f"t.{k}" for k in by], "n", "mean_ms", "max_ms", "p95_ms")


def explode_timings(turns: DataFrame, column: str = "timings") -> DataFrame:
    return turns.select("*", F.explode(column).alias("stage", "ms")).drop(column)
