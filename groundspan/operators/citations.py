"""Inline citations: extraction, interval validation, stripping, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import strip_ws
from groundspan.functions.timefmt import format_range, parse_ts


def extract_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, title, start, end, raw), in order of appearance.

    A match whose times cannot be read is skipped.
    """

    def group(i: int) -> Column:
        return F.regexp_extract_all(F.col("answer"), F.lit(fv.CITATION_PATTERN), F.lit(i))

    matches = F.arrays_zip(
        group(0).alias("raw"), group(1).alias("title"), group(2).alias("s"), group(3).alias("e")
    )
    parsed = F.filter(
        F.transform(
            matches,
            lambda m: F.struct(
                strip_ws(m["title"]).alias("title"),
                parse_ts(m["s"]).alias("start"),
                parse_ts(m["e"]).alias("end"),
                m["raw"].alias("raw"),
            ),
        ),
        lambda c: c["start"].isNotNull() & c["end"].isNotNull(),
    )
    return answers.select("answer_id", F.posexplode(parsed).alias("pos", "c")).select(
        "answer_id", "pos", "c.title", "c.start", "c.end", "c.raw"
    )


def overlaps(c_start: Column, c_end: Column, p_start: Column, p_end: Column, tolerance: float):
    """Closed intervals meet, allowing for times rounded to whole seconds."""
    return (c_start <= p_end + tolerance) & (c_end >= p_start - tolerance)


def validate_citations(
    citations: DataFrame,
    retrieved: DataFrame,
    episodes: DataFrame,
    tolerance: float = 5.0,
) -> DataFrame:
    """Add episode_id, valid and reason to each citation.

    ``retrieved`` holds the passages shown for an answer: (answer_id,
    episode_title, start, end). Equal title and answer are the join key and the
    interval is a residual, so no pairs beyond one answer's own passages arise.
    """
    cited = citations.withColumn("_title", F.lower("title"))
    shown = retrieved.select(
        "answer_id",
        F.lower("episode_title").alias("_title"),
        F.col("start").alias("_p_start"),
        F.col("end").alias("_p_end"),
    )
    seen = (
        cited.select("answer_id", "pos", "_title", "start", "end")
        .join(shown, ["answer_id", "_title"])
        .groupBy("answer_id", "pos")
        .agg(
            F.lit(True).alias("_shown"),
            F.bool_or(
                overlaps(F.col("start"), F.col("end"), F.col("_p_start"), F.col("_p_end"), tolerance)
            ).alias("_meets"),
        )
    )
    # Only cited titles leave the catalogue; of equal titles the last id wins.
    known = (
        episodes.withColumn("_title", F.lower("title"))
        .join(cited.select("_title").distinct(), "_title", "left_semi")
        .groupBy("_title")
        .agg(
            F.max("episode_id").alias("episode_id"),
            F.max_by("duration", "episode_id").alias("_duration"),
        )
    )
    reason = (
        F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), fv.REASON_MALFORMED)
        .when(F.col("_shown").isNull(), fv.REASON_NOT_RETRIEVED)
        .when(F.col("start") > F.col("_duration"), fv.REASON_BEYOND_END)
        .when(~F.col("_meets"), fv.REASON_NO_OVERLAP)
    )
    return (
        cited.join(seen, ["answer_id", "pos"], "left")
        .join(known, "_title", "left")
        .withColumn("reason", reason)
        .withColumn("valid", F.col("reason").isNull())
        .select(
            "answer_id", "pos", "title", "start", "end", "raw", "episode_id", "valid", "reason"
        )
    )


def formatted(citations: DataFrame) -> DataFrame:
    return citations.withColumn("formatted", format_range(F.col("start"), F.col("end")))


def citation_summary(answers: DataFrame, validated: DataFrame) -> DataFrame:
    """Per answer: counts, validity rate (1.0 without citations), sorted reasons.

    The collected texts are those of one answer.
    """
    per_answer = validated.groupBy("answer_id").agg(
        F.count("*").alias("num_citations"),
        F.count_if(~F.col("valid")).alias("num_invalid"),
        F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"),
        F.transform(
            F.sort_array(F.collect_list(F.when(~F.col("valid"), F.struct("pos", "raw")))),
            lambda c: c["raw"],
        ).alias("invalid_raws"),
    )
    return (
        answers.join(per_answer, "answer_id", "left")
        .na.fill(0, ["num_citations", "num_invalid"])
        .na.fill("", ["reasons"])
        .withColumn(
            "citation_validity",
            F.coalesce(
                F.try_divide(
                    F.col("num_citations") - F.col("num_invalid"), F.col("num_citations")
                ),
                F.lit(1.0),
            ),
        )
        .withColumn(
            "invalid_raws",
            F.coalesce("invalid_raws", F.expr("cast(array() as array<string>)")),
        )
    )


def strip_citations(answer: Column, invalid_raws: Column) -> Column:
    """Remove the given citation texts and collapse runs of blanks."""
    cleaned = F.aggregate(
        invalid_raws, answer, lambda text, raw: F.replace(text, raw, F.lit(""))
    )
    return F.regexp_replace(cleaned, r"[ \t]{2,}", " ")


def answer_sources(
    retrieved: DataFrame, validated: DataFrame, tolerance: float = 5.0
) -> DataFrame:
    """Passages that back a valid citation; all passages where none is valid."""
    valid = validated.where("valid").select(
        "answer_id",
        F.lower("title").alias("_title"),
        F.col("start").alias("_c_start"),
        F.col("end").alias("_c_end"),
    )
    shown = retrieved.withColumn("_title", F.lower("episode_title"))
    backed = shown.alias("p").join(
        valid.alias("c"),
        (F.col("p.answer_id") == F.col("c.answer_id"))
        & (F.col("p._title") == F.col("c._title"))
        & overlaps(F.col("_c_start"), F.col("_c_end"), F.col("p.start"), F.col("p.end"), tolerance),
        "left_semi",
    )
    uncited = shown.join(valid.select("answer_id"), "answer_id", "left_anti")
    return (
        backed.unionByName(uncited)
        .dropDuplicates(["answer_id", "chunk_id"])
        .drop("_title")
        .withColumn("timestamp", format_range(F.col("start"), F.col("end")))
    )
