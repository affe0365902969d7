"""Transcripts on disk: one JSON line per episode, plus a readable rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan import schemas
from groundspan.functions.timefmt import format_duration, format_ts


def read_transcripts(
    spark: SparkSession, path: str, file_per_episode: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(readable transcripts with defaults filled in, unreadable records).

    A record that is no JSON, or lacks a required field, counts as absent and
    its file is listed. ``file_per_episode``: each file is one document over
    several lines, instead of a line per episode.
    """
    raw = (
        spark.read.schema(schemas.TRANSCRIPT + ", _corrupt string")
        .option("multiLine", str(file_per_episode).lower())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    required = ["episode_id", "episode_title", "source_file", "source_sha256", "duration"]
    good = F.col("_corrupt").isNull()
    for name in required:
        good = good & F.col(name).isNotNull()
    readable = (
        raw.where(good)
        .withColumn("asr_model", F.coalesce("asr_model", F.lit("unknown")))
        .withColumn("asr_provider", F.coalesce("asr_provider", F.lit("unknown")))
        .withColumn("language", F.coalesce("language", F.lit("en")))
        .withColumn(
            "segments",
            F.coalesce("segments", F.expr(f"cast(array() as array<{schemas.SEGMENT}>)")),
        )
        .drop("_corrupt", "path")
    )
    return readable, raw.where(~good).select("path")


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").json(path)


def render_transcript() -> Column:
    """Header lines and one ``[M:SS] text`` line per segment, from the nested row."""
    lines = F.transform(
        "segments", lambda s: F.concat(F.lit("["), format_ts(s["start"]), F.lit("] "), s["text"])
    )
    header = F.array(
        F.concat(F.lit("# "), "episode_title"),
        F.concat(F.lit("# source: "), "source_file"),
        F.concat(F.lit("# duration: "), format_duration(F.col("duration"))),
        F.concat(F.lit("# asr: "), "asr_provider", F.lit(" ("), "asr_model", F.lit(")")),
        F.lit(""),
    )
    return F.array_join(F.concat(header, lines), "\n")


def write_rendered(transcripts: DataFrame, path: str) -> None:
    """One text document per row, separated by a form feed."""
    transcripts.select(render_transcript().alias("value")).write.mode("overwrite").option(
        "lineSep", "\f"
    ).text(path)
