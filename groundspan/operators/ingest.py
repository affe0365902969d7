"""Incremental ingest: what is new, changed, reusable or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import derive_title, file_suffix, slug_id
from groundspan.operators.ordering import with_global_index
from groundspan.staging import stage_table


def catalogue_scan(files: DataFrame) -> DataFrame:
    """Media files among (name, size, ...): known suffix, no dot files.

    ``rejected`` marks empty files; the caller decides whether they stop a run.
    """
    known = file_suffix(F.col("name")).isin(fv.MEDIA_SUFFIXES) & ~F.col("name").startswith(".")
    return files.where(known).withColumn("rejected", F.col("size") == 0)


def identify(files: DataFrame) -> DataFrame:
    """Episode id, title and content hash of each accepted file.

    The first file by name keeps the plain slug. A later file with the same
    slug gets its overall position appended. First files are found by a
    combinable minimum and joined on (slug, name), a unique key, so a slug
    shared by very many files does not gather in one task. A slug that an
    earlier file got with its position counts as taken as well; only such slugs
    need another round.
    """
    named = with_global_index(files, "name").withColumn("slug", slug_id(F.col("name")))
    firsts = named.groupBy("slug").agg(F.min("name").alias("name")).withColumn(
        "_first", F.lit(True)
    )
    suffixed = F.concat_ws("_", "slug", F.col("index").cast("string"))
    placed = stage_table(
        named.join(firsts, ["slug", "name"], "left").withColumn(
            "_first", F.coalesce("_first", F.lit(False))
        ),
        "slugs",
    )
    while True:
        made = placed.where(~F.col("_first")).groupBy(suffixed.alias("slug")).agg(
            F.min("index").alias("_made_at")
        )
        met = placed.join(made, "slug", "left").withColumn(
            "_met", F.col("_first") & F.coalesce(F.col("_made_at") < F.col("index"), F.lit(False))
        )
        if met.where("_met").isEmpty():
            break
        placed = stage_table(
            met.withColumn("_first", F.col("_first") & ~F.col("_met")).drop("_met", "_made_at"), "slugs"
        )
    return (
        placed.withColumn("episode_id", F.when(F.col("_first"), F.col("slug")).otherwise(suffixed))
        .withColumn("title", derive_title(F.col("name")))
        .drop("_first")
    )


def current_manifest(manifest: DataFrame) -> DataFrame:
    """Only records of the current version count; others mean a fresh start."""
    return manifest.where(F.col("version") == fv.MANIFEST_VERSION)


def ingest_plan(
    present: DataFrame, manifest: DataFrame, stored: DataFrame, fingerprint: str
) -> DataFrame:
    """Per present episode: reuse or (re)transcribe, and why.

    ``stored`` lists the episode ids whose transcript can be read.
    """
    known = current_manifest(manifest).select(
        "episode_id",
        F.col("sha256").alias("_old_sha"),
        F.col("asr_fingerprint").alias("_old_fingerprint"),
    )
    have = stored.select("episode_id").distinct().withColumn("_stored", F.lit(True))
    reason = (
        F.when(F.col("_old_sha").isNull(), "new")
        .when(F.col("_old_sha") != F.col("sha256"), "content changed")
        .when(F.col("_old_fingerprint") != fingerprint, "configuration changed")
        .when(F.col("_stored").isNull(), "transcript missing")
    )
    return (
        present.join(known, "episode_id", "left")
        .join(have, "episode_id", "left")
        .withColumn("reason", reason)
        .withColumn("action", F.when(reason.isNull(), "reuse").otherwise("transcribe"))
        .drop("_old_sha", "_old_fingerprint", "_stored")
    )


def removed_episodes(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest records whose source is gone."""
    return current_manifest(manifest).join(
        present.select("episode_id"), "episode_id", "left_anti"
    )


def next_manifest(transcripts: DataFrame, chunks: DataFrame, fingerprint: str) -> DataFrame:
    counts = chunks.groupBy("episode_id").agg(F.count("*").cast("int").alias("num_chunks"))
    return (
        transcripts.join(counts, "episode_id", "left")
        .na.fill(0, ["num_chunks"])
        .select(
            F.lit(fv.MANIFEST_VERSION).alias("version"),
            "episode_id",
            F.col("source_sha256").alias("sha256"),
            F.lit(fingerprint).alias("asr_fingerprint"),
            F.col("episode_title").alias("title"),
            "source_file",
            "duration",
            F.size("segments").alias("num_segments"),
            "num_chunks",
        )
    )


def ingest_stats(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of totals; the episodes behind them are the rows of ``plan``."""
    return plan.select("episode_id", "action").join(manifest, "episode_id").agg(
        F.count("*").alias("episodes"),
        F.count_if(F.col("action") == "transcribe").alias("transcribed"),
        F.count_if(F.col("action") == "reuse").alias("reused"),
        F.round(F.sum("duration"), 1).alias("total_audio_seconds"),
        F.sum(F.col("num_segments").cast("bigint")).alias("total_segments"),
        F.sum(F.col("num_chunks").cast("bigint")).alias("total_chunks"),
    )


def episode_catalogue(manifest: DataFrame) -> DataFrame:
    """Episodes sorted by title, counts defaulting to zero."""
    return (
        current_manifest(manifest)
        .select(
            "episode_id",
            "title",
            "source_file",
            "duration",
            "sha256",
            F.coalesce("num_segments", F.lit(0)).alias("num_segments"),
            F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        )
        .orderBy("title")
    )
