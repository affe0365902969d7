"""Taking in transcripts from a stream: what changed is cut anew and replaces what was stored.

A batch is planned against the stored manifest by content hash and configuration, as
``operators.ingest.ingest_plan`` does for a whole collection. Only new and changed
episodes are cut into passages; unchanged ones are not touched. An episode without
segments (null) is one whose source is gone: its passages and its record end.

Passages and manifest are written as loads numbered by the batch, the manifest last.
A batch that is repeated after a failure reads both as of the loads before it, so it
comes to the same result and replaces what it had written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan import schemas
from groundspan.operators.ingest import current_manifest, ingest_plan, next_manifest
from groundspan.operators.segments import chunk_segments
from groundspan.settings import Settings
from groundspan.sources.chunk_store import replace_episodes
from groundspan.staging import stage_table


def stored_manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest record of each episode that is still there, as of load ``before`` if given."""
    try:
        kept = spark.read.schema(schemas.MANIFEST + ", gone boolean, load bigint").option("basePath", f"{root}/manifest").parquet(f"{root}/manifest")
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schemas.MANIFEST)
    if before is not None:
        kept = kept.where(F.col("load") < before)
    names = [c.split()[0] for c in schemas.MANIFEST.split(", ")]
    newest = kept.groupBy("episode_id").agg(F.max_by(F.struct(*[n for n in names if n != "episode_id"], "gone"), "load").alias("r"))
    return newest.where("not r.gone").select([F.col("episode_id") if n == "episode_id" else F.col(f"r.{n}") for n in names])


def take_in(batch: DataFrame, root: str, load: int, settings: Settings, order: str) -> DataFrame:
    """One batch of transcripts into the store at ``root``; (episode_id, action, reason)."""
    spark = batch.sparkSession
    latest = batch.groupBy("episode_id").agg(F.max_by(F.struct(*batch.columns), F.struct(order, "source_sha256")).alias("r"))
    latest = stage_table(latest.select("r.*"), "ingest-batch")
    manifest = stage_table(current_manifest(stored_manifest(spark, root, load)), "ingest-manifest")
    here = latest.where("segments is not null")
    gone = latest.where("segments is null").join(manifest.select("episode_id"), "episode_id", "left_semi")
    # a record stands for stored passages, which are written before it
    present = here.select("episode_id", F.col("source_sha256").alias("sha256"))
    plan = stage_table(
        ingest_plan(present, manifest, manifest.select("episode_id"), settings.asr_fingerprint)
        .select("episode_id", "action", "reason")
        .unionByName(gone.select("episode_id", F.lit("remove").alias("action"), F.lit("source gone").alias("reason"))),
        "ingest-plan",
    )
    changed = stage_table(here.join(plan.where("action = 'transcribe'"), "episode_id", "left_semi"), "ingest-changed")
    chunks = stage_table(chunk_segments(changed, settings), "ingest-chunks")
    replace_episodes(chunks, plan.where("action <> 'reuse'"), f"{root}/chunks", load)
    records = next_manifest(changed, chunks, settings.asr_fingerprint).withColumn("gone", F.lit(False))
    ended = manifest.join(gone.select("episode_id"), "episode_id", "left_semi").withColumn("gone", F.lit(True))
    records.unionByName(ended).write.mode("overwrite").parquet(f"{root}/manifest/load={load}")
    return plan


def ingest_stream(transcripts: DataFrame, root: str, settings: Settings = Settings(), order: str = "arrived") -> None:
    """Take in what the source holds now. ``order``: of several versions of an episode in
    a batch the last by this column counts."""

    def merge(batch: DataFrame, number: int) -> None:
        take_in(batch, root, number, settings, order)

    (
        transcripts.writeStream.option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
        .awaitTermination()
    )
