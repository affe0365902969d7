"""The passage store: loads that are only ever added, and what each of them touched.

``chunks/load=<n>`` holds the passages of a load and ``touched/load=<n>`` the episodes
it speaks for, with or without passages. Of an episode the newest load counts. A load
is in force once its ``touched`` folder is complete, which is written last; a load
that is repeated replaces its own folders only, so a task or a driver that is lost
midway leaves the store as it was. Nothing is rewritten in place; ``compact`` puts
what counts together when loads have become many.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan import schemas
from groundspan.staging import SALTS, fits_broadcast, stage_table

_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _touched(spark: SparkSession, path: str) -> DataFrame:
    schema = "episode_id string, load bigint"
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/touched").parquet(f"{path}/touched")
    except AnalysisException as exc:
        if exc.getCondition() not in _MISSING:
            raise
        return spark.createDataFrame([], schema)


def loads(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the loads in force; one for each since the last compaction."""
    return sorted(r["load"] for r in _touched(spark, path).select("load").distinct().collect())


def _write_load(chunks: DataFrame, touched: DataFrame, path: str, load: int) -> None:
    chunks.select([c.split()[0] for c in schemas.CHUNK.split(", ")]).write.mode("overwrite").parquet(f"{path}/chunks/load={load}")
    touched.select("episode_id").distinct().write.mode("overwrite").parquet(f"{path}/touched/load={load}")


def write_chunks(chunks: DataFrame, path: str, episodes: DataFrame | None = None) -> None:
    """A new load that speaks for ``episodes`` (default: those with passages) and ends all others."""
    spark = chunks.sparkSession
    chunks = stage_table(chunks, "chunk-load")
    known = _touched(spark, path).select("episode_id").unionByName((episodes or chunks).select("episode_id"))
    replace_episodes(chunks, stage_table(known.distinct(), "chunk-episodes"), path)


def replace_episodes(chunks: DataFrame, touched: DataFrame, path: str, load: int | None = None) -> int:
    """Swap in new passages for the touched episodes (none: remove the episode); the load's number.

    ``load``: repeat that load, as a stream does with a batch that failed.
    """
    if load is None:
        load = max(loads(chunks.sparkSession, path), default=-1) + 1
    _write_load(chunks, touched, path, load)
    return load


def read_chunks(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The passages that count, as of load ``before`` if given.

    Rows that a newer load has replaced are left out by their (episode, load); there are
    as many of these as replacements, and they are broadcast if their number allows.
    """
    touched = _touched(spark, path)
    if before is not None:
        touched = touched.where(F.col("load") < before)
    in_force = sorted(r["load"] for r in touched.select("load").distinct().collect())
    if not in_force:
        return spark.createDataFrame([], schemas.CHUNK)
    newest = touched.groupBy("episode_id").agg(F.max("load").alias("newest"), F.count("*").alias("n")).where("n > 1")
    replaced = touched.join(newest, "episode_id").where("load < newest").select("episode_id", "load")
    stored = (
        spark.read.schema(schemas.CHUNK + ", load bigint")
        .option("basePath", f"{path}/chunks")
        .parquet(*[f"{path}/chunks/load={n}" for n in in_force])
    )
    if len(in_force) == 1:
        return stored.drop("load")
    replaced = stage_table(replaced, "replaced-episodes")
    if fits_broadcast(replaced):
        return stored.join(F.broadcast(replaced), ["episode_id", "load"], "left_anti").drop("load")
    # past the bound both sides go by the key and a salt, so a long episode spreads over tasks
    salted = stored.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
    copies = replaced.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, ["episode_id", "load", "_salt"], "left_anti").drop("load", "_salt")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """What counts in ``path`` as a store of one load in ``into``."""
    kept = read_chunks(spark, path)
    _write_load(kept, _touched(spark, path), into, 0)
