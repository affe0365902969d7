"""Cutting lineage through shared storage, and joins with a checked small side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A broadcast side may hold at most this many (narrow) rows: tens of MB.
BROADCAST_ROWS = 500_000
SALTS = 32
# Bits of the map that says which keys a larger small side may hold (4 MB), in pieces of MAP_PIECE.
MAP_BITS, MAP_PIECE = 1 << 25, 1 << 15
_MAPPED = {"string", "binary", "bigint", "int", "smallint", "tinyint", "date", "boolean"}

_fallback_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session names none (a local test run) is a fresh temporary
    folder made, once per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="groundspan-")
    return _fallback_dirs[app]


def stage_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{label}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several consumers would otherwise recompute the same lineage.
    A written table survives the loss of any executor.
    """
    path = stage_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out an input that arrives in fewer splits than there are cores.

    A large table has far more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str,
    salt_by: str,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a table of any size to one that is expected to be small.

    The small side is broadcast only after its row count was checked. Past the
    bound both sides are shuffled on the key plus a salt drawn from
    ``salt_by``, so one hot key spreads over ``SALTS`` tasks; rows of the big side that
    cannot match stay behind, if the join drops them. ``how`` must not keep unmatched
    rows of the small side.
    """
    if how not in {"inner", "left", "left_semi"}:
        raise ValueError(f"join_checked cannot express a {how} join")
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    if how != "left":
        big = may_match(big, small, keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    )
    # Spark takes exploded copies for no larger than one of them and would broadcast them all
    return salted.hint("merge").join(copies.hint("merge"), keys + ["_salt"], how).drop("_salt")


def may_match(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``big`` without most of the rows whose keys ``small`` does not hold.

    A bit a hashed key, 4 MB at most for any size of ``small``; with far more keys than
    bits few rows are left out.
    """
    kinds = [(dict(big.dtypes)[k], dict(small.dtypes)[k]) for k in keys]
    if any(a != b or a not in _MAPPED for a, b in kinds):  # others may be equal and have other hashes
        return big
    place = F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))
    piece, bit = F.floor(place / MAP_PIECE).cast("int"), (place % MAP_PIECE).cast("bigint")
    bits = small.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = big.withColumns({"_piece": piece, "_bit": bit}).join(F.broadcast(bits), "_piece")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.getbit(byte, F.expr("cast(_bit % 8 as int)")) == 1
    return marked.where(held).select(*[F.col(f"`{c}`") for c in big.columns])
