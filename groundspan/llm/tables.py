"""Reading inputs, and bounded batches inside Python workers."""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Characters of text that a Python worker handles at once.
CHUNK_CHARS = 500_000
BATCH_ROWS, BATCH_BYTES = 500, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session for rows that hold whole texts.

    The settings stay, as a query is planned when it is used.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def chunks(texts: Sequence, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of whole texts with about ``limit`` characters each."""
    begin = held = 0
    for at, text in enumerate(texts):
        held += len(text) if isinstance(text, str) else 1
        if held >= limit:
            yield slice(begin, at + 1)
            begin, held = at + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def clean(texts: pd.Series) -> list[str]:
    """Null texts as empty ones."""
    return [t if isinstance(t, str) else "" for t in texts]
