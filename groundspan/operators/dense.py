"""Dense vectors: an embedding hook and exact top-k by similarity."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from groundspan.functions import fixed_values as fv
from groundspan.operators.lexical import SCORE_DP, rank_topk
from groundspan.operators.topk import Best, in_blocks

Embedder = Callable[[Sequence[str]], np.ndarray]

# Query vectors and passages held by one task at a time, and passages and queries scored at once.
QUERY_SLICE = 4096
PASSAGE_BLOCK = 50_000
SCORED_ROWS, SCORED_QUERIES = 2048, 512


@lru_cache(maxsize=1 << 18)
def _hash_slot(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:4], 16) % dim, 1 if int(digest[4], 16) < 8 else -1


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic signed feature hashing of tokens, L2-normalised.

    Stands in for a neural model when none is installed; any callable from a
    list of texts to a (rows, dim) matrix can take its place.
    """
    find = re.compile(fv.TOKEN_PATTERN).findall
    stop = frozenset(fv.STOPWORDS)

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for token in find(text.lower()):
                if len(token) > 1 and token not in stop:
                    slot, sign = _hash_slot(token, dim)
                    out[row, slot] += sign
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def embed_column(
    df: DataFrame, embedder: Embedder, text: str = "text", into: str = "vector"
) -> DataFrame:
    """Append the embedding of ``text``; one call of the hook per Arrow batch.

    Only the text goes to the Python workers.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = np.asarray(embedder(batch.tolist()), dtype=np.float32) if len(batch) else []
            yield pd.Series(list(vectors), dtype=object)

    return df.withColumn(into, embed(text))


def dense_topk(
    queries: DataFrame, passages: DataFrame, k: int, query_slice: int = QUERY_SLICE
) -> DataFrame:
    """Exact top-``k`` passages by inner product of unit vectors.

    ``queries`` is (query_id, vector, scope) and ``passages`` is (chunk_id,
    episode_id, vector). One slice of queries is broadcast. More of them meet the
    passages in blocks of bounded size, without the driver. Only the best ``k``
    of a task per query are let through, so no row per pair exists. A scope
    limits the candidates before ranking.
    """
    total = queries.count()
    queries = queries.select("query_id", "vector", F.col("scope").cast("string").alias("scope"))
    passages = passages.select("chunk_id", "episode_id", "vector")
    if total <= query_slice:
        found = _broadcast_topk(queries, passages, k)
    else:
        found = _blocks_topk(queries, passages, k, total, query_slice)
    return rank_topk(found, "dense_score", "dense_rank", k).select(
        "query_id", "chunk_id", "dense_score", "dense_rank"
    )


def _result_schema(queries: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {query_type}, chunk_id string, dense_score double"


def _broadcast_topk(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    local = queries.toArrow()
    schema = _result_schema(queries)
    if not local.num_rows:
        return queries.sparkSession.createDataFrame([], schema)
    block = queries.sparkSession.sparkContext.broadcast(_query_block(local))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.value[0]), k)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                _add_scores(*block.value, batch.slice(at, SCORED_ROWS), best)
        yield from _kept(block.value[0], best).to_batches()

    return passages.mapInArrow(run, schema)


def _blocks_topk(queries: DataFrame, passages: DataFrame, k: int, total: int, query_slice: int) -> DataFrame:
    def begin(left: pa.Table):
        own, best = _query_block(left), Best(left.num_rows, k)

        def see(right: pa.Table) -> None:
            for batch in right.to_batches(SCORED_ROWS):
                _add_scores(*own, batch, best)

        return see, lambda: _kept(own[0], best)

    return in_blocks(queries, passages, total, passages.count(), query_slice, PASSAGE_BLOCK, begin, _result_schema(queries))


def block_topk(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of the passages ``right`` for each of the queries ``left``."""
    best = Best(left.num_rows, k)
    if not left.num_rows or not right.num_rows:
        return _kept(pa.array([], left.schema.field("query_id").type), best)
    own = _query_block(left)
    for batch in right.to_batches(SCORED_ROWS):
        _add_scores(*own, batch, best)
    return _kept(own[0], best)


def _kept(ids: pa.Array, best: Best) -> pa.Table:
    found = best.rows()
    if found is None:
        columns = [ids.slice(0, 0), pa.array([], "string"), pa.array([], "float64")]
    else:
        columns = [ids.take(found.column("question").combine_chunks()), found.column("chunk_id"), found.column("score")]
    return pa.table(columns, names=["query_id", "chunk_id", "dense_score"])


def _query_block(rows: pa.Table) -> tuple[pa.Array, np.ndarray, list]:
    ids = pa.concat_arrays(rows.column("query_id").chunks)
    return ids, np.array(rows.column("vector").to_pylist(), np.float64), rows.column("scope").to_pylist()


def _add_scores(ids: pa.Array, matrix: np.ndarray, scopes: list, batch: pa.RecordBatch, best: Best) -> None:
    # Rows in id order, so that of equal scores the left-most are the ones to keep.
    batch = batch.sort_by("chunk_id")
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    vectors = flat.astype(np.float64).reshape(batch.num_rows, -1)
    names = pa.table([batch.column("chunk_id")], names=["chunk_id"])
    episodes = None
    for at in range(0, len(matrix), SCORED_QUERIES):
        scores = np.round(matrix[at : at + SCORED_QUERIES] @ vectors.T, SCORE_DP) + 0.0
        own = scopes[at : at + SCORED_QUERIES]
        if any(s is not None for s in own):
            if episodes is None:
                episodes = np.asarray(batch.column("episode_id").to_pylist(), dtype=object)
            for row, scope in enumerate(own):
                if scope is not None:
                    scores[row, episodes != scope] = -np.inf
        best.add(at, scores, names)
