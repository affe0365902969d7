"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is its distance from the mean of all vectors and a direction. The
direction is rotated at random and kept as the signs of its coordinates, packed
in bits, with one correction scalar: the inner product of the direction and its
code. From these a query's inner product is estimated, with a bound on the
error that holds but for a small share of pairs. Vectors whose upper bound
reaches the ``k``-th best exact score among the best estimates are reranked on
the original vectors in double precision.

The index holds every vector: blocks of about ``BLOCK`` rows, each one row with
packed codes, scalars and vectors. Queries are blocks too; each query block is sent
to every vector block (a stated query set against all rows, in blocks). A vector
block is moved once, to where its query blocks come by, and only ``k`` rows per query
and block are shuffled on.

Cases: vectors null, zero, or with null or non-finite components take no part,
nor do those of another length than the commonest (of equally common, the
longest). Rows of one id count once, with the largest of their vectors. Ties go
to the smaller id. Fewer than ``k`` candidates: all of them; an empty table
gives no rows. Results carry only their own columns.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundspan.llm.tables import small_batches
from groundspan.staging import stage_table

BLOCK, QUERY_BLOCK = 8192, 1024
SEED = 42
# Width of the error bound, in standard errors of the estimate.
EPSILON = 1.9


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """(packed codes, distances to the centre, inner products of direction and code)."""
    residual = (vectors - centre) @ turn.T
    top = np.maximum(np.abs(residual).max(axis=1, initial=0), 1e-300)
    norm = top * np.sqrt(((residual / top[:, None]) ** 2).sum(axis=1))
    signs = residual > 0
    unit = residual / np.maximum(norm, 1e-300)[:, None]
    fit = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(signs, axis=1), norm, np.where(norm > 0, fit, 1.0)


def estimate(codes, norm, fit, centre: np.ndarray, turn: np.ndarray, queries: np.ndarray):
    """(estimates, error bounds) of shape (vectors, queries)."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    top = np.maximum(np.abs(queries).max(axis=1, initial=0), 1e-300)
    length = top * np.sqrt(((queries / top[:, None]) ** 2).sum(axis=1))
    # of length one, so that single precision holds any query
    turned = (queries / length[:, None] @ turn.T).astype(np.float32)
    inner = signs @ turned.T / (np.sqrt(dim) * fit[:, None]) * length
    error = np.sqrt(np.maximum(1 - fit**2, 0)) / fit * EPSILON / np.sqrt(max(dim - 1, 1))
    return queries @ centre + norm[:, None] * inner, ((norm * error)[:, None] + 1e-6 * norm[:, None] + 1e-300) * length


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += vectors[:, j] * query[j]
    return total


def best_of_block(ids, vectors, codes, norm, fit, centre, turn, query_ids, queries, k: int):
    """Up to ``k`` (query, id, score) per query, and how many vectors were reranked."""
    guess, error = estimate(codes, norm, fit, centre, turn, queries)
    out, reranked = [], 0
    for q, query in enumerate(queries):
        own = guess[:, q].copy()
        own[ids == query_ids[q]] = -np.inf
        others = len(ids) - int(np.isneginf(own).sum())
        if not others:
            continue
        first = np.argpartition(-own, min(k, len(own) - 1))[: min(k, others)]
        reach = np.sort(vectors[first] @ query)[0] if others > k else -np.inf
        chosen = np.flatnonzero(own + error[:, q] >= reach)
        chosen = np.union1d(chosen, first)
        chosen = chosen[ids[chosen] != query_ids[q]]
        reranked += len(chosen)
        rough = vectors[chosen] @ query
        if len(chosen) > k:
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            chosen = chosen[rough >= edge - 1e-9 * (1 + abs(edge))]
        score = exact(vectors[chosen], query)
        order = np.lexsort((ids[chosen], -score))[:k]
        out.append((np.full(len(order), query_ids[q]), ids[chosen[order]], score[order]))
    return out, reranked


def _blocks(rows: DataFrame, size: int, count: int, dim: int, centre, turn) -> DataFrame:
    """One row a block: ids, vectors, codes, norms and corrections as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast((centre, turn))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        centre, turn = shared.value
        vectors = np.array(block["vector"].to_list(), float).reshape(-1, dim)
        codes, norm, fit = encode(vectors, centre, turn)
        return pd.DataFrame(
            {
                "block": [block["block"].iloc[0]],
                "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
                "vectors": [vectors.tobytes()],
                "codes": [codes.tobytes()],
                "norm": [norm.tobytes()],
                "fit": [fit.tobytes()],
            }
        )

    blocks = -(-count // size)
    schema = "block int, ids binary, vectors binary, codes binary, norm binary, fit binary"
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block").applyInPandas(pack, schema)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others of each query row."""
    spark = vectors.sparkSession
    held = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("q"))
    good = stage_table(
        held.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"), F.bool_or("q").alias("q")),
        "vectors",
    )
    common = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    result = "query_id long, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    good = good.where(F.size("vector") == dim)
    seen = good.agg(
        F.count("*"), F.count_if("q"), *[F.avg(F.get("vector", F.lit(i))) for i in range(dim)]
    ).first()
    total, asked, centre = seen[0], seen[1], np.array(seen[2:], float)
    turn = rotation(dim)
    index = _blocks(good.select("vec_id", "vector"), BLOCK, total, dim, centre, turn)
    asked = max(asked, 1)
    questions = _blocks(good.where("q").select("vec_id", "vector"), QUERY_BLOCK, asked, dim, centre, turn).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    blocks = -(-total // BLOCK)
    # Spark takes exploded copies for no larger than one of them and would broadcast them all
    copies = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("merge")
    meetings = copies.join(index.hint("merge"), "block")
    shared = spark.sparkContext.broadcast((centre, turn))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, turn = shared.value
        read = lambda raw, kind, shape=-1: np.frombuffer(raw, kind).reshape(shape)
        for r in (r for batch in batches for r in batch.itertuples()):
            ids = read(r.ids, np.int64)
            found = best_of_block(
                ids,
                read(r.vectors, float, (-1, dim)),
                read(r.codes, np.uint8, (len(ids), -1)),
                read(r.norm, float),
                read(r.fit, float),
                centre,
                turn,
                read(r.q_ids, np.int64),
                read(r.q_vectors, float, (-1, dim)),
                k,
            )[0]
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    small_batches(spark)
    nearest = meetings.mapInPandas(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        nearest.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)


# DuckDB: every query row against every other row.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, max(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), d AS (SELECT len(e) AS n FROM v GROUP BY len(e) ORDER BY count(*) DESC, len(e) DESC LIMIT 1),
w AS (SELECT v.* FROM v JOIN d ON len(e) = n),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
