"""Approximate dense top-k: bucketed random projections in place of all pairs.

Spark ML's ``BucketedRandomProjectionLSH`` draws the projections. ``width`` of
them make the key of one hash table, and a passage is a candidate of a question
if they share the key of any of ``tables`` tables. More tables find more, a
wider key scores less.

Passages and questions of one bucket meet in blocks of bounded size, so a bucket
with a large share of all passages is dealt over many tasks, and of each block
only the best ``k`` of a question go on: no row per pair exists and no bucket is
cut short. Scores are those of the exact search; what can differ is which
passages were looked at.

Cases: a question whose buckets hold no passage has no hits; a null vector takes
no part on either side; repeated passages rank by id. Empty tables give none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from groundspan.operators import dense
from groundspan.operators.lexical import rank_topk
from groundspan.staging import join_checked, stage_table

TABLES, WIDTH, BUCKET = 6, 2, 1.0
SEED = 42


def _keyed(df: DataFrame, model, tables: int, width: int) -> DataFrame:
    """Each row once per hash table, with the table's number and the row's key there."""
    as_doubles = F.transform("vector", lambda x: x.cast("double"))
    hashed = model.transform(df.where("vector is not null").withColumn("_v", array_to_vector(as_doubles)))
    # one projection is a vector of one number
    flat = F.concat(*[F.array(_number(F.get("_h", F.lit(i)))) for i in range(tables * width)])
    keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, F.slice(flat, t * width + 1, width)))
    return hashed.withColumn("_bucket", F.explode(keys)).drop("_v", "_h")


def _number(vector: Column) -> Column:
    return F.get(vector_to_array(vector), F.lit(0)).cast("bigint")


def _dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """Rows of a bucket over its blocks, each once for every block of the other side."""
    every = F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s"))).withColumn(other, F.explode(every))


def approx_topk(
    queries: DataFrame, passages: DataFrame, k: int, tables: int = TABLES, width: int = WIDTH, bucket: float = BUCKET, seed: int = SEED
) -> DataFrame:
    """``dense_topk`` over the passages that share a bucket with the question.

    ``bucket`` is the length of a projection's buckets, in units of the vectors.
    """
    queries = queries.select("query_id", "vector", F.col("scope").cast("string").alias("scope"))
    passages = passages.select("chunk_id", "episode_id", "vector")
    schema = dense._result_schema(queries)
    some = passages.where("size(vector) > 0").select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("_v")).limit(1)
    if some.isEmpty():
        found = queries.sparkSession.createDataFrame([], schema)
        return _ranked(found, k)
    # fitting draws the projections and reads no more than the dimension
    model = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", numHashTables=tables * width, bucketLength=bucket, seed=seed
    ).fit(some)
    asked = stage_table(_keyed(queries, model, tables, width), "question-buckets")
    held = _keyed(passages, model, tables, width)

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        return rows.groupBy("_bucket").agg(F.ceil(F.count("*") / size).cast("bigint").alias(name))

    wanted = blocks(asked, "_slices", dense.QUERY_SLICE)
    held = stage_table(join_checked(held, wanted, "_bucket", "left_semi", salt_by="chunk_id"), "passage-buckets")
    sizes = stage_table(blocks(held, "_parts", dense.PASSAGE_BLOCK).join(wanted, "_bucket"), "bucket-sizes")
    asked = join_checked(asked, sizes, "_bucket", "inner", salt_by="query_id")
    held = join_checked(held, sizes, "_bucket", "inner", salt_by="chunk_id")
    on = ["_bucket", "_slice", "_part"]
    left = _dealt(asked, "_slice", "_part", "query_id").select(*on, *queries.columns)
    right = _dealt(held, "_part", "_slice", "chunk_id").select(*on, *passages.columns)

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        return dense.block_topk(ours, theirs, k)

    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)
    # a passage met in several tables counts once
    return _ranked(found.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score")), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return rank_topk(found, "dense_score", "dense_rank", k).select("query_id", "chunk_id", "dense_score", "dense_rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each question's exact hits that were found."""
    hit = found.select("query_id", "chunk_id", F.lit(1.0).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
