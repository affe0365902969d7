"""A training corpus from raw documents: five stages, each over all that the last one kept."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.llm import decontamination, language_id, near_copies, pieces, simhash, toxicity
from groundspan.llm.tables import table
from groundspan.staging import fits_broadcast, stage_path, stage_table


def small_side(ids: DataFrame) -> DataFrame:
    """A narrow staged table, to be broadcast if its row count allows; else the join shuffles."""
    return F.broadcast(ids) if fits_broadcast(ids) else ids


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows whole in one column ``row``, beside others; so a caller's columns can have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one of the models learned from them recognises."""
    verdict = language_id.judged(spark, language_id.learn(docs), F.col("text"))
    return carried(docs, verdict=verdict).where(~F.col("verdict.rejected")).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = carried(docs, score=toxicity.toxicity(spark, model, F.col("text")))
    return scored.where(F.col("score") < 0.5).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, judge=simhash.near_duplicates) -> DataFrame:
    """The first row, by id and text, of each group that ``judge`` makes; rows without an id stay.

    Rows of one id with different texts are judged apart.
    """
    key = F.xxhash64("text")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", key.alias("text_key")))
    classes = judge(docs.select(named.alias("row"), "text"), doc_id="row").where("doc_id is not null")
    by_row = classes.groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n")
    )
    odd = by_row.where("gone or n > 1").select("gone", "n", F.col("doc_id.doc_id").alias("odd_id"), F.col("doc_id.text_key").alias("odd_key"))
    odd = small_side(stage_table(odd, "near-dedup-rows"))
    rows = carried(docs, id=F.col("doc_id"), key=key)
    same = (F.col("id") == F.col("odd_id")) & (F.col("key") == F.col("odd_key"))
    kept = rows.where("id is not null").join(odd, same, "left").where("gone is null or not gone")
    # of rows with the same id and text one stays
    once = kept.where("n is null").select("row.*")
    first = kept.where("n is not null").groupBy("odd_id", "odd_key").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return once.unionByName(first.select("row.*")).unionByName(docs.where("doc_id is null"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints (as in op1) or five-word shingles
    of similarity 0.8 or more link."""
    return near_dedup(spark, docs, sf_dir, partial(near_copies.near_copies, by_simhash=True))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth is text of the benchmark."""
    judged = decontamination.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    # written first: a filter on the verdict would be pushed into its making and cut the text into words for every place
    judged = stage_table(judged.select("doc_id", "text_key", "contaminated"), "contamination")
    bad = judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = small_side(stage_table(bad, "contaminated-ids"))
    rows = carried(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language ID", languages),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece", encoded),
]

# Language models and fingerprints are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
