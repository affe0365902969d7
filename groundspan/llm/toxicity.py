"""Toxicity from class-conditional Kneser-Ney models.

Two models over the characters of words, one from toxic and one from ordinary
texts, share the counts of their shorter n-grams, so a rare form of a toxic
expression is recognised by its parts. A word's evidence is the difference of
its two log-likelihoods over its length; a text is judged by its mean evidence
and by its strongest words, put together by a logistic fit. The fit sees texts of
all folds, each scored by counts of the other folds; of each class a bounded
number, weighed by the class's size. Where the counts of the other folds lack a
class for all texts of one class, nothing can be fitted, and a text is judged by
its log-likelihood ratio and the odds of the classes.

Cases: a null or empty text, or one without letters, has no evidence and gets
the score of the fit at zero. A document with several labels is toxic if one of
them says so; null labels and ids count for nothing. With labels of one class
only, or none, every text gets the share of toxic labels, smoothed. Repeated
rows are judged alike. Only the text is read for a judgement; texts of any length
are read whole, in bounded parts. An empty table gives an empty one; the result
replaces columns of its names (``score``, ``predicted``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.llm.kneser_ney import Counts, KneserNey, fit, gathered
from groundspan.llm.tables import chunks, clean, id_bucket, small_batches
from groundspan.staging import join_checked, stage_table

ORDER, SHARED_TO = 5, 2
FOLDS = 5
CALIBRATION_ROWS = 4_000  # at most about so many labelled texts of each class fit the five weights
CLASSES = ["ordinary", "toxic"]
FEATURES = ["mean", "top1", "top2", "top3"]


def features(model: KneserNey, texts: list[str]) -> np.ndarray:
    """Mean evidence and the three strongest words' evidence, for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    row, scores, lengths = model.word_scores(texts)
    difference = scores[:, 1] - scores[:, 0]
    evidence = difference / lengths
    sizes = np.bincount(row, minlength=len(texts))
    total = np.bincount(row, lengths, len(texts))
    out[:, 0] = np.bincount(row, difference, len(texts)) / np.maximum(total, 1)
    order = np.lexsort((-evidence, row))
    begins = np.cumsum(sizes) - sizes
    for k in range(3):
        has = sizes > k
        out[has, 1 + k] = np.maximum(evidence[order[begins[has] + k]], 0)
    return out


def logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, times: np.ndarray | None = None
) -> np.ndarray:
    """Weights (the intercept last) by Newton steps; row i counts ``times[i]`` times, once by default."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.ones(len(x)) if times is None else times * (len(x) / times.sum())
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge / max(len(x), 1))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (share * (p - y)) / len(x) + penalty * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    grams: KneserNey | None
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.grams is None:
            return np.full(len(texts), self.prior)
        if self.weights is None:
            row, scores, _ = self.grams.word_scores(texts)
            ratio = np.bincount(row, scores[:, 1] - scores[:, 0], len(texts))
            return 1 / (1 + np.exp(-np.clip(ratio + np.log(self.prior / (1 - self.prior)), -35, 35)))
        x = features(self.grams, texts) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, cls, fold, text) of the rows to learn from: fold 0 is held out."""
    fold = id_bucket("doc_id", FOLDS)
    marks = (
        labels.where(F.col("toxic").isNotNull() & (fold != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
    )
    joined = join_checked(docs.select("doc_id", "text"), marks, "doc_id", "inner", salt_by="doc_id")
    cls = F.when(F.col("_toxic") == 1, CLASSES[1]).otherwise(CLASSES[0])
    return joined.select("doc_id", cls.alias("cls"), fold.alias("fold"), "text")


def learn(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> ToxicityModel:
    """Counts come from all labelled rows; the weights from rows of all folds, each
    scored by counts that had not seen its fold."""
    spark = docs.sparkSession
    rows = labelled(docs, labels)
    keyed = rows.select("doc_id", F.concat_ws("/", F.col("fold").cast("string"), "cls").alias("cls"), "text")
    sizes = {(r["cls"], r["fold"]): r["count"] for r in rows.groupBy("cls", "fold").count().collect()}
    of_class = {c: sum(n for (own, _), n in sizes.items() if own == c) for c in CLASSES}
    ordinary, toxic = (of_class[c] for c in CLASSES)
    prior = (toxic + 1) / (toxic + ordinary + 2)
    one = np.ones(len(FEATURES))
    if not toxic or not ordinary:
        return ToxicityModel(None, one, np.zeros(len(FEATURES) + 1), prior)

    counts = gathered(keyed, order)

    def model(of: Counts) -> KneserNey:
        return fit(of.renamed(lambda name: name.split("/")[1], CLASSES), order, SHARED_TO)

    small_batches(spark)
    draw = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    bound = [F.when(F.col("cls") == c, CALIBRATION_ROWS / max(of_class[c], 1)) for c in CLASSES]
    # of a class within the bound all rows are drawn
    drawn = stage_table(rows.where(draw <= F.coalesce(*bound)).dropDuplicates(["doc_id"]), "toxicity-calibration")
    xs, ys = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
    for fold in range(1, FOLDS):
        own = {c: sizes.get((c, fold), 0) for c in CLASSES}
        if not any(own.values()) or any(of_class[c] == own[c] for c in CLASSES):
            continue  # nothing to score, or the other folds lack a class
        others = spark.sparkContext.broadcast(model(counts.of([c for c in counts.classes if not c.startswith(f"{fold}/")])))

        @F.pandas_udf("array<double>")
        def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                texts = clean(batch)
                parts = [features(others.value, texts[p]) for p in chunks(texts)]
                yield pd.Series([list(r) for part in parts for r in part])

        seen = (
            drawn.where(F.col("fold") == fold)
            .select(evidence("text").alias("x"), (F.col("cls") == CLASSES[1]).cast("int").alias("y"))
            .toArrow()
        )
        xs.append(np.array(seen["x"].to_pylist(), float).reshape(-1, len(FEATURES)))
        ys.append(np.array(seen["y"].to_pylist(), float))
        others.destroy()
    x, y = np.concatenate(xs), np.concatenate(ys)
    if len(set(y)) < 2:
        return ToxicityModel(model(counts), one, None, prior)
    scale = np.maximum(x.std(axis=0), 1e-6)
    times = np.where(y == 1, toxic / (y == 1).sum(), ordinary / (y == 0).sum())
    return ToxicityModel(model(counts), scale, logistic(x / scale, y, times=times), prior)


def toxicity(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """A score from 0 to 1 for a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = clean(batch)
            parts = [shared.value.score(texts[p]) for p in chunks(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return docs.withColumn("score", toxicity(docs.sparkSession, model, F.col(text))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), learn(docs, labels))
    held_out = F.coalesce(id_bucket("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
