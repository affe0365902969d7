"""Language identification with one Kneser-Ney model per language.

Counts come from all labelled rows outside the held-out quarter of ids. A text is
rejected if its cross-entropy is far above what is usual for its language; what is
usual comes from all labelled rows outside the held-out quarter, each scored by its
language's counts without its third of the ids.

Cases: a null text or one without letters is ``und``, scores 0 and is rejected.
Ties go to the language that sorts first. With no labelled row at all every text
is ``und``. Repeated rows count as often as they appear and are judged alike.
Only the text is read for a judgement; the result replaces columns of its names.
Texts of any length are read whole, in bounded parts. There is no bound on the
number of languages; the work grows with it. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.llm.kneser_ney import Counts, KneserNey, fit, fit_apart, gathered
from groundspan.llm.tables import chunks, clean, id_bucket, small_batches
from groundspan.staging import stage_table

ORDER = 4
UNKNOWN = "und"
FOLDS = [0, 1, 3]  # remainders of the ids that may be learned from
# Letters beyond which more text does not make the posterior any surer.
EVIDENCE = 200
LEAST_LETTERS = 20
VERDICT = "lang_pred string, score double, cross_entropy double, letters bigint, rejected boolean"


@dataclass
class LanguageModel:
    """The models, and per language the usual cross-entropy and its spread a symbol."""

    grams: KneserNey
    mean: np.ndarray
    spread: np.ndarray

    def judge(self, texts: list[str]) -> pd.DataFrame:
        languages = self.grams.classes
        symbols = np.zeros(len(texts), np.int64)
        totals = np.zeros((len(texts), len(languages)))
        if languages:
            totals, symbols = self.grams.text_scores(texts)
        known = symbols > 0
        if not languages:
            known[:] = False
        entropy = -totals / np.maximum(symbols, 1)[:, None] if languages else np.zeros((len(texts), 1))
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        gaps = (entropy - lowest[:, None]) * np.minimum(symbols, EVIDENCE)[:, None]
        posterior = 1.0 / np.exp(-np.minimum(gaps, 700)).sum(axis=1)
        limit = self.limit(best, symbols) if languages else lowest
        return pd.DataFrame(
            {
                "lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                "score": np.where(known, posterior, 0.0),
                "cross_entropy": np.where(known, lowest, np.nan),
                "letters": symbols,
                "rejected": ~known | (lowest > limit),
            }
        )

    def limit(self, language: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Half way from the usual cross-entropy to that of blind guessing, plus six
        standard errors of a text of this length."""
        blind = np.log(max(self.grams.symbols, 2))
        mean, spread = self.mean[language], self.spread[language]
        return mean + np.maximum(blind - mean, 0) / 2 + 6 * spread / np.sqrt(np.maximum(symbols, 1))


def judged(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct of ``VERDICT`` for a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            parts = [shared.value.judge(texts[p]) for p in chunks(texts)]
            yield pd.concat(parts, ignore_index=True) if parts else shared.value.judge([])

    return verdict(text)


def learn(docs: DataFrame, order: int = ORDER) -> LanguageModel:
    """The models and lines of the languages of ``docs``; texts under ``LEAST_LETTERS``
    letters speak for a language's line only if it has no others."""
    spark = docs.sparkSession
    fold = id_bucket("doc_id", 4)
    rows = docs.where((fold != 2) & F.col("lang").isNotNull()).select(
        "doc_id", fold.alias("fold"), F.col("lang").alias("cls"), "text"
    )
    keyed = rows.select("doc_id", F.concat_ws("/", F.col("fold").cast("string"), "cls").alias("cls"), "text")
    counts = gathered(keyed, order)
    language = lambda name: name.split("/", 1)[1]
    grams = fit(counts.renamed(language), order) if counts.classes else KneserNey([], order, 0, 0, {}, {})
    languages = grams.classes
    some = np.full(len(languages), 1.0)
    if not languages:
        return LanguageModel(grams, some, some)
    mean, spread = np.full(len(languages), np.log(max(grams.symbols, 2))), np.ones(len(languages))
    for r in sorted(_usual(rows, counts, order), key=lambda r: r["long"]):
        at = languages.index(r["cls"])
        mean[at] = r["mean"]
        variance = r["squares"] - 2 * r["mean"] * r["products"] + r["mean"] ** 2 * r["n"]
        spread[at] = max(variance, 0.01) ** 0.5
    return LanguageModel(grams, mean, spread)


def _usual(rows: DataFrame, counts: Counts, order: int) -> list:
    """Per language, and for short and long texts: moments of the cross-entropy under
    the language's own model without the text's fold (with it, if the language has no other)."""
    language = lambda name: name.split("/", 1)[1]
    spark, found = rows.sparkSession, None
    small_batches(spark)
    for fold in FOLDS:
        others = {language(c) for c in counts.classes if not c.startswith(f"{fold}/")}
        used = [c for c in counts.classes if not c.startswith(f"{fold}/") or language(c) not in others]
        models = spark.sparkContext.broadcast(fit_apart(counts.of(used).renamed(language), order))

        @F.pandas_udf("entropy double, letters bigint")
        def own(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for classes, batch in batches:
                texts = np.array(clean(batch), object)
                entropy, letters = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for cls, rows_of in classes.groupby(classes.to_numpy(), sort=False).indices.items():
                    model = models.value.get(cls)  # none for a language of which no letter was counted
                    for part in chunks(texts[rows_of]) if model else ():
                        totals, letters[rows_of[part]] = model.text_scores(texts[rows_of[part]].tolist())
                        entropy[rows_of[part]] = -totals[:, 0] / np.maximum(letters[rows_of[part]], 1)
                yield pd.DataFrame({"entropy": entropy, "letters": letters})

        scored = stage_table(
            rows.where(F.col("fold") == fold).select("cls", own("cls", "text").alias("v")).select("cls", "v.*"),
            "language-entropy",
        )
        models.destroy()
        found = scored if found is None else found.unionByName(scored)
    entropy, n = F.col("entropy"), F.col("letters")
    return (
        found.where("letters > 0")
        .groupBy("cls", (n >= LEAST_LETTERS).alias("long"))
        .agg(
            F.avg(entropy).alias("mean"),
            F.avg(n * entropy * entropy).alias("squares"),
            F.avg(n * entropy).alias("products"),
            F.avg(n).alias("n"),
        )
        .collect()
    )


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``VERDICT``."""
    names = [part.split()[0] for part in VERDICT.split(", ")]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    verdict = judged(docs.sparkSession, model, F.col(text)).alias("verdict")
    return docs.select(F.struct(*others).alias("row"), verdict).select("row.*", *[f"verdict.{n}" for n in names])


def language_query(docs: DataFrame) -> DataFrame:
    judged_docs = identify_languages(docs.select("doc_id", "text"), learn(docs))
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    return judged_docs.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )
