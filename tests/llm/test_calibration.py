"""Calibration where a class or a language is rare."""

import random
import zlib

import numpy as np
import pytest

from groundspan.llm import kneser_ney, language_id, toxicity


def fold_of(i, folds=5):
    return zlib.crc32(str(i).encode()) % folds


def texts_with(toxic_ids, ids, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["er", "in", "on", "th", "an", "es"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = []
    for i in ids:
        words = [rng.choice(plain) for _ in range(20)]
        if i in toxic_ids:
            words += ["krumz" + rng.choice(plain) for _ in range(20)]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("folds", [(1, 2, 3), (2,)])
def test_few_toxic_labels_outside_one_fold(spark, folds):
    """No toxic label in the last fold, or in one fold only: toxic texts are still found."""
    ids = range(600)
    learnt = {i for f in folds for i in [i for i in ids if fold_of(i) == f][:3]}
    asked = {i for i in ids if fold_of(i) == 0}
    asked = set(sorted(asked)[:10])
    docs = spark.createDataFrame(texts_with(learnt | asked, ids, 4), "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(i in learnt)) for i in ids], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_query(docs, marks).where("held_out").collect()}
    assert {i for i, p in found.items() if p} == asked


def test_thinning_keeps_the_rare_class(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40)
    ids = range(600)
    toxic = {i for i in ids if i % 60 == 0}
    docs = spark.createDataFrame(texts_with(toxic, ids, 6), "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity_query(docs, marks).collect()
    assert {r["doc_id"] for r in found if r["predicted"]} == toxic


def test_row_weights_equal_repeated_rows():
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    times = np.array([1, 3, 2, 1])
    again = toxicity.logistic(np.repeat(x, times, 0), np.repeat(y, times), ridge=0)
    assert np.allclose(toxicity.logistic(x, y, ridge=0, times=times), again, atol=1e-5)


def test_language_line_of_a_rare_language(spark):
    """One text, or only short ones, set a language's line."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word("abcdef") for _ in range(20)), "aa") for i in range(40)]
    rare = [i for i in range(100, 140) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(rare[0], " ".join(word("uvwxyz") for _ in range(20)), "bb")]
    rows += [(i, word("klmnop") + " " + word("klmnop"), "cc") for i in rare[1:9]]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    blind = np.log(model.grams.symbols)
    assert model.grams.classes == ["aa", "bb", "cc"] and (model.mean < 0.9 * blind).all()


def test_language_line_counts_every_row(spark, monkeypatch):
    """All labelled rows outside the held-out quarter, those of one id too, each without its fold."""
    monkeypatch.setattr(language_id, "LINE_ROWS", 5, raising=False)
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    rows = [(i // 2, " ".join(word("abcdef" if i % 3 else "defghij") for _ in range(8 + i % 5)), "aa" if i % 3 else "bb") for i in range(120)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    usual = {"aa": [], "bb": []}
    for fold in language_id.FOLDS:
        seen = [(c, i, t) for i, t, c in rows if fold_of(i, 4) in language_id.FOLDS and fold_of(i, 4) != fold]
        others = kneser_ney.fit(kneser_ney.gathered(spark.createDataFrame(seen, "cls string, doc_id bigint, text string"), language_id.ORDER), language_id.ORDER)
        for at, c in enumerate(others.classes):
            totals, symbols = others.text_scores([t for i, t, own in rows if own == c and fold_of(i, 4) == fold])
            usual[c] += (-totals[:, at] / symbols).tolist()
    assert np.allclose(model.mean, [np.mean(usual[c]) for c in model.grams.classes])


def test_models_by_themselves_equal_those_of_all_classes():
    rng = np.random.default_rng(4)
    cls = np.sort(rng.integers(0, 3, 400))
    counts = kneser_ney.Counts(["a", "b", "c"], cls, cls * 0, *(rng.integers(1, 4, (2, 400)) + [[96], [0]]))
    counts.lo += (rng.integers(97, 101, 400) << kneser_ney.BITS) + (rng.integers(97, 101, 400) << 2 * kneser_ney.BITS)
    every, apart, texts = kneser_ney.fit(counts, 3), kneser_ney.fit_apart(counts, 3), ["abc cab", "", "dd aab 7", "xyz"]
    totals, symbols = every.text_scores(texts)
    for at, c in enumerate(every.classes):
        own, letters = apart[c].text_scores(texts)
        assert np.allclose(own[:, 0], totals[:, at]) and (letters == symbols).all()
