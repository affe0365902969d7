"""The field over lines against sums over all labellings, and held-out documents."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from groundspan.llm import line_quality
from groundspan.llm.tables import table


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 5, 2])
    score, step = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs, of, whole = line_quality.marginals(score, step, counts)
    at = 0
    for text, n in enumerate(counts.tolist()):
        weight = {
            labels: np.exp(sum(score[at + i] * a for i, a in enumerate(labels)) + sum(step[p] for p in zip(labels, labels[1:])))
            for labels in itertools.product((0, 1), repeat=n)
        }
        total = sum(weight.values())
        assert np.isclose(whole[text], np.log(total))
        for i in range(n):
            assert np.isclose(good[at + i], sum(w for labels, w in weight.items() if labels[i]) / total)
        steps = np.zeros((2, 2))
        for labels, w in weight.items():
            for p in zip(labels, labels[1:]):
                steps[p] += w / total
        assert np.allclose(pairs[of == text].sum(axis=0), steps)
        at += n


def test_fit_is_a_maximum():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 6, 60)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(counts.sum(), 4)) + np.repeat(y, counts)[:, None] * np.array([1.0, 0.5, 0, 0])
    weight = rng.uniform(0.5, 2, 60)
    w, step = line_quality.fitted(x, counts, y, weight, ridge=0.01)

    def loss(v):
        score, s = x @ v[:-4], v[-4:].reshape(2, 2)
        own = np.repeat(y, counts)
        by_text = np.array([float((score * own)[a:b].sum()) for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts))])
        path = by_text + (counts - 1) * s[y, y]
        whole = line_quality.marginals(score, s, counts)[3]
        return -(weight * (path - whole)).sum() / (weight * counts).sum() + 0.005 * (v @ v)

    best = np.concatenate([w, step.ravel()])
    for _ in range(60):
        assert loss(best) <= loss(best + 0.02 * rng.normal(size=len(best))) + 1e-6


def plain_numbers(texts):
    out = []
    for text in texts:
        lines = text.split("\n")
        for line in lines:
            words = line.split()
            n, letters = max(len(line), 1), [c for c in line if c.isalpha()]
            row = dict.fromkeys(line_quality.LOCAL, 0.0)
            row |= {
                "letters": len(letters) / n, "upper": sum(c.isupper() for c in letters) / max(len(letters), 1e-9),
                "digits": sum(c.isdigit() for c in line) / n, "spaces": sum(c.isspace() for c in line) / n,
                "empty": float(not line), "chars": np.log1p(len(line)) / 8, "words": np.log1p(len(words)) / 6,
            }
            if words:
                less = np.sqrt(min(len(words), 40) / 40)
                row |= {
                    "word_length": min(sum(map(len, words)) / len(words), 30) / 10, "variety": len(set(words)) / len(words) * less,
                    "commonest": max(map(words.count, words)) / len(words) * less,
                    "echo": sum(a == b for a, b in zip(words, words[1:])) / len(words),
                    "capital": float(words[0][0].isupper()), "closed": float(words[-1][-1] in ".!?"),
                    "repeated": float([x.split() for x in lines].count(words) > 1),
                }
            out.append(row)
    return out


def test_numbers_of_lines_equal_plain_ones():
    texts = ["Ab cd, cd cd.\n\n  x | y |\nAb cd, cd cd.", "", "\n", "ÉA 12\t12 ß!", " ".join(["w"] * 90), "Ab cd, cd cd."]
    numbers, size, counts = line_quality.line_numbers(texts)
    assert counts.tolist() == [4, 1, 2, 1, 1, 1] and size.tolist() == [len(x) for t in texts for x in t.split("\n")]
    for row, want in zip(numbers, plain_numbers(texts)):
        for name in want:
            if name not in ("marks", "symbols", "ends_symbol", "ends_mark", "lone"):
                assert np.isclose(row[line_quality.LOCAL.index(name)], want[name], atol=1e-6), name


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["er", "in", "on", "th", "an", "es"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(1, 8))]
        if i % 5 == 0:
            lines = [" | ".join(x.split()) + " |" for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = [(i, int(i % 5 != 0)) for i, _ in rows] + [(3, None), (None, 0), (4, 0), (0, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    found = line_quality.quality_query(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == int(r["doc_id"] % 5 != 0) == int(r["score"] >= 0.3) for r in found if r["held_out"])
    model = line_quality.learn(docs, labels)
    # one bad line among good ones is told apart, and weighs by its length
    mixed = rows[1][1] + "\n" + " | ".join(rows[1][1].split()[:30]) + " |"
    odd = [(1, mixed, "c", 5), (2, None, "c", 5), (3, "", "c", 5), (3, "", "c", 5), (4, "\n" * 3000, None, None), (5, "word " * 100_000, "", 1), (None, "🙂𠀀 ퟿", "", 1)]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string, lines string, row int")
    judged = line_quality.score_quality(frame, model)
    assert judged.columns == ["doc_id", "text", "row", "score", "lines", "predicted"]
    for r in judged.collect():
        lines, text = r["lines"], r["text"] or ""
        assert [text[s["start"] : s["start"] + s["length"]] for s in lines] == text.split("\n")
        weight = [max(s["length"], 1) for s in lines]
        assert abs(r["score"] - sum(w * s["good"] for w, s in zip(weight, lines)) / sum(weight)) < 1e-9 and 0 <= r["score"] <= 1
    last = judged.where("doc_id = 1").first()["lines"]
    assert last[-1]["good"] < 0.5 < last[0]["good"]


def test_one_class_or_none(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    for some in (labels.where("quality = 1"), labels.limit(0)):
        scored = line_quality.quality_query(docs, some).select(F.min("score"), F.max("score"), F.count("*")).first()
        assert abs(scored[0] - scored[1]) < 1e-9 and 0 < scored[0] < 1 and scored[2] == docs.count()
    assert line_quality.quality_query(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(600, 3), "doc_id bigint, text string")
    labels = spark.range(600).selectExpr("id as doc_id", "int(id % 5 != 0) as quality")
    model = line_quality.learn(docs, labels, sample_docs=60, sample_lines=3)
    found = line_quality.score_quality(docs, model, with_lines=False).collect()
    assert sum(r["predicted"] != int(r["doc_id"] % 5 != 0) for r in found) <= 6
