"""Document quality from a linear-chain conditional random field over lines.

Every line of a text (split at ``\\n``) is labelled good or bad. A line is described
by its shares of kinds of characters, its words (length, variety, repetition, how
they end) and by how often the line stands in its text, and also by the same
numbers of the line before and after it. The field weighs these and the step from
one line's label to the next; forward and backward sums give each line's marginal
probability to be good. A text's score is the mean of these, weighted by the
lines' lengths.

Labels are known for documents, not lines, so in learning each line carries the
label of its document. The field is fitted on a bounded sample of labelled rows:
of each class about ``SAMPLE_DOCS`` documents, drawn by a hash of the id and weighed
by the class's size, of each a stretch of at most ``SAMPLE_LINES`` lines that begins
at a line drawn by a hash. Judging reads every line of every text.

Cases: a null or empty text is one empty line. A document with several labels is
good if one of them says so; null labels and ids count for nothing. With labels
of one class only, or none, every text gets the smoothed share of good labels.
Repeated rows are judged alike; an empty table gives an empty one. Texts of any
length are judged whole, handled together up to a bounded number of characters.
Results replace columns of their names (``score``, ``predicted``, ``lines``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.llm.tables import chunks, clean, id_bucket, small_batches
from groundspan.staging import join_checked, stage_table

FOLDS = 5
SAMPLE_DOCS, SAMPLE_LINES = 2_500, 48
THRESHOLD = 0.3
RIDGE = 1e-4
ROUNDS = 150

SPACE, LOWER, UPPER, DIGIT, MARK, SYMBOL = range(6)
_MARKS = set(".,;:'\"!?-()¿¡«»’“”")
_kinds: np.ndarray | None = None


def kinds_of(points: np.ndarray) -> np.ndarray:
    """The kind of each code point; beyond U+FFFF ideographs are letters, the rest symbols."""
    global _kinds
    if _kinds is None:
        def kind(c: str) -> int:
            if c.isspace():
                return SPACE
            if c.isalpha():
                return UPPER if c.isupper() else LOWER
            return DIGIT if c.isdigit() else MARK if c in _MARKS else SYMBOL

        _kinds = np.fromiter((kind(chr(p)) for p in range(1 << 16)), np.uint8, 1 << 16)
    out = _kinds[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        out[high] = np.where((points[high] >= 0x20000) & (points[high] < 0x32000), LOWER, SYMBOL)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[begins]


def _grouped(key: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group: how many different keys, and how often the commonest stands in it."""
    order = np.argsort(key + group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    own, of = key[order], group[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(own)))
    most = np.zeros(groups, np.int64)
    np.maximum.at(most, of[first], times)
    return np.bincount(of[first], minlength=groups), most


LOCAL = [
    "letters", "upper", "digits", "marks", "symbols", "spaces", "words", "word_length", "variety", "commonest",
    "echo", "ends_symbol", "ends_mark", "lone", "capital", "closed", "empty", "repeated", "chars",
]


def line_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of each line, its length in characters, lines of each text)."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    breaks = np.flatnonzero(points == 10)
    begins, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, n)
    counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    lines, size = len(begins), ends - begins
    kind = kinds_of(points)
    chars = np.maximum(size, 1)
    share = {k: _sums(kind == k, begins, ends) / chars for k in range(6)}
    letters = share[LOWER] + share[UPPER]

    solid = kind != SPACE
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    w_begin, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros((lines, len(LOCAL)), np.float32)
    put = lambda name, values: out.__setitem__((slice(None), LOCAL.index(name)), values)
    put("letters", letters)
    put("upper", share[UPPER] / np.maximum(letters, 1e-9))
    put("digits", share[DIGIT])
    put("marks", share[MARK])
    put("symbols", share[SYMBOL])
    put("spaces", share[SPACE])
    put("empty", size == 0)
    put("chars", np.log1p(size) / 8)
    if len(w_begin):
        line = np.searchsorted(begins, w_begin, "right") - 1
        words = np.bincount(line, minlength=lines)
        some = np.maximum(words, 1)
        at = np.flatnonzero(solid)
        word = np.repeat(np.arange(len(w_begin)), w_end - w_begin)
        offset = (at - w_begin[word]).astype(np.uint64)
        value = _mixed(points[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + offset * np.uint64(0x165667B19E3779F9) + np.uint64(1))
        first = np.concatenate([[0], np.cumsum(w_end - w_begin)[:-1]])
        key = np.add.reduceat(value, first)
        different, most = _grouped(key, line, lines)
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
        last = kind[w_end - 1]
        per = lambda mask: np.bincount(line[mask], minlength=lines) / some
        put("words", np.log1p(words) / 6)
        put("word_length", np.minimum(np.bincount(line, w_end - w_begin, lines) / some, 30) / 10)
        # of many words fewer are different, whatever the text
        put("variety", different / np.maximum(words, 1) * np.sqrt(np.minimum(words, 40) / 40))
        put("commonest", most / some * np.sqrt(np.minimum(words, 40) / 40))
        put("echo", per(again))
        put("ends_symbol", per(last == SYMBOL))
        put("ends_mark", per(last == MARK))
        put("lone", per((w_end - w_begin == 1) & (kind[w_begin] >= MARK)))
        l_first = np.searchsorted(line, np.arange(lines))
        has = words > 0
        head = w_begin[np.minimum(l_first, len(w_begin) - 1)]
        tail = w_end[np.maximum(np.searchsorted(line, np.arange(lines), "right") - 1, 0)] - 1
        put("capital", has & (kind[head] == UPPER))
        put("closed", has & np.isin(points[tail], [ord(c) for c in ".!?"]))
        rank = (np.arange(len(key)) - l_first[line]).astype(np.uint64)
        whole = np.zeros(lines, np.uint64)
        np.add.at(whole, line, _mixed(key + rank * np.uint64(0xD6E8FEB86659FD93)))
        text = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((whole, text))
        same = np.zeros(lines, bool)
        same[1:] = (whole[order[1:]] == whole[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        repeated = np.zeros(lines, bool)
        repeated[order] = same | np.append(same[1:], False)
        put("repeated", repeated & has)
    return out, size, counts


def described(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the field weighs for each line: its numbers, their squares, its neighbours' numbers."""
    lines, width = numbers.shape
    ends = np.cumsum(counts)
    has_before, has_after = np.ones(lines, bool), np.ones(lines, bool)
    has_before[ends - counts], has_after[ends - 1] = False, False
    out = np.zeros((lines, 4 * width + 3), np.float32)
    out[:, :width] = numbers
    out[:, width : 2 * width] = numbers**2
    out[1:, 2 * width : 3 * width] = numbers[:-1]
    out[:-1, 3 * width : 4 * width] = numbers[1:]
    out[:, 2 * width : 3 * width] *= has_before[:, None]
    out[:, 3 * width : 4 * width] *= has_after[:, None]
    out[:, -3], out[:, -2], out[:, -1] = has_before, has_after, 1
    return out


def marginals(score: np.ndarray, step: np.ndarray, counts: np.ndarray):
    """(probability of good for each line, expected steps by labels, log partition), per text.

    ``score`` is what good has over bad for each line, ``step[a, b]`` the weight of
    label b after a. Texts go through together, longest first, one line of each at
    a time.
    """
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    longest = int(left[0]) if len(left) else 0
    active = len(left) - np.searchsorted(left[::-1], np.arange(longest), "right")
    unary = np.zeros((len(score), 2))
    unary[:, 1] = score
    forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    forward[begin] = unary[begin]
    for t in range(1, longest):
        at = begin[: active[t]] + t
        before = forward[at - 1]
        forward[at] = np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1]) + unary[at]
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        after = backward[at] + unary[at]
        backward[at - 1] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
    ends = np.cumsum(counts) - 1
    whole = np.logaddexp(forward[ends, 0], forward[ends, 1])
    of = np.repeat(np.arange(len(counts)), counts)
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - whole[of], 0))
    inner = np.ones(len(score), bool)
    inner[ends - counts + 1] = False
    later = np.flatnonzero(inner)
    pairs = (
        forward[later - 1][:, :, None] + step + (unary[later] + backward[later])[:, None, :] - whole[of[later]][:, None, None]
    )
    return good, np.exp(np.minimum(pairs, 0)), of[later], whole


def fitted(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE):
    """(weights, steps) of the largest penalised likelihood, by limited-memory BFGS.

    ``y`` is the label of each text's lines and ``weight`` what the text counts for.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    total = float((weight * counts).sum())
    same = weight * (counts - 1)
    seen_steps = np.diag([same[y == 0].sum(), same[y == 1].sum()])
    by_line = weight[of]

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, step = v[:-4], v[-4:].reshape(2, 2)
        score = x @ w
        good, pairs, text, whole = marginals(score, step, counts)
        gained = (by_line * score * y[of]).sum() + (seen_steps * step).sum() - (weight * whole).sum()
        slope = x.T @ (by_line * (y[of] - good))
        steps = seen_steps - (weight[text][:, None, None] * pairs).sum(axis=0)
        gradient = np.concatenate([slope, steps.ravel()])
        return -gained / total + ridge * (v @ v) / 2, -gradient / total + ridge * v

    v = np.zeros(x.shape[1] + 4)
    value, gradient = at(v)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        way, kept = gradient.copy(), []
        for s, g in reversed(moved):
            a = (s @ way) / (s @ g)
            kept.append(a)
            way -= a * g
        if moved:
            s, g = moved[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(moved, reversed(kept)):
            way += (a - (g @ way) / (s @ g)) * s
        size = 1.0 if moved else min(1.0, 1 / max(np.abs(gradient).sum(), 1e-12))
        for _ in range(30):
            tried, tried_gradient = at(v - size * way)
            if tried <= value - 1e-4 * size * (gradient @ way):
                break
            size /= 2
        else:
            break
        s, g = -size * way, tried_gradient - gradient
        if s @ g > 1e-12:
            moved = [*moved[-9:], (s, g)]
        done = value - tried < 1e-7 * max(abs(value), 1e-3)
        v, value, gradient = v + s, tried, tried_gradient
        if done:
            break
    return v[:-4], v[-4:].reshape(2, 2)


@dataclass
class QualityModel:
    """The field, or the share of good labels where nothing can be fitted."""

    weights: np.ndarray | None
    steps: np.ndarray
    prior: float

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good of each line, its length, lines of each text)."""
        numbers, size, counts = line_numbers(texts)
        if self.weights is None:
            return np.full(len(size), self.prior), size, counts
        good = marginals(described(numbers, counts) @ self.weights, self.steps, counts)[0]
        return good, size, counts


def scores(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over each text's lines, weighted by length; empty lines count as one character."""
    of, weight = np.repeat(np.arange(len(counts)), counts), np.maximum(size, 1)
    return np.clip(np.bincount(of, good * weight, len(counts)) / np.bincount(of, weight, len(counts)), 0, 1)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the rows to learn from: fold 0 is held out."""
    marks = (
        labels.where(F.col("quality").isNotNull() & (id_bucket("doc_id", FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("y"))
    )
    return join_checked(docs.select("doc_id", "text"), marks, "doc_id", "inner", salt_by="doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> QualityModel:
    """The field of the labelled rows; at most about ``2 * sample_docs * sample_lines`` lines reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labelled(docs, labels)
    sizes = {0: 0, 1: 0}
    for r in rows.groupBy("y").count().collect():
        sizes[int(r["y"] == 1)] += r["count"]
    prior = (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
    if not sizes[0] or not sizes[1]:
        return QualityModel(None, np.zeros((2, 2)), prior)
    draw = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    bound = F.when(F.col("y") == 1, sample_docs / sizes[1]).otherwise(sample_docs / sizes[0])

    @F.pandas_udf("y int, lines int, numbers binary")
    def sampled(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, y, batch in batches:
            texts = clean(batch)
            out = []
            for part in chunks(texts):
                numbers, _, counts = line_numbers(texts[part])
                x = described(numbers, counts)
                begins = np.cumsum(counts) - counts
                for i, y_own, begin, count in zip(ids[part], y[part], begins, counts):
                    held = min(int(count), sample_lines)
                    first = int(begin) + int(i) * 2654435761 % (int(count) - held + 1)
                    out.append((int(y_own == 1), held, x[first : first + held].tobytes()))
            yield pd.DataFrame(out, columns=["y", "lines", "numbers"])

    drawn = rows.where(draw <= bound).dropDuplicates(["doc_id"])
    found = drawn.select(sampled("doc_id", "y", "text").alias("s")).select("s.*").toArrow().to_pandas()
    y, counts = found["y"].to_numpy(np.int64), found["lines"].to_numpy(np.int64)
    x = np.frombuffer(b"".join(found["numbers"]), np.float32).reshape(int(counts.sum()), -1)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, np.zeros((2, 2)), prior)
    # a text's lines together count as one, whatever their number
    per_class = np.array([sizes[c] / max((y == c).sum(), 1) for c in (0, 1)])
    weight = per_class[y] / counts
    weights, steps = fitted(x.astype(float), counts, y, weight / weight.mean())
    return QualityModel(weights, steps, prior)


def judged(spark: SparkSession, model: QualityModel, text: Column, with_lines: bool = True) -> Column:
    """struct of ``score`` and, if asked for, ``lines`` (start, length, probability of good)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    shape = "score double" + ", lines array<struct<start:bigint,length:bigint,good:double>>" * with_lines

    @F.pandas_udf(shape)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            out, spans = [np.zeros(0)], []
            for part in chunks(texts):
                good, size, counts = shared.value.lines(texts[part])
                out.append(scores(good, size, counts))
                if with_lines:
                    at = 0
                    for count in counts.tolist():
                        own, n = good[at : at + count], size[at : at + count]
                        start = np.cumsum(n + 1) - n - 1
                        spans.append([{"start": int(s), "length": int(k), "good": float(g)} for s, k, g in zip(start, n, own)])
                        at += count
            frame = pd.DataFrame({"score": np.concatenate(out)})
            yield frame.assign(lines=pd.Series(spans, dtype=object)) if with_lines else frame

    return verdict(text)


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD, with_lines: bool = True
) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and, if asked for, ``lines``."""
    names = ["score", "lines"][: 1 + with_lines]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {"predicted", *names}]
    verdict = judged(docs.sparkSession, model, F.col(text), with_lines)
    held = docs.select(F.struct(*others).alias("row"), verdict.alias("verdict"))
    return held.select(
        "row.*", *[f"verdict.{n}" for n in names], (F.col("verdict.score") >= threshold).cast("int").alias("predicted")
    )


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), learn(docs, labels), with_lines=False)
    held_out = F.coalesce(id_bucket("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
