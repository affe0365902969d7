"""Interpolated Kneser-Ney models over the characters of words.

A text is its runs of letters, lower-cased. Each run is read as
``boundary, letters, boundary``; the letters and the closing boundary are
predicted from up to ``order - 1`` symbols before them in the same run. An
n-gram is two numbers of 63 bits, 21 bits a symbol, so every character keeps its
own code point: ``lo`` holds the predicted symbol (lowest) and the two before it,
``hi`` the ones before these, zeros stand before the start of the run.

Counting is one Spark aggregation over the rows. The counts of the highest order
then reach the driver, which derives the shorter orders from them, and the model is
sent to the workers, which look n-grams up in arrays sorted by a hash (and compare
the n-gram itself). All rows are counted and no n-gram is dropped, so the model grows
with the different n-grams of the rows. Only a caller who names a limit gets a model
of fewer rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, islice
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundspan.llm.tables import chunks, clean, small_batches
from groundspan.staging import stage_table

BITS, HELD = 21, 3
BOUNDARY = 32
DISCOUNT = 0.75
HELD_CHARS, FRAME_CHARS = 2_000_000, 300_000
CACHED_CELLS = 8_000_000
SCORED_CELLS = 800_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isalpha():
        return [text]
    found = _LETTERS.findall(text)
    if found and not "".join(found).isalpha():  # numbers such as a half are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def words_by_token(tokens: list[str]) -> list[list[str]]:
    """``words_of`` of each of many tokens without white space."""
    lowered = " ".join(tokens).lower().split(" ") if tokens else []
    return [[low] if low.isalpha() else words_of(low) for low in lowered]


_letter: np.ndarray | None = None


def words_in(tokens: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all tokens without white space in a row, their lengths, and how many each token has."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    if not tokens:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(" ".join(tokens).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter[points]
    edge = np.diff(letter, prepend=False, append=False).nonzero()[0]
    begin, end = edge[::2], edge[1::2]
    words = np.where(letter, points, np.uint32(BOUNDARY)).tobytes().decode("utf-32-le").split()
    token = np.searchsorted(np.flatnonzero(points == BOUNDARY), begin)
    return words, end - begin, np.bincount(token, minlength=len(tokens))


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, index of its word, a number equal for equal n-grams) for each predicted symbol of ``words``."""
    if order > 2 * HELD:
        raise ValueError(f"an n-gram holds at most {2 * HELD} symbols")
    if not words:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    joined = f" {' '.join(words)} "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    present = np.bincount(points) > 0
    size = int(present.sum()) + 1
    short = np.cumsum(present)[points]  # 1 to size - 1
    space = points == BOUNDARY
    at = np.arange(len(points))
    start = np.maximum.accumulate(np.where(space, at, 0))[:-1]
    word = np.cumsum(space)[:-1] - 1
    hi, lo, number = np.zeros(len(word), np.int64), points[1:].copy(), short[1:].copy()
    fits = size**order < 2**63
    for back in range(1, order):
        before = at[1:] - back
        inside = before >= start
        symbol = np.where(inside, points[np.maximum(before, 0)], 0)
        if back < HELD:
            lo |= symbol << (BITS * back)
        else:
            hi |= symbol << (BITS * (back - HELD))
        if fits:
            number += np.where(inside, short[np.maximum(before, 0)], 0) * size**back
    if not fits:
        order_of = np.lexsort((lo, hi))
        new = np.ones(len(lo), bool)
        new[1:] = (lo[order_of[1:]] != lo[order_of[:-1]]) | (hi[order_of[1:]] != hi[order_of[:-1]])
        number[order_of] = np.cumsum(new)
    return hi, lo, word, number


def suffix(hi, lo, k: int):
    """The last ``k`` symbols of n-grams."""
    if k <= HELD:
        return hi * 0, lo & ((1 << (BITS * k)) - 1)
    return hi & ((1 << (BITS * (k - HELD))) - 1), lo


def context(hi, lo):
    """All symbols but the predicted one."""
    return hi >> BITS, (lo >> BITS) | ((hi & ((1 << BITS) - 1)) << (BITS * (HELD - 1)))


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(cls, hi, lo, n) summed over all rows of (cls, text).

    A task keeps the tokens between white space with their counts, up to
    ``HELD_CHARS`` characters of them, and turns these into n-grams,
    ``FRAME_CHARS`` characters at a time.
    """

    def frames(cls, counted: Counter) -> Iterator[pd.DataFrame]:
        tokens, times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
        for part in chunks(tokens, FRAME_CHARS):
            yield frame(cls, tokens[part], times[part])

    def frame(cls, tokens: list[str], times: np.ndarray) -> pd.DataFrame:
        words, _, sizes = words_in(tokens)
        times = np.repeat(times, sizes)
        hi, lo, word, number = grams(words, order)
        kept, first, inverse = np.unique(number, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, times[word], len(kept)).astype(np.int64)
        return pd.DataFrame({"cls": np.full(len(kept), cls, object), "hi": hi[first], "lo": lo[first], "n": counts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        chars = 0
        for batch in batches:
            for cls, own in batch.groupby("cls", sort=False):
                texts = clean(own["text"])
                for part in chunks(texts):
                    tokens = held.setdefault(cls, Counter())
                    before = len(tokens)
                    for text in texts[part]:
                        tokens.update(text.split())
                    chars += sum(map(len, islice(reversed(tokens), len(tokens) - before)))
                    if chars > HELD_CHARS:
                        for name in list(held):
                            yield from frames(name, held.pop(name))
                        chars = 0
        for cls, tokens in held.items():
            yield from frames(cls, tokens)

    small_batches(rows.sparkSession)
    partial = rows.select("cls", "text").mapInPandas(run, "cls string, hi bigint, lo bigint, n bigint")
    return partial.groupBy("cls", "hi", "lo").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Counts of the highest order: names of classes, and per row its class, n-gram and count."""

    classes: list[str]
    cls: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray

    def of(self, names: list[str]) -> Counts:
        """Only the classes named."""
        own = {self.classes.index(name) for name in names}
        rows = np.isin(self.cls, list(own))
        return Counts(self.classes, self.cls[rows], self.hi[rows], self.lo[rows], self.n[rows])

    def renamed(self, name, also: list[str] = []) -> Counts:
        """Classes of one new name are put together; ``name`` maps old names to new ones.

        ``also`` names classes that are there even without a count.
        """
        new = sorted({*also, *map(name, self.classes)})
        place = np.array([new.index(name(c)) for c in self.classes], np.int64)
        cls = place[self.cls] if len(self.cls) else self.cls
        return Counts(new, *summed(cls, self.hi, self.lo, self.n))


def gathered(rows: DataFrame, order: int, limit: int | None = None) -> Counts:
    """The counts of all rows of (cls, doc_id, text).

    With a ``limit`` the rows of the classes that have more than their share of it are
    halved, by a hash of the id, until there are no more counts than that.
    """
    draw = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    shares: dict[str, float] = {}
    while True:
        kept = F.coalesce(*[F.when(F.col("cls") == c, draw <= share) for c, share in shares.items()], F.lit(True))
        counted = stage_table(count_grams(rows.where(kept) if shares else rows, order), "grams")
        if limit is None:
            break
        sizes = {r["cls"]: r["count"] for r in counted.groupBy("cls").count().collect()}
        if sum(sizes.values()) <= limit:
            break
        # classes with more than an even share give rows up, small ones none
        for c, size in sizes.items():
            if size > limit / len(sizes):
                shares[c] = shares.get(c, 1.0) / 2
    found = counted.toArrow()
    names = found["cls"].combine_chunks().dictionary_encode()
    values = [found[c].to_numpy().astype(np.int64) for c in ("hi", "lo", "n")]
    return Counts(names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), *values)


def summed(cls: np.ndarray, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, kinds: bool = False):
    """Rows of one class and n-gram as one; with ``kinds`` also how many there were."""
    order = np.lexsort((cls, lo, hi))
    cls, hi, lo, n = cls[order], hi[order], lo[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    out = cls[first], hi[first], lo[first], total
    return (*out, np.diff(np.append(first, len(n)))) if kinds else out


class Table:
    """Values of n-grams by class, found by a hash of the n-gram."""

    def __init__(self, cls: np.ndarray, hi: np.ndarray, lo: np.ndarray, *values: np.ndarray):
        new = np.ones(len(lo), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        first = np.flatnonzero(new)
        self.seed, hashes = 0, self._hashed(hi[first], lo[first], 0)
        while len(np.unique(hashes)) < len(hashes):
            self.seed += 1
            hashes = self._hashed(hi[first], lo[first], self.seed)
        order = np.argsort(hashes)
        self.hashes, self.hi, self.lo = hashes[order], hi[first][order], lo[first][order]
        self.begin, self.size = first[order], np.diff(np.append(first, len(lo)))[order]
        self.cls, self.values = cls.astype(np.int32), [v.astype(np.float32) for v in values]

    @staticmethod
    def _hashed(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
        h = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(29)) ^ lo.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Place of each n-gram, or -1."""
        if not len(self.hashes):
            return np.full(len(lo), -1)
        wanted = self._hashed(hi, lo, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where((self.hi[at] == hi) & (self.lo[at] == lo), at, -1)

    def read(self, at: np.ndarray, classes: int) -> list[np.ndarray]:
        """For each value a row per place (zeros for -1) and a column per class."""
        out = [np.zeros((len(at), classes)) for _ in self.values]
        known = np.flatnonzero(at >= 0)
        size = self.size[at[known]]
        row = np.repeat(known, size)
        place = np.repeat(self.begin[at[known]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for filled, values in zip(out, self.values):
            filled[row, self.cls[place]] = values[place]
        return out


class Numbers(dict):
    """Numbers of tokens from 0 on, in the order in which they are first asked for."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        return number


@dataclass
class KneserNey:
    """One model per class: for each order the counts of n-grams and of their contexts.

    ``shared_to``: orders up to this one use the counts of all classes together.
    """

    classes: list[str]
    order: int
    shared_to: int
    symbols: int
    counts: dict[int, Table]
    contexts: dict[int, Table]
    # what a process keeps of tokens is this part of CACHED_CELLS
    share: int = 1
    # tokens seen before by this process: number of each, how often it came lately, and its
    # words from first[number] to first[number + 1] in rows (scores) and symbols_of
    seen: Numbers = field(default_factory=Numbers)
    seen_chars: int = 0
    uses: np.ndarray | None = None
    first: np.ndarray | None = None
    rows: np.ndarray | None = None
    symbols_of: np.ndarray | None = None
    # sums over the words of each token: a row a class, a column a token
    token_scores: np.ndarray | None = None
    token_symbols: np.ndarray | None = None

    def _probabilities(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        c = len(self.classes)
        p = np.full((len(lo), c), 1.0 / max(self.symbols, 1))
        for k in range(1, self.order + 1):
            own = suffix(hi, lo, k)
            at = self.contexts[k].find(*context(*own))
            known = np.flatnonzero(at >= 0)
            if not len(known):
                continue
            columns = 1 if k <= self.shared_to else c
            total, kinds = self.contexts[k].read(at[known], columns)
            (n,) = self.counts[k].read(self.counts[k].find(own[0][known], own[1][known]), columns)
            mixed = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * p[known]) / np.maximum(total, 1)
            p[known] = np.where(total > 0, mixed, p[known])
        return p

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of each running token; what a token gives is kept."""
        if self.first is None:
            self.uses, self.first, self.symbols_of = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
            self.rows = np.zeros((0, len(self.classes)))
            self.token_scores, self.token_symbols = np.zeros((len(self.classes), 0)), np.zeros(0, np.int64)
        if self.seen_chars * len(self.classes) * self.share > CACHED_CELLS:
            self._forget()
        split = [t.split() for t in texts]
        before, sizes = len(self.seen), np.fromiter(map(len, split), np.int64, len(texts))
        number = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        if len(self.seen) > before:
            self._keep(list(islice(self.seen, before, None)))
        self.uses = np.append(self.uses, np.zeros(len(self.seen) - before, np.int64)) + np.bincount(number, minlength=len(self.seen))
        return np.repeat(np.arange(len(texts)), sizes), number

    def _forget(self) -> None:
        """Keep the tokens that came most often lately, up to half of the room."""
        tokens = list(self.seen)
        chars = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(-self.uses, kind="stable")
        kept = np.sort(order[np.cumsum(chars[order]) * len(self.classes) * self.share <= CACHED_CELLS // 2])
        begin, words = self.first[kept], np.diff(self.first)[kept]
        first = np.append(0, np.cumsum(words))
        at = np.repeat(begin - first[:-1], words) + np.arange(first[-1])
        self.rows, self.symbols_of, self.first = self.rows[at], self.symbols_of[at], first
        done = kept[kept < self.token_scores.shape[1]]  # sums may be behind: they are made when asked for
        self.token_scores, self.token_symbols = self.token_scores[:, done], self.token_symbols[done]
        self.seen = Numbers((tokens[i], n) for n, i in enumerate(kept.tolist()))
        self.seen_chars, self.uses = int(chars[kept].sum()), self.uses[kept] // 2

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, log-likelihood under each class, symbols) of each running word.

        Runs of letters have no white space inside, so a text's words are those of
        its tokens between white space.
        """
        text, number = self._tokens(texts)
        begin = self.first[number]
        words = self.first[number + 1] - begin
        before = np.cumsum(words) - words
        at = np.repeat(begin - before, words) + np.arange(words.sum())
        return np.repeat(text, words), self.rows[at], self.symbols_of[at]

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood under each class, symbols) of each text, a row a text."""
        text, number = self._tokens(texts)
        done = self.token_scores.shape[1]
        if done < len(self.first) - 1:
            sizes = np.diff(self.first[done:])
            token, rows = np.repeat(np.arange(len(sizes)), sizes), slice(self.first[done], None)
            sums = [np.bincount(token, self.rows[rows, c], len(sizes)) for c in range(len(self.classes))]
            symbols = np.bincount(token, self.symbols_of[rows], len(sizes)).astype(np.int64)
            self.token_scores = np.concatenate([self.token_scores, np.stack(sums)], axis=1)
            self.token_symbols = np.concatenate([self.token_symbols, symbols])
        totals = np.zeros((len(texts), len(self.classes)))
        for c, scores in enumerate(self.token_scores):
            totals[:, c] = np.bincount(text, scores[number], len(texts))
        return totals, np.bincount(text, self.token_symbols[number], len(texts)).astype(np.int64)

    def _keep(self, tokens: list[str]) -> None:
        words, lengths, sizes = words_in(tokens)
        self.seen_chars += sum(map(len, tokens))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        different = Numbers()
        own = np.fromiter(map(different.__getitem__, words), np.int64, len(words))
        self.rows = np.concatenate([self.rows, self._scored(list(different))[own]])
        self.symbols_of = np.concatenate([self.symbols_of, lengths + 1])

    def _scored(self, words: list[str]) -> np.ndarray:
        scores = np.zeros((len(words), len(self.classes)))
        for part in chunks(words, max(1, SCORED_CELLS // len(self.classes))):
            hi, lo, word, number = grams(words[part], self.order)
            _, first, number = np.unique(number, return_index=True, return_inverse=True)
            logs = np.log(np.maximum(self._probabilities(hi[first], lo[first]), 1e-12))[number]
            own = scores[part]
            for c in range(len(self.classes)):
                own[:, c] = np.bincount(word, logs[:, c], len(own))
        return scores


def fit(counts: Counts, order: int, shared_to: int = 0) -> KneserNey:
    """A model from the counts of the highest order.

    Below it a count is the number of different symbols seen before the n-gram;
    n-grams at the start of a word keep their own count.
    """

    def levels(cls, hi, lo, n, wanted) -> None:
        for k in range(order, 0, -1):
            if k < order:
                short = suffix(hi, lo, k)
                at_start = (short[0] == hi) & (short[1] == lo)
                cls, hi, lo, n = summed(cls, *short, np.where(at_start, n, 1))
            if k in wanted:
                tables[k] = Table(cls, hi, lo, n)
                contexts[k] = Table(*summed(cls, *context(hi, lo), n, kinds=True))

    tables, contexts = {}, {}
    own = summed(counts.cls, counts.hi, counts.lo, counts.n)
    levels(*own, range(shared_to + 1, order + 1))
    if shared_to:
        levels(*summed(own[0] * 0, *own[1:]), range(1, shared_to + 1))
    return KneserNey(counts.classes, order, shared_to, len(tables[1]), tables, contexts)


def fit_apart(counts: Counts, order: int) -> dict[str, KneserNey]:
    """For each class the model that gives what ``fit`` gives for it, by itself.

    A text of a known class is scored at a share of the cost of all classes; together
    the models keep as many characters of tokens as one of all classes.
    """
    symbols = len(np.unique(suffix(counts.hi, counts.lo, 1)[1]))
    models = {}
    for name in counts.classes:
        own = counts.of([name])
        alone = Counts([name], own.cls * 0, own.hi, own.lo, own.n)
        if len(alone.n):
            models[name] = fit(alone, order)
            models[name].symbols, models[name].share = symbols, len(counts.classes) ** 2
    return models
