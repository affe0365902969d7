"""Periodic runs of words: stretches that repeat themselves four times or more.

A run is a stretch of consecutive words with smallest period ``q`` and a length
of at least ``max(6, 4 * q)`` that no neighbouring word extends keeping period
``q``. Runs are found by seeds on diagonals: on the diagonal of lag ``q`` (word
``i`` against word ``i + q``) a run is an unbroken stretch of equal words.

* Lags are taken in classes ``[Q, 2Q)``, ``Q`` a power of two. A run whose period
  is in the class overlaps itself by at least 5 words (``Q = 1``) or ``3Q`` words,
  so k-grams of that guaranteed overlap are indexed. K-grams are numbered exactly,
  by doubling: an 8-gram is a pair of numbered 4-grams. A k-gram that occurs once
  in its text is dropped for all longer ones too, so little is left of plain text.
* Seeds are pairs of occurrences of a k-gram in one text with a lag of the class.
  Only next occurrences are needed: as ``k >= q``, an occurrence between two that
  are ``q`` apart inside a run would give the run a smaller period. So there are at
  most as many seeds as words in a class, for any text.
* A table of the furthest word covered per lag skips the seeds that an earlier
  extension has passed; the others are extended both ways on their diagonal.

Each text is worked on in its row; there is no shuffle. Texts are handled together
up to a bounded number of characters, a longer text alone.

Cases: words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. A null text, or one
without words, has no runs and an empty collapsed text. Repeated rows are judged
alike; an empty table gives an empty one. The result replaces columns of its names
(``runs``, ``collapsed``).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundspan.functions.text import let
from groundspan.llm.tables import chunks, clean, small_batches

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RESULT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _numbered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each pair, how often it occurs)."""
    _, number, times = np.unique(first * (second.max() + 1) + second, return_inverse=True, return_counts=True)
    return number, times[number]


def _doubled(number: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the k-grams of twice the size; -1 for those that occur once."""
    out = np.full(len(number), -1, np.int64)
    at = np.flatnonzero((number[:-size] >= 0) & (number[size:] >= 0)) if size < len(number) else []
    if len(at):
        own, times = _numbered(number[at], number[at + size])
        out[at[times > 1]] = own[times > 1]
    return out


def seeds(number: np.ndarray, shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of next occurrences of a k-gram with ``least <= lag < 2 * least``.

    The k-gram at i is the pair of the numbered grams at i and ``i + shift``.
    """
    at = np.flatnonzero((number[:-shift] >= 0) & (number[shift:] >= 0)) if shift < len(number) else np.empty(0, int)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = number[at] * (number.max() + 1) + number[at + shift]
    order = np.argsort(key, kind="stable")
    here, there = at[order[:-1]], at[order[1:]]
    lag = there - here
    fits = (key[order[:-1]] == key[order[1:]]) & (lag >= least) & (lag < 2 * least)
    return here[fits], lag[fits]


def _agreeing(symbols: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words in a row, from ``at`` on in direction ``step``, equal those ``lag`` further."""
    most = len(symbols) - lag - at if step > 0 else at + 1
    done, block = 0, 32
    while done < most:
        size = min(block, most - done)
        begin = at + done if step > 0 else at - done - size + 1
        same = symbols[begin : begin + size] == symbols[begin + lag : begin + lag + size]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, block = done + size, block * 4
    return done


def _extended(symbols: np.ndarray, here: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    furthest: dict[int, int] = {}
    found = []
    order = np.lexsort((here, lags))
    here, lags = here[order], lags[order]
    # of seeds in a row on one diagonal the first is enough
    fresh = np.ones(len(here), bool)
    fresh[1:] = (lags[1:] != lags[:-1]) | (here[1:] != here[:-1] + 1)
    for at, lag in zip(here[fresh].tolist(), lags[fresh].tolist()):
        if at < furthest.get(lag, 0):
            continue
        start = at - _agreeing(symbols, at - 1, lag, -1)
        end = at + _agreeing(symbols, at, lag, 1)
        furthest[lag] = end
        if end - start + lag >= max(LEAST_LENGTH, LEAST_EXPONENT * lag):
            found.append((start, end - start + lag, lag))
    return found


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of words, by start and period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.empty(int(sizes.sum()), np.int64)
    begins = np.cumsum(sizes) - sizes
    used = 0
    for words, begin in zip(texts, begins.tolist()):
        own = dict.fromkeys(words)
        own = dict(zip(own, range(used, used + len(own))))
        used += len(own)
        # no word is shared between texts, so no k-gram occurs in two of them
        symbols[begin : begin + len(words)] = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
    found: list[tuple[int, int, int]] = []
    longest = int(sizes.max(initial=0))
    number, size, least = symbols, 1, 1
    if len(symbols):
        number = np.where(np.bincount(symbols, minlength=1)[symbols] > 1, symbols, -1)
    while max(LEAST_LENGTH, LEAST_EXPONENT * least) <= longest and (number >= 0).any():
        while size < max(4, 2 * least):
            number, size = _doubled(number, size), 2 * size
        # k is 5 for lag 1, then three times the least lag of the class
        found += _extended(symbols, *seeds(number, 1 if least == 1 else 3 * least - size, least))
        least *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    full = np.flatnonzero(sizes)
    for start, length, period in sorted(found, key=lambda r: (r[0], r[2])):
        text = int(full[np.searchsorted(begins[full], start, "right") - 1])
        out[text].append((start - int(begins[text]), length, period))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = clean(batch)
        runs_out, kept_out = [], []
        for part in chunks(texts):
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts[part]]
            for words, runs in zip(split, runs_of(split)):
                runs_out.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept_out.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"runs": pd.Series(runs_out, dtype=object), "collapsed": pd.Series(kept_out, dtype=object)})


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words) and ``collapsed`` (the words kept, one space apart)."""
    small_batches(docs.sparkSession)
    names = ["runs", "collapsed"]
    # struct and its parts keep the caller's column names free
    found = F.pandas_udf(_found, RESULT)(F.col(text))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    held = docs.select(F.struct(*others).alias("row"), found.alias("found"))
    return held.select("row.*", *[f"found.{n}" for n in names])


def planted_text(text: Column, doc_id: Column) -> Column:
    """The text of the query: in a tenth of the documents a part is made periodic, by the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        long = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, place(i).cast("int")))
        return F.when(n > 0, F.array_join(long, " ")).otherwise("")

    return F.when(h % 10 == 0, let(words, periodic)).otherwise(text)


def runs_query(docs: DataFrame) -> DataFrame:
    """Per document the digests of its runs and of its collapsed text."""
    rows = docs.select("doc_id", planted_text(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(rows)
    runs = F.col("runs")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))

    def better(best: Column, r: Column) -> Column:
        """By exact length / period; runs come by start and period, so ties keep the first."""
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return found.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        F.aggregate(runs, none, better).alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
