"""Fuzzy search for short licence notices.

A text becomes its lower-cased words with one space between them. A notice with
``k`` allowed edits is cut into ``k + 1`` seeds: a place with at most ``k`` edits
holds one of them unchanged (pigeonhole). Each seed found marks a window, in
which the regex library's bounded-error matching verifies the edits and gives
the span. Places without edits are the base places.

Cases: a null or empty text has no words and no places; its score is 0. Equal
spans found from several seeds count once; of overlapping spans of one notice
the one with the fewest edits, then the leftmost, counts. Repeated rows are
judged alike. Results replace columns of their names.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import cache
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from groundspan.llm.tables import chunks, clean, small_batches


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int
    base: bool = False


# The base phrases and their labels.
BASE_NOTICES = (
    Notice("gpl", "gnu general public license", 2, True),
    Notice("apache", "apache license", 1, True),
    Notice("cc-by", "cc by", 0, True),
    Notice("mit", "mit license", 1, True),
)
NOTICES = BASE_NOTICES + (
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mit", "permission is hereby granted free of charge to any person", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 4),
    Notice("public-domain", "released into the public domain", 2),
)

# Bytes of words: digits, letters and everything beyond ASCII; A-Z are lowered.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


@cache
def seeds(phrase: str, edits: int) -> tuple[tuple[str, int], ...]:
    """``edits + 1`` pieces of about equal length, with their places in the phrase."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return tuple((phrase[a:b], a) for a, b in zip(cuts, cuts[1:]))


@cache
def _pattern(phrase: str, edits: int):
    return regex.compile(rf"(?b)(?<= )(?:{regex.escape(phrase)}){{e<={edits}}}(?= )")


def word_line(text: str) -> bytes:
    """The words of a text, each after a space, and a last space."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()) + b" "


def places(line: str, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of a notice in a word line.

    All places without an edit; of the others, each the best match around one seed,
    those that overlap no better one (fewer edits, then further left).
    """
    exact, at, size = f" {notice.phrase} ", -1, len(notice.phrase)
    found: list[tuple[int, int, int]] = []
    while (at := line.find(exact, at + 1)) >= 0:
        found.append((at + 1, at + 1 + size, 0))
    if not notice.edits:
        return found
    starts = set()
    for seed, offset in seeds(notice.phrase, notice.edits):
        at = line.find(seed)
        while at >= 0:
            starts.add(at - offset)
            at = line.find(seed, at + 1)
    starts -= {start for start, _, _ in found}
    reach, edited = notice.edits + 1, set()
    for start in starts:
        # a match that holds this seed in its place, and any other match in here, overlap
        m = _pattern(notice.phrase, notice.edits).search(line, max(start - reach, 0), min(start + size + reach, len(line)))
        if m and m.end() > m.start():
            edited.add((sum(m.fuzzy_counts), m.start(), m.end()))
    for edits, start, end in sorted(edited):
        after = bisect.bisect_left(found, (start, 0, 0))
        if (after == 0 or found[after - 1][1] <= start) and (after == len(found) or found[after][0] >= end):
            found.insert(after, (start, end, edits))
    return found


def scan(text: str, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[tuple]]:
    """Number of words, and (label, base, first word, words, edits, score) of each place."""
    raw = word_line(text)
    n_words = raw.count(b" ") - 1 if len(raw) > 2 else 0
    hit = [
        n for n in notices if any(seed.encode() in raw for seed, _ in seeds(n.phrase, n.edits))
    ]
    if not hit or not n_words:
        return n_words, []
    line = raw.decode("utf-8", "surrogatepass")
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    out = []
    for notice in hit:
        for start, end, edits in places(line, notice):
            first = int(np.searchsorted(spaces, start)) - 1
            words = int(np.searchsorted(spaces, end)) - first
            score = 1 - edits / len(notice.phrase)
            out.append((notice.label, notice.base and edits == 0, first, words, edits, score))
    return n_words, out


SPAN = "struct<label: string, base: boolean, first_word: bigint, words: bigint, edits: int>"


def license_places(docs: DataFrame, text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (array of ``SPAN``) and ``license_score``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("label", "base", "first_word", "words", "edits")
        for batch in batches:
            texts = clean(batch)
            counts, found, scores = [], [], []
            for part in chunks(texts):
                for t in texts[part]:
                    n, spans = scan(t, notices)
                    counts.append(n)
                    found.append([dict(zip(names, p)) for p in spans])
                    scores.append(max((p[-1] for p in spans), default=0.0))
            yield pd.DataFrame({"n": pd.Series(counts, dtype="int64"), "p": found, "s": pd.Series(scores, dtype="float64")})

    udf = F.pandas_udf(run, f"n bigint, p array<{SPAN}>, s double")
    small_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {"n_words", "places", "license_score"}]
    held = docs.select(F.struct(*others).alias("row"), udf(F.col(text)).alias("scan"))
    return held.select(
        "row.*", F.col("scan.n").alias("n_words"), F.col("scan.p").alias("places"), F.col("scan.s").alias("license_score")
    )


def license_query(docs: DataFrame) -> DataFrame:
    found = license_places(docs.select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first_word"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.col("license_score").alias("score"),
        F.size("places").cast("bigint").alias("n_places"),
    )
