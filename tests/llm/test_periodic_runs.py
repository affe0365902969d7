"""Periodic runs against every stretch of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from groundspan.llm import periodic_runs
from groundspan.llm.tables import table


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[:-p] == own[p:] for p in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_equal_every_stretch(letters):
    rng = random.Random(letters)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            for _ in range(rng.randrange(6)):
                unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21]))]
                words += (unit * rng.randrange(1, 8))[: rng.randrange(1, 90)]
            texts.append(words)
        assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]


def test_long_texts_of_few_words():
    rng = random.Random(0)
    assert periodic_runs.runs_of([["a"] * 200_000, [], ["b"] * 5]) == [[(0, 200_000, 1)], [], []]
    unit = [rng.randrange(2) for _ in range(20_000)]
    assert (0, 80_000, 20_000) in periodic_runs.runs_of([unit * 4])[0]


def test_query_equals_plain_rows(spark, sf):
    # the plain way takes the square of a text's length
    docs = table(spark, sf, "documents").select("doc_id", "text").where("length(text) < 9000")
    rng = random.Random(4)
    rows = [(i, " \t".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(5_000, 5_400)]
    rows += [(7, None), (8, ""), (9, " \n"), (None, "x x x x x x x"), (10, "é é " * 9), (10, "é é " * 9), (11, "\x00 \x00 " * 7)]
    found = periodic_runs.runs_query(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(*r) for r in [*docs.collect(), *rows]]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a b a b a b a b a b c", "x", "y", 1)], "text string, runs string, found string, row int")
    found = periodic_runs.periodic_runs(docs)
    assert found.columns == ["text", "found", "row", "runs", "collapsed"]
    r = found.first()
    assert [tuple(x) for x in r["runs"]] == [(0, 10, 2)] and r["collapsed"] == "a b c" and r["found"] == "y"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs.runs_query(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
