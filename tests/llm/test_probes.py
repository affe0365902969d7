"""Faults found by probing earlier versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundspan.llm import edit_counts, license_scan, one_bit_search, pieces, toxicity
from groundspan.llm.tables import table


@pytest.mark.parametrize("between", ["", "and some words that stand between the two of them "])
def test_nearby_notices_are_all_found(between):
    _, found = license_scan.scan("gnu generel publik license " + between + "gnu generall public license")
    words = 4 + len(between.split())
    assert [(p[2], p[3]) for p in found if p[0] == "gpl"] == [(0, 4), (words, 4)]


def test_planted_notices_are_all_found():
    """Notices with up to the allowed edits, close together or far, in any order."""
    rng = random.Random(6)
    notices = [n for n in license_scan.NOTICES if n.edits and len(n.phrase) > 10]
    for _ in range(150):
        words, planted = [], []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(["qx", "zzv", "wq"]) for _ in range(rng.randrange(3))]
            notice = rng.choice(notices)
            text = list(notice.phrase)
            for place in rng.sample([i for i, c in enumerate(text) if c != " "], rng.randrange(notice.edits + 1)):
                text[place] = rng.choice("qx")
            planted.append((notice.label, len(words)))
            words += "".join(text).split()
        _, found = license_scan.scan(" ".join(words))
        assert set(planted) <= {(p[0], p[2]) for p in found}
        for label in {p[0] for p in found}:
            ends = sorted((p[2], p[2] + p[3]) for p in found if p[0] == label and p[4])
            assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_search_reads_doubles(spark):
    rows = [(1, [1 + 1e-9, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.5]), (3, [1e39, 1.0]), (4, [-1e300, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = one_bit_search.search_query(vectors).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [3, 1, 2, 4]
    assert [r["score"] for r in found] == [1e39 + 0.5, 1 + 1e-9, 1.0, -1e300 + 0.5]


def test_search_of_larger_tables(spark):
    """Recall over many blocks; the figure is in the README."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24))
    data = centres[rng.integers(0, 60, 20_000)] + 0.4 * rng.standard_normal((20_000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = one_bit_search.search(frame, F.col("vec_id") % 400 == 0).collect()
    own = {}
    for r in found:
        own.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in own.items():
        score = data @ data[q]
        score[q] = -math.inf
        hits += len(got & set(np.argsort(-score)[:20].tolist()))
    assert len(own) == 50 and hits >= 0.97 * 1000


CLASHES = ["_id", "_key", "_gone", "_n", "decontaminated", "_pieces", "_verdict", "_score", "_scan", "_count", "row", "key", "id"]


def test_columns_of_any_name_stay(spark, sf):
    docs = table(spark, sf, "documents").limit(40).withColumns({c: F.lit(c) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf)
        assert kept.columns[: len(docs.columns)] == docs.columns, name
        for r in kept.limit(3).collect():
            assert all(r[c] == c for c in CLASHES), name
    for found in (license_scan.license_places(docs), pieces.encode_texts(docs), edit_counts.count_edited(edit_counts.revisions(docs))):
        assert found.where(" or ".join(f"{c} <> '{c}'" for c in CLASHES)).count() == 0 and set(CLASHES) <= set(found.columns)


def test_stages_on_odd_rows(spark, sf):
    """Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table."""
    docs = table(spark, sf, "documents")
    odd = [(None, None, None, None, None), (1, None, "en", None, 1), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, "the " * 40_000, "en", "s", None), (4, "x" * 200_000, None, "s", 3)]
    rows = docs.limit(60).unionByName(spark.createDataFrame(odd, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, rows, sf)
        assert kept.count() <= rows.count(), name
        none = stage(spark, rows.limit(0), sf)
        assert none.columns == kept.columns and none.count() == 0, name


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    for query in (license_scan.license_query, pieces.pieces_query, edit_counts.edit_count_query):
        assert query(docs).count() == 0
    assert toxicity.toxicity_query(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


@pytest.mark.parametrize("place", ["front", "middle", "end", "moving"])
def test_edits_read_little_after_many(place):
    """Thousands of insertions at one place: leaves stay small, counts stay right."""
    counter = edit_counts.counter(edit_counts.RANKS)
    tree = edit_counts.TokenTree("some words of a text that is edited " * 40, counter)
    rng = random.Random(1)
    for i in range(4000):
        size = tree.chars[1]
        at = {"front": 0, "middle": size // 2, "end": size, "moving": rng.randrange(size + 1)}[place]
        tree.edit(at, rng.choice([0, 0, 0, 3]), rng.choice([" a", "bc ", " 12", "\n", "x"]))
        assert max(map(len, tree.leaves)) <= 2 * edit_counts.LEAF
    assert tree.recut < 4000 * 200
    again = edit_counts.TokenTree(tree.text(), counter)
    assert tree.tokens[1] == again.tokens[1] and sum(tree.leaves, []) == sum(again.leaves, [])


def test_unigram_paths_equal_all_segmentations():
    """The shared forward scores against every way to cut a word."""
    rng = random.Random(9)

    def cuts(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            for rest in cuts(word[n:]):
                yield [word[:n], *rest]

    for _ in range(20):
        scores = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): -rng.randrange(1, 40) / 4 for _ in range(15)}
        unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY
        cost = lambda piece: scores.get(piece, unknown if len(piece) == 1 else None)
        words = ["".join(rng.choices("abcd", k=rng.randrange(0, 9))) for _ in range(25)]
        found = pieces.best_paths(words, scores)
        assert found.keys() == set(words)
        for word, (total, path) in found.items():
            sums = [sum(map(cost, c)) for c in cuts(word) if all(cost(p) is not None for p in c)]
            assert "".join(path) == word and total == sum(map(cost, path)) == max(sums)
    assert pieces.best_paths([], {}) == {} and pieces.best_paths(["", "ab"], {}) == {"": (0.0, []), "ab": (-20.0, ["a", "b"])}


def test_words_of_two_generations_equal_fresh_ones(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice(["ing", "tion", "é"]) for _ in range(30)) for _ in range(40)]
    whole = pieces.PieceModel(pieces.MODEL).encode(texts)
    monkeypatch.setattr(pieces, "CACHED_WORDS", 60)
    small = pieces.PieceModel(pieces.MODEL)
    assert [small.encode([t])[0] for t in texts] == whole
    assert small.older and len(small.words) <= 60
