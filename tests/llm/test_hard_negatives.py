"""Hard negatives against all pairs of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspan.llm import hard_negatives
from groundspan.llm.tables import table


def plain(rows):
    """rows: (vec_id, vector, label) of the contract."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ([math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
        kept[i] = max(kept.get(i, own), own)
    sizes = [len(v) for v, _ in kept.values()]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    kept = {i: r for i, r in kept.items() if len(r[0]) == dim}
    out = []
    for a in sorted(kept):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(kept[a][0], v)), i) for i, (v, _) in kept.items() if i != a)
        for p, pos in [(-s, i) for s, i in scored if kept[i][1] == kept[a][1]][:5]:
            fits = [(-s, i) for s, i in scored if kept[i][1] != kept[a][1] and 80 * p <= -100 * s <= 100 * p]
            out += [(a, pos, rank, i, p, s) for rank, (s, i) in enumerate(fits[:5], 1)]
    return out


@pytest.mark.parametrize("block, slices, at_once", [(8192, 512, 512), (150, 2, 8)])
def test_query_equals_all_pairs(spark, sf, monkeypatch, block, slices, at_once):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLICE", slices)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", at_once)
    vectors = table(spark, sf, "embeddings")
    first = vectors.orderBy("vec_id").first()
    odd = [
        (None, first["embedding"], 1), (100, None, 1), (100, [], 1), (900_100, [float("nan")] * 64, 1), (900_200, [float("inf")] + [0.0] * 63, 1),
        (900_300, [None] + [1.0] * 63, 2), (900_400, [0.0] * 64, 3), (900_500, [1.0, 2.0], 3), (900_600, first["embedding"], None),
        (900_700, first["embedding"], 0), (900_701, first["embedding"], 0), (900_702, first["embedding"], 1), (900_703, first["embedding"], 1),
        (900_703, first["embedding"], 1), (0, [0.1] * 64, 5), (-100, [-0.2] * 64, 4),
    ]
    rows = vectors.withColumn("anchor_id", F.lit("clash")).unionByName(
        spark.createDataFrame(odd, vectors.schema).withColumn("anchor_id", F.lit("clash"))
    )
    found = hard_negatives.negatives_query(rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain([(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()])
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50
    assert len({r[0] for r in want}) > 3


def test_few_rows_and_none(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.negatives_query(spark.createDataFrame([], shape)).count() == 0
    assert hard_negatives.negatives_query(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], shape)).count() == 0
    rows = [(100, [1.0], 1), (101, [0.9], 1), (102, [0.8], 2), (103, [0.1], 2), (104, [0.9], 3)]
    assert sorted(map(tuple, hard_negatives.negatives_query(spark.createDataFrame(rows, shape)).collect())) == plain(rows)


def test_search_ends_when_certified():
    """Clusters far apart: few rows are scored, and the lists are still whole."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-250, 250, (40, 8))
    numbers = (centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.int32)
    labels = rng.integers(0, 4, 4000)
    books = hard_negatives.codebook(numbers[:, :4].astype(float)), hard_negatives.codebook(numbers[:, 4:].astype(float))
    cells = hard_negatives.Cells(np.arange(4000), labels, numbers, books)
    for a in range(0, 4000, 500):
        query = numbers[a].astype(np.int64)
        seen = {}
        bounds = []
        for bound, places in cells.walk(query):
            bounds.append(bound)
            scores = hard_negatives.products(cells.numbers[places], query)
            assert (scores <= bound).all() and not seen.keys() & set(places.tolist())
            seen |= dict(zip(places.tolist(), scores.tolist()))
        assert len(seen) == 4000 and bounds == sorted(bounds, reverse=True)
        scored = 0
        walk = cells.walk

        def counted(query):
            nonlocal scored
            for bound, places in walk(query):
                yield bound, places
                scored += len(places)

        cells.walk = counted
        ids, scores = cells.positives(a, int(labels[a]), query, 5)
        cells.walk = walk
        every = sorted((-int(numbers[i].astype(int) @ query), i) for i in range(4000) if labels[i] == labels[a] and i != a)
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == every[:5] and scored < 2500


def test_large_numbers_stay_exact():
    rows, query = np.array([[2**27, 2**27 - 1]], np.int64), np.array([2**27, 1], np.int64)
    assert hard_negatives.products(rows, query)[0] == 2**54 + 2**27 - 1


def test_no_copies_of_the_anchors_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(6)], i % 3) for i in range(400)], "vec_id bigint, embedding array<float>, label int")
    found = hard_negatives.negatives_query(rows)
    assert found.collect() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
