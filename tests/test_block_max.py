"""Top-k that skips blocks against the exhaustive ranking."""

import pytest
from pyspark.sql import functions as F

from groundspan.operators import block_max
from groundspan.operators.block_max import bm25_topk_blocks, build_blocks
from groundspan.operators.lexical import bm25_topk
from workload import fixtures as fx


@pytest.mark.parametrize("passages, k", [(8, 3), (64, 20)])
def test_equal_to_the_exhaustive_ranking(spark, sf, monkeypatch, passages, k):
    monkeypatch.setattr(block_max, "SLICE", 7)
    ix = fx.search_index(spark, sf)
    blocks = build_blocks(ix.passages, ix.facts, fx.SETTINGS, passages)
    assert blocks.blocks.count() > 5
    for asked in (fx.questions(spark, sf), fx.questions(spark, sf, fx.scopes(spark, sf))):
        found, visited = bm25_topk_blocks(asked, blocks, ix.stats, k, fx.SETTINGS, seed_blocks=2)
        want = bm25_topk(asked, ix.passages, ix.stats, ix.facts, k, fx.SETTINGS)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
        share = visited.agg(F.sum("scored") / F.sum("blocks")).first()[0]
        if k == 3:
            assert share < 0.8
    nothing = asked.withColumn("query", F.lit("zzzz qqqq"))
    assert bm25_topk_blocks(nothing, blocks, ix.stats, k, fx.SETTINGS)[0].count() == 0


def test_nothing_is_broadcast_past_the_bound(spark, sf, monkeypatch):
    from groundspan import staging

    ix = fx.search_index(spark, sf)
    blocks = build_blocks(ix.passages, ix.facts, fx.SETTINGS, 64)
    want = sorted(map(tuple, bm25_topk_blocks(fx.questions(spark, sf), blocks, ix.stats, 5, fx.SETTINGS)[0].collect()))
    monkeypatch.setattr(staging, "fits_broadcast", lambda *a: False)
    assert sorted(map(tuple, bm25_topk_blocks(fx.questions(spark, sf), blocks, ix.stats, 5, fx.SETTINGS)[0].collect())) == want
