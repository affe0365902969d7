"""Dense search: both ways against plain numpy."""

import numpy as np
import pytest

from groundspan.operators import dense
from groundspan.operators.dense import dense_topk, embed_column, hashing_embedder


@pytest.mark.parametrize("query_slice", [100, 7])
def test_dense_topk_equals_brute_force(spark, monkeypatch, query_slice):
    monkeypatch.setattr(dense, "PASSAGE_BLOCK", 60)
    rng = np.random.default_rng(5)
    asked, held = rng.normal(size=(30, 8)).astype(np.float32), rng.normal(size=(200, 8)).astype(np.float32)
    held[3] = held[4]
    scopes = [f"e{i % 5}" if i % 3 == 0 else None for i in range(30)]
    queries = spark.createDataFrame(
        [(f"q{i}", v.tolist(), s) for i, (v, s) in enumerate(zip(asked, scopes))], "query_id string, vector array<float>, scope string"
    )
    passages = spark.createDataFrame(
        [(f"c{i:03d}", f"e{i % 5}", v.tolist()) for i, v in enumerate(held)], "chunk_id string, episode_id string, vector array<float>"
    )
    found = {(r["query_id"], r["dense_rank"]): (r["chunk_id"], r["dense_score"]) for r in dense_topk(queries, passages, 5, query_slice).collect()}
    want = {}
    for i in range(30):
        scores = np.round(asked[i].astype(float) @ held.T.astype(float), dense.SCORE_DP)
        order = sorted((c for c in range(200) if scopes[i] in (None, f"e{c % 5}")), key=lambda c: (-scores[c], c))
        want |= {(f"q{i}", n + 1): (f"c{c:03d}", scores[c]) for n, c in enumerate(order[:5])}
    assert found.keys() == want.keys()
    assert all(found[x][0] == want[x][0] and abs(found[x][1] - want[x][1]) < 1e-9 for x in want)


def test_embedding_keeps_the_row(spark):
    rows = spark.createDataFrame([(1, "two words here"), (2, "")], "id int, text string")
    found = embed_column(rows, hashing_embedder(16)).orderBy("id").collect()
    assert [r["id"] for r in found] == [1, 2]
    assert abs(sum(x * x for x in found[0]["vector"]) - 1) < 1e-6 and not any(found[1]["vector"])
    assert embed_column(rows.limit(0), hashing_embedder(16)).count() == 0
