"""Bucketed random projections against the exact search, and the two model hooks of a search."""

import numpy as np
import pytest

from groundspan.operators import dense
from groundspan.operators.dense import dense_topk, hashing_embedder
from groundspan.operators.dense_approx import approx_topk, recall
from groundspan.plans.index import build_index
from groundspan.plans.search import hybrid_search
from groundspan.settings import Settings

ASKED = "query_id string, vector array<float>, scope string"
HELD = "chunk_id string, episode_id string, vector array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Passages around 40 centres, a third of them at one place; questions near the centres."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    held = centres[rng.integers(0, 40, 900)] + rng.normal(scale=0.4, size=(900, 16))
    held[::3] = held[0]
    asked = centres + rng.normal(scale=0.3, size=(40, 16))
    unit = [(m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32) for m in (asked, held)]
    queries = spark.createDataFrame([(f"q{i}", v.tolist(), f"e{i % 4}" if i % 3 == 0 else None) for i, v in enumerate(unit[0])], ASKED)
    passages = spark.createDataFrame([(f"c{i:03d}", f"e{i % 4}", v.tolist()) for i, v in enumerate(unit[1])], HELD)
    return queries.cache(), passages.cache()


def rows(found):
    return sorted((r["query_id"], r["dense_rank"], r["chunk_id"], r["dense_score"]) for r in found.collect())


def test_one_bucket_for_all_is_the_exact_search(spark, monkeypatch, vectors):
    # blocks far smaller than the bucket on both sides
    want = rows(dense_topk(*vectors, 7))
    monkeypatch.setattr(dense, "PASSAGE_BLOCK", 100)
    monkeypatch.setattr(dense, "QUERY_SLICE", 9)
    # a projection only tells below zero from above, so some of 24 tables bring any near two together
    assert rows(approx_topk(*vectors, 7, tables=24, width=1, bucket=1e6)) == want


def test_recall_and_scores(spark, vectors):
    exact = dense_topk(*vectors, 7)
    found = approx_topk(*vectors, 7)
    shares = [r["recall"] for r in recall(found, exact).collect()]
    assert len(shares) == 40 and np.mean(shares) >= 0.9
    plain = {(q, c): s for q, _, c, s in rows(dense_topk(*vectors, 900))}
    got = rows(found)
    assert all(abs(plain[q, c] - s) < 1e-9 for q, _, c, s in got)
    assert len({(q, c) for q, _, c, _ in got}) == len(got)


def test_a_wider_key_has_fewer_candidates(spark, vectors):
    few = rows(approx_topk(*vectors, 900, tables=1, width=6, bucket=0.3))
    more = rows(approx_topk(*vectors, 900, tables=6, width=1, bucket=0.3))
    # an equal key of all six projections is an equal key of each
    assert {(q, c) for q, _, c, _ in few} < {(q, c) for q, _, c, _ in more}


def test_odd_rows(spark, vectors):
    queries, passages = vectors
    none = spark.createDataFrame([("q", None, None)], ASKED)
    zero = spark.createDataFrame([("z", [0.0] * 16, None)], ASKED)
    assert rows(approx_topk(none, passages, 3)) == []
    assert rows(approx_topk(queries, passages.limit(0), 3)) == []
    assert rows(approx_topk(queries.limit(0), passages, 3)) == []
    assert all(s == 0 for *_, s in rows(approx_topk(zero, passages, 3)))
    gap = passages.unionByName(spark.createDataFrame([("cx", "e0", None)], HELD))
    assert rows(approx_topk(queries, gap, 3)) == rows(approx_topk(queries, passages, 3))


@pytest.fixture(scope="module")
def transcripts(spark):
    said = {"a": "solar panels feed the grid", "b": "bread needs flour and water", "c": "the grid needs storage"}
    row = "episode_id string, episode_title string, source_file string, segments array<struct<id: int, start: double, end: double, text: string>>"
    return spark.createDataFrame([(e, e.upper(), f"{e}.wav", [(0, 0.0, 9.0, t)]) for e, t in said.items()], row)


def test_question_and_passage_models_apart(spark, transcripts):
    """The index is built with one embedder, questions are embedded by another."""
    plain = hashing_embedder(64)
    index = build_index(transcripts, Settings(), embedder=lambda texts: plain(list(texts)))
    asked = spark.createDataFrame([("q", "tell me", "default", None)], "query_id string, query string, mode string, scope string")
    for search in ("exact", "buckets"):
        settings = Settings(retrieval_mode="dense", enable_rerank=False, dense_search=search, top_k=1)
        hits = hybrid_search(asked, index, settings, embedder=lambda texts: plain(["bread flour water" for _ in texts])).hits.collect()
        assert [h["episode_id"] for h in hits] == ["b"]


def test_user_scorer_orders_and_gates(spark, transcripts):
    """A scorer of the caller's orders the pool, and sets the gate from the probes."""

    def score(topics, texts):
        return [0.9 if "storage" in t and "grid" in q else 0.2 for q, t in zip(topics, texts)]

    index = build_index(transcripts, Settings(), scorer=score)
    assert index.gate == pytest.approx(0.3)
    asked = spark.createDataFrame(
        [("in", "what does the grid need", "default", None), ("out", "who won the cup", "default", None)],
        "query_id string, query string, mode string, scope string",
    )
    found = hybrid_search(asked, index, scorer=score)
    first = {h["query_id"]: h for h in found.hits.where("rank = 1").collect()}
    assert first["in"]["episode_id"] == "c" and first["in"]["rerank_score"] == pytest.approx(0.9)
    assert {r["query_id"]: r["not_covered"] for r in found.diagnostics.collect()} == {"in": False, "out": True}
