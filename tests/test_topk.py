"""Searches hold a few rows a question, not one a pair."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspan.operators import lexical
from groundspan.operators.lexical import CorpusFacts, bm25_topk
from groundspan.operators.topk import Best

FACTS = CorpusFacts(300, 6.0, 1.0)
WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    texts = [rng.choice(WORDS, 6, replace=False).tolist() for _ in range(300)]
    texts[7] = texts[201] = texts[8]
    rows = [(f"c{i:03d}", f"e{i % 5}", 4 + i % 4 if i not in (7, 8, 201) else 6, [(w, 1 + j % 3) for j, w in enumerate(t)]) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "chunk_id string, episode_id string, dl int, tf array<struct<term: string, tf: int>>").cache()
    stats = spark.createDataFrame([(w, 1, 0.1 + i / 7) for i, w in enumerate(WORDS)], "term string, df int, idf double").cache()
    asked = [(f"q{i}", " ".join([*rng.choice(WORDS, 4), "nowhere"]), f"e{i % 5}" if i % 3 == 0 else None) for i in range(30)]
    asked += [("q97", "nowhere", None), ("q98", "", None), ("q99", " ".join(texts[8]), None)]
    return spark.createDataFrame(asked, "query_id string, query string, scope string").cache(), held, stats, asked, rows


@pytest.mark.parametrize("slice_of, share", [(4096, 1 / 128), (7, 0.0), (7, 2.0)])
def test_bm25_equals_brute_force(tables, monkeypatch, slice_of, share):
    queries, held, stats, asked, rows = tables
    for name, value in dict(QUERY_SLICE=slice_of, PASSAGE_BLOCK=90, SCORED_ROWS=32, QUESTIONS=4, DENSE_SHARE=share, PAIRS_AT_ONCE=50).items():
        monkeypatch.setattr(lexical, name, value)
    idf = {r["term"]: r["idf"] for r in stats.collect()}
    want = set()
    for q, text, scope in asked:
        scores = {}
        for chunk, episode, dl, tf in rows:
            raw = sum(idf.get(w, 0) * 2.5 * n / (n + 1.5 * (0.25 + 0.75 * dl / 6.0)) for w in text.split() for t, n in tf if t == w)
            if raw > 0 and scope in (None, episode):
                scores[chunk] = round(raw, 4)
        best = sorted(scores, key=lambda c: (-scores[c], c))[:6]
        want |= {(q, c, round(scores[c], 4), n + 1) for n, c in enumerate(best)}
    found = bm25_topk(queries, held, stats, FACTS, 6)
    assert {(r["query_id"], r["chunk_id"], round(r["bm25_score"], 4), r["bm25_rank"]) for r in found.collect()} == want
    assert found.schema["query_id"].dataType.simpleString() == "string"
    # no row per pair of question and passage: nothing is grouped by passage
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in line and "chunk_id" in line for line in plan.splitlines())
    assert bm25_topk(queries, held.limit(0), stats, FACTS, 6).count() == 0
    assert bm25_topk(queries.where(F.lit(False)), held, stats, FACTS, 6).count() == 0


def test_best_holds_a_few_rows_a_question():
    best, rng, every = Best(3000, 5), np.random.default_rng(1), []
    for at in range(40):
        scores = np.round(rng.normal(size=(3000, 60)), 1)
        names = [f"c{at * 60 + i:05d}" for i in range(60)]
        best.add(0, scores, pa.table({"chunk_id": names}))
        every.append(scores)
        assert best.held <= best.bound + 3000 * 5
    scores, found = np.concatenate(every, axis=1), best.rows()
    want = [f"c{c:05d}" for row in scores for c in np.argsort(-row, kind="stable")[:5]]
    assert found.column("chunk_id").to_pylist() == want


def test_passages_are_not_shuffled_for_slices_of_questions(tables, monkeypatch):
    """However many slices of questions there are, what is moved besides them is a few rows a question."""
    queries, held, stats, _, _ = tables
    monkeypatch.setattr(lexical, "QUERY_SLICE", 2)  # five slices
    found = bm25_topk(queries, held, stats, FACTS, 6)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Broadcast" not in plan
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("slice" in line or "query_id" in line for line in moved)
