"""Quantiles, ordered run files, and replies that are paid for once."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspan.operators.evaluation import stage_latency
from groundspan.operators.quantiles import exact_quantiles
from groundspan.plans.rewrite import rewrite_turns
from groundspan.sources.replies import complete_once, read_ledger
from groundspan.sources.results import read_cases, read_run


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_equal_numpy(spark, share):
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(5000)], "same": [2.5] * 700, "two": [1.0, 2.0], "one": [7.0], None: [float(i % 9) for i in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("two", None), ("void", None)]
    frame = spark.createDataFrame(rows, "stage string, ms double").repartition(7)
    found = {r["stage"]: r["q"] for r in exact_quantiles(frame, ["stage"], "ms", share, "q").collect()}
    assert found.keys() == groups.keys()
    for g, vs in groups.items():
        assert np.isclose(found[g], np.quantile(vs, share), rtol=1e-12)
    told = {r["stage"]: r for r in stage_latency(frame).collect()}
    assert told["void"]["p95_ms"] is None and told["hot"]["n"] == 5000
    assert exact_quantiles(frame.limit(0), ["stage"], "ms", share, "q").count() == 0


@pytest.mark.parametrize("split", [40, 200, 1 << 20])
def test_last_record_wins_for_any_split(spark, tmp_path, split):
    raw = tmp_path / "run_label=x" / "raw"
    raw.mkdir(parents=True)
    (tmp_path / "run_label=x" / "summary").mkdir()
    (tmp_path / "run_label=x" / "summary" / "s.json").write_text('{"num_cases": 3}\n')
    (raw / "part-0.json").write_text("".join('{"id": "c%d", "category": "first %d"}\n' % (i % 50, i) for i in range(300)))
    (raw / "part-1.json").write_text('{"id": "c7", "category": "last"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found, summary = read_run(spark, str(tmp_path), "x", "id string, category string", "num_cases bigint")
        got = {r["id"]: r["category"] for r in found.collect()}
        assert got == {f"c{i}": f"first {250 + i}" for i in range(50)} | {"c7": "last"} and summary.first()["num_cases"] == 3
        (tmp_path / "cases.json").write_text("".join('{"input": "question %d"}\n' % i for i in range(40)))
        cases = read_cases(spark, str(tmp_path / "cases.json"))
        assert {r["id"]: r["turns"] for r in cases.collect()} == {f"case_{i}": [f"question {i}"] for i in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replies_are_asked_for_once(spark, tmp_path):
    def unique_replies(requests):
        if any("bad" in r["messages"][-1]["content"] for r in requests):
            raise ValueError("no")
        return [{"text": uuid.uuid4().hex, "model": "m"} for _ in requests]

    ledger = str(tmp_path / "ledger")
    shape = "request_id string, system string, messages array<struct<role: string, content: string>>"
    asked = spark.createDataFrame([(str(i), "s", [("user", f"text {i % 7}")]) for i in range(20)] + [("x", "s", [("user", "bad")])], shape)
    first = {r["request_id"]: r for r in complete_once(asked, unique_replies, ledger, part=2, wave_parts=2).collect()}
    assert len(first) == 21 and first["x"]["error"]
    assert len({first[str(i)]["text"] for i in range(20)}) == 7 and first["0"]["text"] == first["7"]["text"]
    more = asked.unionByName(spark.createDataFrame([("new", "s", [("user", "text 100")])], shape))
    again = {r["request_id"]: r for r in complete_once(more, unique_replies, ledger).collect()}
    assert all(again[str(i)]["text"] == first[str(i)]["text"] for i in range(20)) and again["new"]["text"]
    assert read_ledger(spark, ledger).count() == 9
    # what failed is asked again, and then its reply is the one that counts
    mended = complete_once(asked, lambda rs: [{"text": "fine"} for _ in rs], ledger)
    assert {r["request_id"]: r["text"] for r in mended.collect()}["x"] == "fine"
    assert complete_once(asked.limit(0), unique_replies, ledger).count() == 0


def test_only_followups_that_refer_back_are_rewritten(spark, tmp_path):
    turns = spark.createDataFrame(
        [("c:0", "c", 0, "Tell me about sourdough bread and its long history", "It is old."), ("c:2", "c", 2, "why is that", "Because."),
         ("c:4", "c", 4, "Describe marathon training plans over twelve weeks please", None), ("d:0", "d", 0, "why is that", None)],
        "query_id string, conv_id string, turn int, question string, answer string",
    )
    said = lambda rs: [{"text": '"why is sourdough old"\nmore'} for _ in rs]
    found = {r["query_id"]: r["rewritten"] for r in rewrite_turns(turns, said, "s", ledger=str(tmp_path / "l")).collect()}
    assert found["c:2"] == 'why is sourdough old"' or found["c:2"] == "why is sourdough old"
    assert found["d:0"] == "why is that" and found["c:4"].startswith("Describe") and found["c:0"].startswith("Tell")
    for completer in (None, lambda rs: [{"text": "x" * 5000} for _ in rs], lambda rs: 1 / 0):
        assert {r["rewritten"] for r in rewrite_turns(turns, completer, "s").where("query_id = 'c:2'").collect()} == {"why is that"}


def test_equal_requests_are_asked_once_in_waves(spark, tmp_path):
    """Requests of one text, of one id and without an id; each part is one batch."""
    rows = [(f"r{i % 40}" if i % 5 else None, "s", [("user", f"say {i % 23}")]) for i in range(120)]
    asked = spark.createDataFrame(rows, "request_id string, system string, messages array<struct<role: string, content: string>>").repartition(5)
    log = tmp_path / "asked"
    log.mkdir()

    def completer(requests):
        (log / uuid.uuid4().hex).write_text("\n".join(r["messages"][-1]["content"] for r in requests))
        return [{"text": r["messages"][-1]["content"].upper()} for r in requests]

    found = complete_once(asked, completer, str(tmp_path / "ledger"), part=4, wave_parts=2)
    assert sorted((r["request_id"] or "", r["text"]) for r in found.collect()) == sorted((i or "", m[0][1].upper()) for i, _, m in rows)
    said = [line for f in log.iterdir() for line in f.read_text().splitlines()]
    assert sorted(said) == sorted({m[0][1] for _, _, m in rows})
