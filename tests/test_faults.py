"""Faults that earlier rounds had."""

import pytest
from pyspark.sql import functions as F

from groundspan.operators import ingest, model_hooks
from groundspan.sources import manifest, transcripts
from groundspan.staging import join_checked
from workload import fixtures as fx


def test_transcripts_come_back_whole(spark, sf, tmp_path):
    rows = fx.transcripts(spark, sf).repartition(3)
    path = str(tmp_path / "t")
    transcripts.write_transcripts(rows, path)
    back, bad = transcripts.read_transcripts(spark, path)
    assert bad.count() == 0 and back.count() == rows.count() == back.select("episode_id").distinct().count()
    (tmp_path / "t" / "broken.json").write_text('{"episode_id": \nnonsense\n')
    back, bad = transcripts.read_transcripts(spark, path)
    assert back.count() == rows.count() and bad.count() == 2


@pytest.mark.parametrize(
    "names, ids",
    [
        (["a!.mp3", "a#.mp3", "a_1.mp3"], ["a", "a_1", "a_1_2"]),
        (["a!.mp3", "a#.mp3", "a_1.mp3", "a_1_2.mp3"], ["a", "a_1", "a_1_2", "a_1_2_3"]),
        (["b.mp3", "c.mp3"], ["b", "c"]),
    ],
)
def test_episode_ids_are_unique(spark, names, ids):
    files = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["name"]: r["episode_id"] for r in ingest.identify(files).collect()}
    assert [found[n] for n in names] == ids


@pytest.mark.parametrize(
    "completer, errors",
    [
        (lambda asked: [{"text": "x", "input_tokens": "n/a"} for _ in asked], 3),
        (lambda asked: [{"text": "x"}], 0),
        (lambda asked: [], 3),
        (lambda asked: ["no dict" for _ in asked], 3),
        (lambda asked: None, 3),
    ],
)
def test_odd_replies_become_error_rows(spark, completer, errors):
    asked = spark.createDataFrame(
        [(i, "s", [("user", "hi")]) for i in ("1", "2", None)],
        "request_id string, system string, messages array<struct<role: string, content: string>>",
    ).coalesce(1)
    found = model_hooks.batch_complete(asked, completer).collect()
    assert {r["request_id"] for r in found} == {"1", "2", None}
    assert sum(r["error"] is not None for r in found) == errors


@pytest.mark.parametrize(
    "reply, found",
    [
        ('x {"a": {"b": "}"}} y {', '{"a": {"b": "}"}}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ("none", None),
        ('{"a": 1', None),
        (None, None),
    ],
)
def test_first_json_object(reply, found):
    value, error = model_hooks.first_json_object(reply)
    assert value == found and (error is None) == (found is not None)


def test_manifest_faults(spark, sf, tmp_path):
    known = fx.previous_manifest(spark, sf)
    path = tmp_path / "manifest.parquet"
    assert manifest.load_manifest(spark, str(path)).count() == 0
    manifest.save_manifest(known, str(path))
    assert manifest.load_manifest(spark, str(path)).count() == ingest.current_manifest(known).count()
    broken = tmp_path / "broken.parquet"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"this is not a table")
    assert manifest.load_manifest(spark, str(broken)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_is_the_same_past_the_bound(spark, how):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), *([] if how == "left_semi" else [(F.col("id") * 2).alias("v")]))
    a, b = (join_checked(big, small, "k", how, "id", max_rows=m) for m in (100, 0))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)
