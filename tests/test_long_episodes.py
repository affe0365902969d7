"""Passages of episodes in blocks against passages of whole rows."""

import random

import pytest
from pyspark.sql import functions as F

from groundspan.operators.long_episodes import chunk_long
from groundspan.operators.segments import chunk_segments, clean_segments
from groundspan.settings import Settings
from workload import fixtures as fx


def flat(transcripts):
    return transcripts.select("episode_id", "episode_title", "source_file", F.explode("segments").alias("s")).select(
        "episode_id", "episode_title", "source_file", "s.id", "s.start", "s.end", "s.text"
    )


@pytest.mark.parametrize("block", [3, 50])
def test_blocks_equal_rows(spark, sf, block):
    rows = fx.transcripts(spark, sf)
    want = chunk_segments(rows, fx.SETTINGS)
    found = chunk_long(flat(rows), fx.SETTINGS, block).select(want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 200


def test_odd_segments(spark):
    """Short and long segments, gaps in time and ids, no sentences, no overlap, one segment, times that go back."""
    rng = random.Random(2)
    rows = []
    for e in range(60):
        at, segments = 0.0, []
        for _ in range(rng.choice([0, 1, 2, 7, 40, 120])):
            length = rng.choice([0.0, 1.0, 5.0, 30.0, 200.0])
            text = rng.choice(["", "  ", "word", "end.", 'end."', "more words here"])
            segments.append((None, max(at, 0.0), max(at, 0.0) + length, text))
            at += length + rng.choice([0.0, 0.0, 3.0, 500.0, -4.0])
        rows.append((f"e{e}", "t", "f", segments))
    shape = "episode_id string, episode_title string, source_file string, segments array<struct<id:int,start:double,end:double,text:string>>"
    whole = spark.createDataFrame(rows, shape).withColumn("segments", clean_segments(F.col("segments"))).persist()
    for settings in (Settings(), Settings(chunk_overlap_seconds=0.0), Settings(chunk_target_seconds=10.0, chunk_max_seconds=20.0)):
        want = chunk_segments(whole, settings)
        found = chunk_long(flat(whole), settings, 4).select(want.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert chunk_long(flat(whole).limit(0)).count() == 0
    whole.unpersist()
