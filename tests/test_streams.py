"""Streams over several batches against the same work at once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from groundspan.functions.passages import PassageRule
from groundspan.operators.segments import chunk_segments
from groundspan.schemas import CHUNK
from groundspan.settings import Settings
from groundspan.sources import chunk_store
from groundspan.streaming.chunks import OpenEpisode, chunk_stream, write_chunk_stream
from groundspan.streaming.ingest import ingest_stream, stored_manifest, take_in
from workload import fixtures as fx

SEGMENTS = "episode_id string, episode_title string, source_file string, id int, start double, end double, text string, last boolean, arrived timestamp"


def raw_segments(spark, sf):
    raw = fx.raw_transcripts(spark, sf)
    return raw.select("episode_id", "episode_title", "source_file", F.posexplode("segments").alias("id", "s"), F.size("segments").alias("n")).select(
        "episode_id", "episode_title", "source_file", "id", "s.start", "s.end", "s.text", (F.col("id") == F.col("n") - 1).alias("last"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 60)").alias("arrived"),
    )


def test_passages_over_shuffled_batches_equal_the_batch(spark, sf, tmp_path):
    rows = raw_segments(spark, sf)
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("episode_id", "id"), F.lit(4))).persist()
    for part in range(4):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        # one run a part: the state lives on in the checkpoint between runs
        stream = spark.readStream.schema(SEGMENTS).parquet(source)
        write_chunk_stream(chunk_stream(stream, fx.SETTINGS), store, checkpoint)
    want = chunk_segments(fx.transcripts(spark, sf), fx.SETTINGS)
    found = spark.read.parquet(store).select(want.columns)
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    # a restart, and segments that come again, change nothing
    parts.where("part = 1").drop("part").coalesce(1).write.mode("append").parquet(source)
    write_chunk_stream(chunk_stream(spark.readStream.schema(SEGMENTS).parquet(source), fx.SETTINGS), store, checkpoint)
    assert spark.read.parquet(store).count() == want.count()
    parts.unpersist()


def test_idle_episode_ends(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)

    def run(rows):
        spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SEGMENTS).parquet(source)
        write_chunk_stream(chunk_stream(stream, Settings(), idle_seconds=600), store, checkpoint)
        return {r["chunk_id"]: (r["text"], r["segment_ids"]) for r in spark.read.schema(CHUNK).parquet(store).collect()}

    assert run([("a", "A", "f", i, i * 10.0, i * 10.0 + 10, f"word{i}", False, at(0)) for i in (0, 1, 3)]) == {}
    assert run([("b", "B", "f", 0, 0.0, 1.0, "other", True, at(5))]) == {"b_0000": ("other", [0])}
    found = run([("c", "C", "f", 0, 0.0, 1.0, "third", True, at(40))])
    assert found == {"a_0000": ("word0 word1 word3", [0, 1, 3]), "b_0000": ("other", [0]), "c_0000": ("third", [0])}
    # too late
    assert run([("a", "A", "f", 2, 20.0, 30.0, "word2", False, at(41))]) == found


@pytest.mark.parametrize("overlap", [0.0, 15.0, 60.0])
def test_open_episode_keeps_little(overlap):
    """What is held is the open passage, however long the episode; a state that was stored goes on alike."""
    rule = PassageRule(75.0, 110.0, min(overlap, 37.5))
    rng = random.Random(1)
    whole, stored = OpenEpisode(rule), OpenEpisode(rule)
    all_passages, all_stored = [], []
    for i in range(2000):
        segment = [i, i * 5.0, i * 5.0 + 5, "x", rng.random() < 0.2]
        whole.add(i, segment, False)
        stored = OpenEpisode(rule, stored.dump())
        stored.add(i, list(segment), False)
        all_passages += [[s[0] for s in p] for p in whole.advance()]
        all_stored += [[s[0] for s in p] for p in stored.advance()]
        assert len(whole.open) <= 23 and not whole.early
    assert all_passages == all_stored and len(all_passages) > 80


def ingested(spark, root):
    chunks = chunk_store.read_chunks(spark, f"{root}/chunks")
    manifest = stored_manifest(spark, root).select("episode_id", "sha256", "num_segments", "num_chunks")
    return sorted(map(tuple, chunks.select("chunk_id", "start", "end", "text").collect())), sorted(map(tuple, manifest.collect()))


def versions(spark, sf):
    """(first, second, what must be stored): changed, unchanged, new and removed episodes."""
    every = fx.transcripts(spark, sf).withColumn("arrived", F.lit(1)).persist()
    kind = F.pmod(F.xxhash64("episode_id"), F.lit(5))
    cut = F.slice("segments", 2, 1_000_000)
    first = every.where(kind != 0)
    changed = every.where(kind == 1).withColumn("segments", cut).withColumn("source_sha256", F.concat("source_sha256", F.lit("2")))
    gone = every.where(kind == 2).withColumn("segments", F.lit(None).cast(every.schema["segments"].dataType))
    fresh = every.where(kind == 0)
    second = changed.unionByName(gone).unionByName(fresh).unionByName(every.where(kind == 3)).withColumn("arrived", F.lit(2))
    return first, second, changed.unionByName(fresh).unionByName(every.where(kind.isin(3, 4)))


def test_ingest_takes_in_changes(spark, sf, tmp_path):
    first, second, final = versions(spark, sf)
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    run = lambda: ingest_stream(spark.readStream.schema(first.schema).parquet(source), root, fx.SETTINGS)
    first.repartition(2).write.mode("append").parquet(source)
    run()
    second.coalesce(1).write.mode("append").parquet(source)
    run()
    chunks = chunk_segments(final, fx.SETTINGS)
    want = sorted(map(tuple, chunks.select("chunk_id", "start", "end", "text").collect()))
    found = ingested(spark, root)
    assert found[0] == want and [r[0] for r in found[1]] == sorted(r["episode_id"] for r in final.collect())
    run()  # nothing new
    assert ingested(spark, root) == found
    # unchanged episodes were not written again
    again = spark.read.parquet(f"{root}/chunks/touched").groupBy("episode_id").count().where("count > 1")
    assert again.count() == second.count() - second.where("pmod(xxhash64(episode_id), 5) in (0, 3)").count()
    # a batch that failed midway comes again: same number, same result
    chunk_store.replace_episodes(chunks.limit(0), final.select("episode_id"), f"{root}/chunks", 1)
    plan = take_in(second, root, 1, fx.SETTINGS, "arrived")
    assert ingested(spark, root) == found
    assert {r["reason"] for r in plan.collect()} == {"new", "content changed", "source gone", None}
    take_in(second, root, 2, fx.SETTINGS, "arrived")
    assert ingested(spark, root) == found
    # another configuration cuts everything again
    from dataclasses import replace

    plan = take_in(second, root, 3, replace(fx.SETTINGS, asr_model="large"), "arrived")
    assert {r["reason"] for r in plan.where("action = 'transcribe'").collect()} == {"configuration changed"}


def test_store_replaces_removes_and_compacts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    rows = lambda *ids: spark.createDataFrame([(f"{e}_{n}", e, "t", 0.0, 1.0, f"{e} {v}", "f", [1]) for e, n, v in ids], CHUNK)
    names = lambda *ids: spark.createDataFrame([(i,) for i in ids], "episode_id string")
    texts = lambda p=path: sorted(r["text"] for r in chunk_store.read_chunks(spark, p).collect())
    assert texts() == []
    chunk_store.write_chunks(rows(("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("c", 0, 1)), path)
    assert texts() == ["a 1", "a 1", "b 1", "c 1"]
    chunk_store.replace_episodes(rows(("a", 0, 2), ("d", 0, 2)), names("a", "b", "d"), path)
    assert texts() == ["a 2", "c 1", "d 2"]
    # a load without its list of episodes is not in force
    rows(("c", 0, 9)).write.parquet(f"{path}/chunks/load=7")
    assert texts() == ["a 2", "c 1", "d 2"]
    monkeypatch.setattr(chunk_store, "fits_broadcast", lambda df: False)
    assert texts() == ["a 2", "c 1", "d 2"]
    chunk_store.compact(spark, path, str(tmp_path / "one"))
    assert texts(str(tmp_path / "one")) == ["a 2", "c 1", "d 2"] and chunk_store.loads(spark, str(tmp_path / "one")) == [0]
    chunk_store.write_chunks(rows(("e", 0, 3)), path)
    assert texts() == ["e 3"]
