"""Segment cleaning and time-bounded passages.

A *transcript* row nests all segments of an episode, so cleaning and passage
building are narrow: no shuffle at all. An episode must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundspan.functions.text import ends_sentence, let, strip_ws
from groundspan.settings import Settings

_PAIRS = "array<struct<b:int,i:int>>"


def clean_segments(raw: Column) -> Column:
    """Strip texts, round times to 3 dp, drop blanks.

    Ids are the positions before blanks were dropped, so they may have gaps.
    """
    numbered = F.transform(
        raw,
        lambda s, i: F.struct(
            i.alias("id"),
            F.round(s["start"], 3).alias("start"),
            F.round(s["end"], 3).alias("end"),
            strip_ws(s["text"]).alias("text"),
        ),
    )
    return F.filter(numbered, lambda s: F.length(s["text"]) > 0)


def transcript_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), " ")


def passage_bounds(segments: Column, settings: Settings) -> Column:
    """First and last segment index of every passage, in order.

    A fold over the segments whose state is one integer, the index where the
    open passage begins. A passage closes at segment ``i`` when it spans the
    target and ``i`` ends a sentence, or when it reaches the hard maximum. The
    next one begins at the first segment that starts inside the overlap.
    """
    target, hard = settings.chunk_target_seconds, settings.hard_max_seconds
    overlap = settings.overlap_seconds

    def begin_after(begin: Column, i: Column) -> Column:
        if overlap <= 0:
            return i + 1
        cutoff = F.get(segments, i)["end"] - F.lit(overlap)
        replayed = F.filter(
            F.sequence(begin, i), lambda j: F.get(segments, j)["start"] >= cutoff
        )
        return F.coalesce(F.array_min(replayed), i + 1)

    def step(state: Column, i: Column) -> Column:
        last = F.get(segments, i)
        span = last["end"] - F.get(segments, state["b"])["start"]
        closes = (span >= hard) | ((span >= target) & ends_sentence(last["text"]))
        return F.when(
            closes,
            F.struct(
                begin_after(state["b"], i).alias("b"),
                F.concat(
                    state["out"], F.array(F.struct(state["b"].alias("b"), i.alias("i")))
                ).alias("out"),
            ),
        ).otherwise(state)

    def finish(state: Column) -> Column:
        n = F.size(segments)
        closed = F.get(state["out"], F.size(state["out"]) - 1)
        closed_end = F.get(segments, closed["i"])["end"]
        tail_is_new = F.coalesce(
            F.get(segments, n - 1)["end"] > closed_end + 1.0, F.lit(True)
        )
        return F.when(
            (state["b"] < n) & tail_is_new,
            F.concat(
                state["out"],
                F.array(F.struct(state["b"].alias("b"), (n - 1).alias("i"))),
            ),
        ).otherwise(state["out"])

    empty = F.expr(f"cast(array() as {_PAIRS})")
    return F.when(F.size(segments) == 0, empty).otherwise(
        F.aggregate(
            F.sequence(F.lit(0), F.size(segments) - 1),
            F.struct(F.lit(0).alias("b"), empty.alias("out")),
            step,
            finish,
        )
    )


def passage_text(texts: Column) -> Column:
    return strip_ws(F.array_join(F.transform(texts, strip_ws), " "))


def chunk_segments(transcripts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per passage of every transcript; a narrow transformation."""
    seg = F.col("segments")

    def passage(bounds: Column, pos: Column) -> Column:
        members = F.slice(seg, bounds["b"] + 1, bounds["i"] - bounds["b"] + 1)
        return let(
            members,
            lambda m: F.struct(
                chunk_id(F.col("episode_id"), pos).alias("chunk_id"),
                F.get(m, F.lit(0))["start"].alias("start"),
                F.get(m, F.size(m) - 1)["end"].alias("end"),
                passage_text(F.transform(m, lambda s: s["text"])).alias("text"),
                F.transform(m, lambda s: s["id"]).alias("segment_ids"),
            ),
        )

    bounded = transcripts.withColumn("_bounds", passage_bounds(seg, settings))
    exploded = bounded.select(
        "episode_id",
        "episode_title",
        "source_file",
        F.explode(F.transform("_bounds", passage)).alias("p"),
    )
    return exploded.select(
        "p.chunk_id",
        "episode_id",
        "episode_title",
        F.round("p.start", 3).alias("start"),
        F.round("p.end", 3).alias("end"),
        "p.text",
        "source_file",
        "p.segment_ids",
    )


def chunk_id(episode_id: Column, position: Column) -> Column:
    """``<episode>_0007``; longer numbers keep all their digits."""
    number = position.cast("string")
    return F.concat(
        episode_id,
        F.lit("_"),
        F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number),
    )


def episode_stats(transcripts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments, passages and mean passage length per episode."""
    per_episode = chunks.groupBy("episode_id").agg(
        F.count("*").alias("num_chunks"),
        F.round(F.avg(F.col("end") - F.col("start")), 1).alias("mean_chunk_seconds"),
    )
    return (
        transcripts.select(
            "episode_id", F.size("segments").cast("bigint").alias("num_segments")
        )
        .join(per_episode, "episode_id", "left")
        .na.fill(0, ["num_chunks"])
        .na.fill(0.0, ["mean_chunk_seconds"])
    )


def episode_outline(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages of each episode in time order with a 200-character preview."""
    from groundspan.functions.timefmt import format_range

    return (
        chunks.join(episodes.select("episode_id", "title"), "episode_id")
        .select(
            "episode_id",
            "title",
            "chunk_id",
            "start",
            "end",
            format_range(F.col("start"), F.col("end")).alias("timestamp"),
            F.substring("text", 1, 200).alias("preview"),
        )
        .orderBy("episode_id", "start", "chunk_id")
    )
