"""Passages from a stream of segments, in any order.

State per episode is what the passage rule still needs: the segments since the open
passage began, segments that came before their turn, the number of the next passage
and the end of the last one. A segment that was seen before is passed over, so a
source may deliver twice.
"""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundspan import schemas
from groundspan.functions.passages import PassageRule
from groundspan.functions.text import ends_sentence, strip_ws
from groundspan.settings import Settings

STATE = "held string"
_READ = ["arrived_ms", "episode_title", "source_file", "id", "start", "end", "text", "sentence", "last"]


class OpenEpisode:
    """One episode between two batches."""

    def __init__(self, rule: PassageRule, kept: str | None = None):
        self.rule = rule
        state = json.loads(kept) if kept else {}
        self.open: list[list] = state.get("open", [])  # [id, start, end, text, ends a sentence]
        self.early: dict[str, list] = state.get("early", {})
        self.next = state.get("next", 0)
        self.total = state.get("total")
        self.passages = state.get("passages", 0)
        self.closed_end = state.get("closed_end")
        self.about = state.get("about", [None, None])
        self.latest = state.get("latest", 0)
        self.done = state.get("done", False)

    def dump(self) -> str:
        if self.done:  # only to know segments that come again
            return json.dumps({"done": True, "latest": self.latest})
        return json.dumps({k: v for k, v in vars(self).items() if k != "rule"})

    def add(self, id_: int, segment: list, last: bool) -> None:
        if not self.done and id_ >= self.next:
            self.early[str(id_)] = segment
            if last:
                self.total = id_ + 1

    def advance(self, skip_gaps: bool = False) -> Iterator[list[list]]:
        """Segments whose turn has come, as passages that close; with ``skip_gaps`` all there are."""
        while self.early:
            if str(self.next) not in self.early:
                if not skip_gaps:
                    return
                self.next = min(map(int, self.early))
            segment = self.early.pop(str(self.next))
            self.next += 1
            if segment[3]:
                yield from self._take(segment)

    def _take(self, segment: list) -> Iterator[list[list]]:
        self.open.append(segment)
        end = segment[2]
        if self.rule.closes(self.open[0][1], end, segment[4]):
            yield self.open
            self.closed_end = end
            begin = self.rule.next_begin([s[1] for s in self.open], 0, len(self.open) - 1, end)
            self.open = self.open[begin:]

    def finish(self) -> Iterator[list[list]]:
        if self.open and self.rule.has_new_tail(self.open[-1][2], self.closed_end):
            yield self.open
        self.open, self.early, self.done = [], {}, True


def _passages(settings: Settings, idle_ms: int):
    rule = PassageRule.of(settings)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episode = OpenEpisode(rule, state.get[0] if state.exists else None)
        closed: list[list[list]] = []
        if state.hasTimedOut and episode.done:
            state.remove()  # its segments would come too late now
            return
        if state.hasTimedOut:
            closed += episode.advance(skip_gaps=True)
            closed += episode.finish()
        else:
            for batch in batches:
                # columns as lists: making tuples of a frame costs more than an episode's few segments
                for arrived, title, file, id_, start, end, text, sentence, last in zip(*(batch[c].tolist() for c in _READ)):
                    episode.latest = max(episode.latest, int(arrived))
                    episode.about = [title, file]
                    episode.add(int(id_), [int(id_), float(start), float(end), text or "", bool(sentence)], bool(last))
            closed += episode.advance()
            if episode.total is not None and episode.next >= episode.total and not episode.done:
                closed += episode.finish()
        rows = []
        for passage in closed:
            rows.append(
                (
                    f"{key[0]}_{episode.passages:04d}", key[0], episode.about[0], passage[0][1], passage[-1][2],
                    " ".join(s[3] for s in passage), episode.about[1], [s[0] for s in passage],
                )
            )
            episode.passages += 1
        state.update((episode.dump(),))
        state.setTimeoutTimestamp(max(episode.latest + idle_ms, state.getCurrentWatermarkMs() + 1))
        names = [c.split()[0] for c in schemas.CHUNK.split(", ")]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def chunk_stream(segments: DataFrame, settings: Settings = Settings(), idle_seconds: int = 3600) -> DataFrame:
    """Passages, as a stream, of a stream of raw segments.

    ``segments``: (episode_id, episode_title, source_file, id, start, end, text, last,
    arrived); ids count from 0 without gaps, ``last`` marks an episode's last segment,
    ``arrived`` is the time at which the source got the row. The rest of an episode
    comes out after its last segment, or when for ``idle_seconds`` none of it has arrived
    (by the watermark); then what is missing is passed over, and what comes later too.
    """
    text: Column = strip_ws(F.coalesce("text", F.lit("")))
    ready = segments.withWatermark("arrived", f"{idle_seconds} seconds").select(
        "arrived", F.unix_millis("arrived").alias("arrived_ms"), "episode_id", "episode_title", "source_file", F.col("id").cast("bigint").alias("id"),
        F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), text.alias("text"),
        ends_sentence(text).alias("sentence"), F.coalesce("last", F.lit(False)).alias("last"),
    )
    return ready.groupBy("episode_id").applyInPandasWithState(
        _passages(settings, idle_seconds * 1000), schemas.CHUNK, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def write_chunk_stream(passages: DataFrame, store: str, checkpoint: str) -> None:
    """Append what the source holds now to ``store``; a batch that is repeated is written once."""
    (
        passages.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", store)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
