"""Passages of episodes that do not fit a row.

What the passage rule carries from one segment to the next is a single place, the
segment where the open passage began. So an episode is cut in blocks that are worked
on side by side:

1. every block works out, for each place where a passage open at its start may have
   begun, where the passage open at its end began and how many passages closed;
2. these tables, a few rows a block without any text, are composed along the episode;
3. every block, now knowing its start, makes its passages.

A passage open at a block's start reaches back less than the longest passage, so a block
needs only the blocks before it that lie within that time. A task holds one block and
those, whatever the episode's length; step 2 holds a few numbers per block of an episode.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundspan import schemas
from groundspan.functions.passages import PassageRule
from groundspan.functions.text import ends_sentence
from groundspan.operators.segments import chunk_segments
from groundspan.settings import Settings
from groundspan.staging import join_checked, stage_table

BLOCK = 1_000
FIRST = -1  # the passage begins with the block


class _Block:
    """The segments of a block behind those it may reach back to."""

    def __init__(self, rows: pd.DataFrame, rule: PassageRule):
        block = int(rows["block"].iloc[0])
        rows = rows.sort_values("source")
        parts = [s for segments in rows["segments"] for s in segments]
        self.rule = rule
        self.ids = [int(s["id"]) for s in parts]
        self.starts = [float(s["start"]) for s in parts]
        self.ends = [float(s["end"]) for s in parts]
        self.sentence = [bool(s["sentence"]) for s in parts]
        self.texts = [s["text"] for s in parts]
        own = rows[rows["source"] == block]
        self.first = len(parts) - len(own["segments"].iloc[0])
        self.place = {i: at for at, i in enumerate(self.ids)}

    def close(self, begin: int, at: int) -> tuple[int, int] | None:
        """(last segment of the passage open since ``begin``, begin of the next), from segment ``at`` on."""
        for i in range(at, len(self.ids)):
            if self.rule.closes(self.starts[begin], self.ends[i], self.sentence[i]):
                return i, self.rule.next_begin(self.starts, begin, i, self.ends[i])
        return None

    def begins(self) -> list[int]:
        if not self.first:
            return [0]
        reach = self.ends[self.first - 1] - self.rule.longest
        return [j for j in range(self.first) if self.starts[j] > reach] + [self.first]

    def table(self) -> list[tuple]:
        """(begin, begin at the end, passages closed, end of the last one) by begin."""
        known: dict[tuple[int, int], tuple] = {}
        out = []
        for begin in self.begins():
            path, here, at = [], begin, self.first
            while (at, here) not in known:
                path.append((at, here))
                closed = self.close(here, at) if at < len(self.ids) and here < len(self.ids) else None
                if closed is None:
                    known[at, here] = (here, 0, None)
                    break
                here, at = closed[1], closed[0] + 1
            end, count, last = known[at, here]
            # back along the passages that closed on the way
            for k in range(len(path) - 1, -1, -1):
                if path[k] in known:
                    continue
                after = path[k + 1] if k + 1 < len(path) else (at, here)
                _, count, last = known[after]
                known[path[k]] = (end, count + 1, self.ends[after[0] - 1] if last is None else last)
            end, count, last = known[self.first, begin]
            name = FIRST if begin == self.first else self.ids[begin]
            out.append((name, self.ids[end] if end < len(self.ids) else FIRST, count, last))
        return out

    def passages(self, begin: int, closed_end: float | None, is_last: bool) -> Iterator[tuple[int, int]]:
        """(first, last segment) of each passage that closes in the block."""
        here, at = self.first if begin == FIRST else self.place[begin], self.first
        while here < len(self.ids) and (closed := self.close(here, at)):
            yield here, closed[0]
            closed_end, (last, here) = self.ends[closed[0]], closed
            at = last + 1
        if is_last and here < len(self.ids) and self.rule.has_new_tail(self.ends[-1], closed_end):
            yield here, len(self.ids) - 1


def _composed(tables: pd.DataFrame) -> pd.DataFrame:
    """Per block: where its open passage begins, passages before it, end of the last of them."""
    out = []
    begin, number, closed_end = FIRST, 0, None
    for block, own in tables.sort_values("block").groupby("block", sort=True):
        out.append((own["episode_id"].iloc[0], block, begin, number, closed_end))
        row = own[own["begin"] == begin].iloc[0]
        begin, number = int(row["out"]), number + int(row["closed"])
        closed_end = closed_end if pd.isna(row["closed_end"]) else float(row["closed_end"])
    frame = pd.DataFrame(out, columns=["episode_id", "block", "begin", "number", "closed_end"])
    return frame.assign(is_last=frame["block"] == frame["block"].max())


def chunk_long(segments: DataFrame, settings: Settings = Settings(), block: int = BLOCK) -> DataFrame:
    """Passages of clean segments (episode_id, episode_title, source_file, id, start, end, text).

    Equal to ``chunk_segments`` on the same segments nested in rows. Ids grow along an
    episode; gaps are allowed. Episodes of one block are nested and cut in the JVM.
    """
    rule = PassageRule.of(settings)
    segment = F.struct("id", "start", "end", ends_sentence(F.col("text")).alias("sentence"), "text")
    every = stage_table(
        segments.withColumn("source", F.floor(F.col("id") / block).cast("bigint"))
        .groupBy("episode_id", "source")
        .agg(
            F.sort_array(F.collect_list(segment)).alias("segments"),
            F.first("episode_title").alias("episode_title"),
            F.first("source_file").alias("source_file"),
        ),
        "long-blocks",
    )
    several = every.groupBy("episode_id").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1")
    several = stage_table(several, "long-episodes")
    marked = stage_table(join_checked(every, several, "episode_id", "left", salt_by="source"), "long-marked")
    packed = marked.where("n_blocks is not null").drop("n_blocks")
    single = marked.where("n_blocks is null").drop("source", "n_blocks")  # a row each
    edges = packed.select(
        "episode_id", "source", F.array_max(F.transform("segments", lambda s: s["start"])).alias("latest"),
        F.element_at("segments", -1)["end"].alias("last_end"),
    )

    def reaches(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        sources, latest = rows["source"].to_numpy(), np.maximum.accumulate(rows["latest"].to_numpy())
        before = rows["last_end"].to_numpy()[:-1] - rule.longest
        first = np.minimum(np.searchsorted(latest, before, "right"), np.arange(1, len(sources)))
        counts = np.concatenate([[1], np.arange(1, len(sources)) - first + 1])
        begins = np.concatenate([[0], first])
        at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return pd.DataFrame({"episode_id": rows["episode_id"].iloc[0], "block": np.repeat(sources, counts), "source": sources[at]})

    pairs = edges.groupBy("episode_id").applyInPandas(reaches, "episode_id string, block bigint, source bigint")
    blocks = stage_table(pairs.join(packed, ["episode_id", "source"]), "long-reaches")

    def tables(rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_Block(rows, rule).table(), columns=["begin", "out", "closed", "closed_end"])
        found["closed_end"] = found["closed_end"].astype(float)
        return found.assign(episode_id=rows["episode_id"].iloc[0], block=rows["block"].iloc[0])

    shape = "begin bigint, out bigint, closed bigint, closed_end double, episode_id string, block bigint"
    entry = (
        blocks.drop("episode_title", "source_file")
        .groupBy("episode_id", "block")
        .applyInPandas(tables, shape)
        .groupBy("episode_id")
        .applyInPandas(_composed, "episode_id string, block bigint, begin bigint, number bigint, closed_end double, is_last boolean")
    )

    def passages(rows: pd.DataFrame) -> pd.DataFrame:
        own, r = _Block(rows, rule), rows.iloc[0]
        closed_end = None if pd.isna(r["closed_end"]) else float(r["closed_end"])
        out = []
        for n, (first, last) in enumerate(own.passages(int(r["begin"]), closed_end, bool(r["is_last"]))):
            text = " ".join(t.strip() for t in own.texts[first : last + 1]).strip()
            out.append(
                (
                    f"{r['episode_id']}_{int(r['number']) + n:04d}", r["episode_id"], r["episode_title"], own.starts[first],
                    own.ends[last], text, r["source_file"], own.ids[first : last + 1],
                )
            )
        return pd.DataFrame(out, columns=[c.split()[0] for c in schemas.CHUNK.split(", ")])

    long = blocks.join(entry, ["episode_id", "block"]).groupBy("episode_id", "block").applyInPandas(passages, schemas.CHUNK)
    return long.unionByName(chunk_segments(single, settings))
