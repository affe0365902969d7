"""The passage rule over one episode's segments, for workers that see them piece by piece.

A passage closes at a segment when it spans the target and the segment ends a
sentence, or when it reaches the hard maximum; the next one begins at the first of
its segments that starts inside the overlap, else at the segment after.
``operators.segments.passage_bounds`` is the same rule as a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from groundspan.settings import Settings


@dataclass(frozen=True)
class PassageRule:
    target: float
    longest: float
    overlap: float

    @classmethod
    def of(cls, settings: Settings) -> PassageRule:
        return cls(settings.chunk_target_seconds, settings.hard_max_seconds, settings.overlap_seconds)

    def closes(self, begin: float, end: float, sentence: bool) -> bool:
        span = end - begin
        return span >= self.longest or (sentence and span >= self.target)

    def next_begin(self, starts: Sequence[float], first: int, last: int, end: float) -> int:
        """Where the passage after [first, last] begins; ``starts`` is read from ``first`` to ``last``."""
        if self.overlap > 0:
            for j in range(first, last + 1):
                if starts[j] >= end - self.overlap:
                    return j
        return last + 1

    def has_new_tail(self, end: float, closed_end: float | None) -> bool:
        """Whether what is left after the last passage says anything new."""
        return closed_end is None or end > closed_end + 1.0
