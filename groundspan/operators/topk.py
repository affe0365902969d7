"""The best passages of many questions at once, in bounded memory.

Questions and passages meet in blocks; a task keeps a few times ``k`` rows a question,
however many passages it scores, and passes ``k`` on.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundspan.staging import stage_table

# Slices of questions that a task takes at once where they meet passages in blocks, the least passages
# that are worth a task of their own, and the bytes of a block.
TASK_SLICES, LEAST_BLOCK, PACKED_BYTES = 4, 2048, 8_000_000


def best_cells(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the ``k`` largest finite cells per row that reach the row's floor, left-most on ties."""
    chosen = (scores >= floor[:, None]) & np.isfinite(scores)
    for row in np.flatnonzero(np.count_nonzero(chosen, axis=1) > k):
        cols = np.flatnonzero(chosen[row])
        own = scores[row, cols]
        cut = np.partition(own, len(own) - k)[len(own) - k]
        above = own > cut
        level = np.flatnonzero(own == cut)[: k - np.count_nonzero(above)]
        chosen[row] = False
        chosen[row, cols[above]] = True
        chosen[row, cols[level]] = True
    return np.nonzero(chosen)


class Best:
    """The ``k`` best passages of each question among those seen, ties by passage id."""

    def __init__(self, questions: int, k: int):
        self.k, self.bound = k, max(2 * questions * k, 1 << 15)
        self.floor = np.full(questions, -np.inf)
        self.found: list[pa.Table] = []
        self.held = 0

    def add(self, first: int, scores: np.ndarray, names: pa.Table) -> None:
        """Scores of the questions from number ``first`` on (rows) for the passages ``names``
        (columns, ordered by ``chunk_id``); minus infinity is no candidate."""
        rows, cols = best_cells(scores, self.k, self.floor[first : first + len(scores)])
        if not len(rows):
            return
        found = names.take(pa.array(cols))
        found = found.append_column("question", pa.array(rows + first)).append_column("score", pa.array(scores[rows, cols]))
        self.found.append(found)
        self.held += len(rows)
        if self.held > self.bound:
            self._cut()

    def _cut(self) -> None:
        every = pa.concat_tables(self.found).sort_by([("question", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        question = every.column("question").to_numpy()
        sizes = np.bincount(question, minlength=len(self.floor))
        begin = np.cumsum(sizes) - sizes
        full = np.flatnonzero(sizes >= self.k)
        self.floor[full] = every.column("score").to_numpy()[begin[full] + self.k - 1]
        every = every.take(pa.array(np.flatnonzero(np.arange(len(question)) - begin[question] < self.k))).combine_chunks()
        self.found, self.held = [every], every.num_rows

    def rows(self) -> pa.Table | None:
        """The columns of ``names``, ``question`` (its number) and ``score``; None if nothing was found."""
        if not self.found:
            return None
        self._cut()
        return self.found[0]


def in_blocks(
    questions: DataFrame,
    passages: DataFrame,
    asked: int,
    held: int,
    query_slice: int,
    passage_block: int,
    begin: Callable[[pa.Table], tuple[Callable[[pa.Table], None], Callable[[], pa.Table]]],
    schema: str,
) -> DataFrame:
    """Slices of the questions with all passages, without the driver.

    There are ``asked`` and ``held`` of them. ``begin`` takes a slice and gives two functions, one
    to see some passages and one for the rows in the end. Passages are read and packed for
    each slice where they are: none is shuffled or written, and only a slice is copied to
    the tasks. A slice meets the passages in no more parts than keep the cores busy.
    """
    spark = questions.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PACKED_BYTES)  # a row is a block
    slices = max(1, -(-asked // (TASK_SLICES * query_slice)))
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(-(-2 * cores // slices), -(-held // LEAST_BLOCK)))

    def packed(table: pa.Table) -> pa.Array:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        return pa.array([out.getvalue().to_pybytes()], pa.binary())

    def read(column: pa.Array, row: int) -> pa.Table:
        return pa.ipc.open_stream(column[row].as_buffer()).read_all()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows, size = [], 0, 0
        for batch in batches:
            step = min(passage_block, LEAST_BLOCK)
            for at in range(0, batch.num_rows, step):
                some.append(batch.slice(at, step))
                rows, size = rows + some[-1].num_rows, size + some[-1].nbytes
                if rows >= passage_block or size >= PACKED_BYTES:
                    yield pa.record_batch([packed(pa.Table.from_batches(some))], names=["block"])
                    some, rows, size = [], 0, 0
        if some:
            yield pa.record_batch([packed(pa.Table.from_batches(some))], names=["block"])

    def pack_slice(key: tuple, own: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int64()), packed(own.drop_columns("_slice"))], names=["slice", "asked"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[int, tuple] = {}
        for batch in batches:
            for row, number in enumerate(batch.column("slice").to_pylist()):
                if number not in begun:
                    begun[number] = begin(read(batch.column("asked"), row))
                begun[number][0](read(batch.column("block"), row))
        for _, rows in begun.values():
            yield from rows().to_batches()

    dealt = questions.withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("bigint"))
    left = stage_table(dealt.groupBy("_slice").applyInArrow(pack_slice, "slice bigint, asked binary"), "question-slices")
    right = passages.mapInArrow(pack, "block binary").coalesce(parts)
    met = right.hint("shuffle_replicate_nl").crossJoin(left.repartitionByRange(slices, "slice"))
    return met.mapInArrow(meet, schema)
