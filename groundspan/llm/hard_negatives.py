"""Hard negatives by an inverted multi-index.

For an anchor, its positives are the best rows of its own label; hard negatives of
a positive are the best rows of other labels whose score lies in a window under
the positive's score. A score is the inner product of two rows' whole numbers.

* A vector is cut in two halves. Two codebooks, one a half, are fitted on a bounded
  sample of rows (``SAMPLE`` rows, drawn by a hash of the id); a row's cell is its
  pair of codes. Every row is indexed.
* The index is dealt in blocks of about ``BLOCK`` rows by a hash of the id. A block
  lies in one row, ordered by cell, with a radius for each half code: the largest
  distance of its rows from the code. So no label, cell or group of copies can make
  a block large.
* A search in a block takes the cells in the order of their bounds, the sum of two
  half bounds (inner product with the code plus radius times the anchor's length in
  that half), from a heap that walks the sorted halves (multi-sequence). No row of a
  cell can score more than its bound, so the search ends as soon as each wanted list
  is certified: it is full and its last score is above the next bound, or the next
  bound is under its window.
* Anchors meet the blocks twice, for positives and then, with the windows known, for
  negatives. Blocks are written once; anchors, in slices, are sent to each block (a
  stated query set against all rows, in blocks), and only full lists of a block go
  on: at most ``positives`` rows an anchor, ``negatives`` a window.

Cases: rows with a null id, label or vector, an empty vector, or a null or non-finite
component take no part, nor do those of another length than the commonest (of equally
common, the longest), nor those with a number so large that a score would not fit a
long. Rows of one id count once, with the largest of their vectors, then labels. Ties
go to the smaller id. Fewer rows than asked for: all there are; no anchor or an empty
table: no rows. Results carry only their own columns.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundspan.llm.tables import small_batches
from groundspan.staging import stage_table

CODES, SAMPLE, ROUNDS = 32, 20_000, 12
BLOCK, SLICE = 8_192, 512
# Rows scored at once, when so many stand in the next cells of the walk.
AT_ONCE = 512
SEED = 42
LOW, HIGH = 80, 100


def codebook(rows: np.ndarray, codes: int = CODES, seed: int = SEED) -> np.ndarray:
    """Centres of the rows by k-means; fewer different rows give fewer centres."""
    different = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.permutation(len(different))[:codes]].astype(float)
    for _ in range(ROUNDS):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        times = np.bincount(own, minlength=len(centres))
        centres = np.where(times[:, None] > 0, sums / np.maximum(times, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles where these cannot be rounded."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(len(query), 1)
    if top < 2**53:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


class Cells:
    """A block of rows in the order of their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.half = books, books[0].shape[1]
        parts = numbers[:, : self.half].astype(float), numbers[:, self.half :].astype(float)
        codes = [nearest(p, b) for p, b in zip(parts, books)]
        self.radii = []
        for part, code, book in zip(parts, codes, books):
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.numbers = ids[order], labels[order], numbers[order]
        edges = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.begin, self.end = edges[:-1], edges[1:]

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound of all rows not given yet before this step, places of the next rows)."""
        bounds, ranked = [], []
        for part, book, radius in zip((query[: self.half], query[self.half :]), self.books, self.radii):
            length = float(np.sqrt((part.astype(float) ** 2).sum()))
            used = np.flatnonzero(radius >= 0)
            bound = book[used] @ part + radius[used] * length
            # beyond the rounding of doubles
            bound += 1e-9 * (1 + np.abs(book[used]) @ np.abs(part) + radius[used] * length)
            order = np.argsort(-bound, kind="stable")
            bounds.append(bound[order])
            ranked.append(used[order])
        if not len(ranked[0]) or not len(ranked[1]):
            return
        first, second = (b.tolist() for b in bounds)
        width = len(self.books[1])
        heap = [(-(first[0] + second[0]), 0, 0)]
        held, count, top = [], 0, first[0] + second[0]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # each cell comes in once: along its row, and rows from their first cell
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            cell = ranked[0][i] * width + ranked[1][j]
            if self.end[cell] > self.begin[cell]:
                top = -bound if not held else top
                held.append(np.arange(self.begin[cell], self.end[cell]))
                count += self.end[cell] - self.begin[cell]
            if held and (count >= AT_ONCE or not heap):
                yield top, np.concatenate(held)
                held, count = [], 0

    def positives(self, anchor: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best other rows of the label."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for bound, places in self.walk(query):
            if len(ids) == k and scores[-1] > bound:
                break
            places = places[(self.labels[places] == label) & (self.ids[places] != anchor)]
            ids, scores = _best(ids, scores, self.ids[places], products(self.numbers[places], query), k)
        return ids, scores

    def negatives(self, label: int, query: np.ndarray, tops: list[int], lows: list[int], k: int):
        """For each window from ``lows`` to ``tops``: (ids, scores) of its ``k`` best rows of other labels."""
        lists = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(tops)
        for bound, places in self.walk(query):
            open_ones = [
                w
                for w, (ids, scores) in enumerate(lists)
                if lows[w] <= tops[w] and bound >= lows[w] and not (len(ids) == k and scores[-1] > bound)
            ]
            if not open_ones:
                break
            places = places[self.labels[places] != label]
            scores = products(self.numbers[places], query)
            for w in open_ones:
                fits = (scores >= lows[w]) & (scores <= tops[w])
                lists[w] = _best(*lists[w], self.ids[places[fits]], scores[fits], k)
        return lists


def _best(ids, scores, more_ids, more_scores, k: int):
    ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def window_of(positive: Column, low: int, high: int) -> tuple[Column, Column]:
    """Least and largest whole n with ``low * p <= 100 * n <= high * p``."""
    floor = lambda n: ((n - F.pmod(n, F.lit(100))) / 100).cast("bigint")
    return -floor(-positive * low), floor(positive * high)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = LOW,
    high: int = HIGH,
    vec_id: str = "vec_id",
    numbers: str = "numbers",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``numbers`` is an array of whole numbers; ``low`` and ``high`` are the window in
    hundredths of the positive's score.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = F.col(numbers).cast("array<bigint>")
    held = rows.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), whole.alias("numbers"), is_anchor.alias("q")
    )
    largest = F.floor(F.sqrt(F.lit(2.0**56) / F.greatest(F.size("numbers"), F.lit(1)))).cast("bigint")
    usable = (F.size("numbers") > 0) & F.forall("numbers", lambda x: x.isNotNull() & (x <= largest) & (x >= -largest))
    good = stage_table(
        held.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.max(F.struct("numbers", "label")).alias("r"), F.bool_or("q").alias("q"))
        .select("vec_id", "r.label", "r.numbers", "q"),
        "negatives-rows",
    )
    common = good.groupBy(F.size("numbers").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], result)
    dim = common["dim"]
    good = good.where(F.size("numbers") == dim)
    draw = F.xxhash64("vec_id") / F.lit(2.0**64) + 0.5
    sample = good.where(draw <= SAMPLE / common["count"]).select("numbers").toArrow()["numbers"].to_pylist()
    if not sample:
        sample = [good.first()["numbers"]]
    fit, half = np.array(sample, float).reshape(-1, dim), (dim + 1) // 2
    books = spark.sparkContext.broadcast((codebook(fit[:, :half]), codebook(fit[:, half:])))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        values = np.array(block["numbers"].to_list(), np.int64).reshape(-1, dim)
        return pd.DataFrame(
            {
                "block": [block["block"].iloc[0]],
                "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
                "labels": [block["label"].to_numpy(np.int64).tobytes()],
                "numbers": [values.astype(np.int32).tobytes()],
            }
        )

    blocks = -(-common["count"] // BLOCK)
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("block")
    index = good.select("vec_id", "label", "numbers", deal(blocks)).groupBy("block").applyInPandas(
        packed, "block int, ids binary, labels binary, numbers binary"
    )
    index = stage_table(index, "negatives-index")
    anchors = good.where("q").select("vec_id", "label", "numbers")

    def meet(queries: DataFrame, find, shape: str) -> DataFrame:
        """Each slice of queries beside each block; ``find`` makes rows of a block and one query."""
        slices = -(-max(queries.count(), 1) // SLICE)
        fields = F.collect_list(F.struct(*[c for c in queries.columns])).alias("asked")
        sliced = queries.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).alias("slice")).agg(fields)
        copies = sliced.select("asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        names = [part.split()[0] for part in shape.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, of = None, None
            for batch in batches:
                for r in batch.itertuples():
                    if of != r.block:
                        cells, of = Cells(
                            np.frombuffer(r.ids, np.int64),
                            np.frombuffer(r.labels, np.int64),
                            np.frombuffer(r.numbers, np.int32).reshape(-1, dim),
                            books.value,
                        ), r.block
                    out = [row for query in r.asked for row in find(cells, query)]
                    if out:
                        yield pd.DataFrame(out, columns=names)

        # blocks are spread over tasks, and stay where they are while the slices come by; neither side is
        # broadcast, though Spark takes exploded copies for no larger than one of them
        return copies.hint("merge").join(index.hint("merge"), "block").mapInPandas(run, shape)

    small_batches(spark)

    def find_positives(cells: Cells, q) -> Iterator[tuple]:
        query = np.array(q["numbers"], np.int64)
        for i, s in zip(*cells.positives(q["vec_id"], q["label"], query, positives)):
            yield q["vec_id"], int(i), int(s)

    best = Window.partitionBy("vec_id").orderBy(F.desc("score"), "other")
    chosen = (
        meet(anchors, find_positives, "vec_id long, other long, score long")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= positives)
    )
    least, most = window_of(F.col("score"), low, high)
    windows = chosen.select("vec_id", F.struct("other", "score", least.alias("least"), most.alias("most")).alias("w"))
    asked = stage_table(
        anchors.join(windows.groupBy("vec_id").agg(F.collect_list("w").alias("windows")), "vec_id"), "negatives-windows"
    )

    def find_negatives(cells: Cells, q) -> Iterator[tuple]:
        query, ws = np.array(q["numbers"], np.int64), q["windows"]
        lists = cells.negatives(q["label"], query, [w["most"] for w in ws], [w["least"] for w in ws], negatives)
        for w, (ids, scores) in zip(ws, lists):
            for i, s in zip(ids, scores):
                yield q["vec_id"], w["other"], w["score"], int(i), int(s)

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = meet(asked, find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def negatives_query(vectors: DataFrame) -> DataFrame:
    """The contract's anchors, labels and whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("numbers")
    )
    return mine(rows, F.col("vec_id") % 100 == 0)


# DuckDB: every anchor against every other row.
ORACLE_SQL = """
WITH f AS (
  SELECT vec_id, max(struct_pack(
      n := list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)),
      l := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), v AS (SELECT vec_id, r.n AS n, r.l AS l FROM f),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.l = b.l AS same,
    CAST(list_reduce(list_transform(range(1, len(a.n) + 1), lambda i: a.n[i] * b.n[i]), lambda x, y: x + y) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.n) = len(b.n) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM s WHERE same) t
  WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
