"""SimHash near-duplicates through tables of distances to pivots.

Hamming distances from every distinct fingerprint to reference fingerprints
(pivots) are worked out once. Two fingerprints within ``RADIUS`` differ by at
most ``RADIUS`` in their distance to any pivot.

* Block pivots (zero, and one per block of two bits) give the number of ones in
  each block. The blocks form four quarters; two differing bits leave at least
  two quarters alike, so linked fingerprints agree on the block distances of at
  least one of six pairs of quarters. Each pair is a join key.
* ``WIDE_PIVOTS`` scattered pivots then discard pairs by the largest coordinate
  difference, inside the join.
* Survivors are verified by the differing bits.

Only distinct fingerprints are joined, so exact copies are one row there.
Links are turned into components by alternating stars, a few joins a round.

Cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other. Fewer words than a shingle: the whole sequence is one
shingle. Repeated rows are judged alike. A null id is never the name of a
component; a component without any id has a null name. Empty tables give no
rows. Results carry only their own columns.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from groundspan.llm.tables import chunks, clean, small_batches
from groundspan.staging import stage_table

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK_BITS, QUARTERS = 2, 4
WIDE_PIVOTS = 18
HASHES_AT_ONCE = 1 << 17


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()[shingle - 1 :] or [len(joined)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(ends), HASHES_AT_ONCE):
        part = ends[at : at + HASHES_AT_ONCE]
        hashes = [
            xxhash.xxh64_intdigest(joined[b:e], seed)
            for b, e in zip(begins[at : at + len(part)], part)
        ]
        bits = np.unpackbits(
            np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        votes += bits.sum(axis=0, dtype=np.int64)
    ones = votes * 2 > len(ends)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def signed_fingerprint(text: str) -> int:
    return _signed(fingerprint(text))


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        texts = clean(batch)
        prints = [signed_fingerprint(t) for part in chunks(texts) for t in texts[part]]
        yield pd.Series(prints, dtype="int64")


def wide_pivots(count: int = WIDE_PIVOTS) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)) for i in range(count)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("bigint")))


def pivot_table(prints: DataFrame) -> DataFrame:
    """``fp`` with its packed distances to the wide pivots and one row per join key."""
    fp = F.col("fp")
    blocks = 64 // BLOCK_BITS
    zero = _distance(fp, 0)
    # ones in a block = (bits in the block + distance to zero - distance to the block) / 2
    ones = [
        F.shiftright(zero + BLOCK_BITS - _distance(fp, _signed(((1 << BLOCK_BITS) - 1) << (b * BLOCK_BITS))), 1)
        for b in range(blocks)
    ]
    own = blocks // QUARTERS
    base = BLOCK_BITS + 1

    def quarter(q: int) -> Column:
        return reduce(lambda total, w: total * base + w, ones[q * own : (q + 1) * own])

    table = prints.select("fp", *[quarter(q).alias(f"_q{q}") for q in range(QUARTERS)])
    keys = [
        (F.col(f"_q{a}").cast("bigint") * base**own + F.col(f"_q{b}")) * 8 + n
        for n, (a, b) in enumerate(combinations(range(QUARTERS), 2))
    ]
    pivots = wide_pivots()
    packed = [
        reduce(
            lambda total, p: F.shiftleft(total, 7).bitwiseOR(_distance(fp, p).cast("bigint")),
            pivots[at : at + 9],
            F.lit(0).cast("bigint"),
        ).alias(f"wide{at // 9}")
        for at in range(0, len(pivots), 9)
    ]
    return table.select("fp", *packed, F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints at most ``RADIUS`` bits apart."""
    left = pivot_table(prints)
    right = left.select([F.col(c).alias(f"r_{c}") for c in left.columns])

    def coordinate(packed: str, at: int) -> Column:
        return F.shiftright(packed, 7 * at).bitwiseAND(F.lit(127))

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("r_fp"))) <= RADIUS
    differences = [
        F.abs(coordinate(f"wide{w}", at) - coordinate(f"r_wide{w}", at)) <= RADIUS
        for w in range((WIDE_PIVOTS + 8) // 9)
        for at in range(min(9, WIDE_PIVOTS - 9 * w))
    ]
    condition = (
        (F.col("key") == F.col("r_key"))
        & (F.col("fp") < F.col("r_fp"))
        & reduce(lambda x, y: x & y, differences)
        & near
    )
    return left.join(right, condition).select(F.col("fp").alias("a"), F.col("r_fp").alias("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) but the smallest of its component."""
    # pairs as (high, low); both steps keep components and end at stars
    edges = stage_table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links"
    )
    before = None
    while True:
        seen = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 65536).alias("s")
        ).first()
        if seen["n"] == 0 or seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = stage_table(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stage_table(small, "small-star")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per row of ``docs``.

    ``n_links``: other distinct fingerprints linked to this one.
    """
    small_batches(docs.sparkSession)
    fp = F.pandas_udf(_fingerprints, "bigint")
    marked = stage_table(
        docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp")), "fingerprints"
    )
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = stage_table(links(prints.select("fp")), "near-pairs")
    degrees = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    )
    classed = (
        prints.join(stars(pairs).withColumnRenamed("node", "fp"), "fp", "left")
        .join(degrees, "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    names = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classed.join(names, "root").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )
