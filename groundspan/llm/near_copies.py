"""Near copies by the Jaccard similarity of word shingles.

Texts are near copies if the sets of their ``SHINGLE``-word shingles (ASCII case
and white space aside) have a Jaccard similarity of ``SIMILARITY`` or more; a
group is what chains of near copies link.

* ``BANDS`` keys of ``ROWS`` min-hashes each bring texts together. Two texts of
  similarity s share a key with probability ``1 - (1 - s**ROWS)**BANDS``:
  0.99997 at 0.8, more above. At that similarity some ten of 64 bits of a
  SimHash differ, which no join key on its bits finds.
* Every pair that is linked has been verified on the shingles themselves.
* First each text is compared with the first one of each of its keys, so a large
  group costs as many comparisons as it has members. Then pairs that share a key
  and are still in different groups are compared, all of them: inside the join by
  ``ODD`` parity bits, of which no more can differ than shingles do, so this loses
  no link; the pairs that are left then by their shingles.
* With ``by_simhash`` the components of ``simhash`` are groups from the start:
  texts are linked by their fingerprints or by their shingles.

Cases: texts of the same words are one text here, null and empty ones too.
Fewer words than a shingle: the whole sequence is one shingle. A null id is
never the name of a group.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from groundspan.llm import simhash
from groundspan.llm.simhash import SEED, stars
from groundspan.llm.tables import chunks, clean, small_batches
from groundspan.staging import join_checked, stage_table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
SHINGLES_AT_ONCE = 1 << 13
CACHED_WORDS = 200_000
KEPT_SETS = 16
ODD_BITS = 11
ODD = 1 << ODD_BITS
SKETCH = "cls binary, n bigint, bands array<bigint>, odd array<bigint>, fp bigint"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_DRAWN = np.array([xxhash.xxh64_intdigest(b"min-hash %d" % i, SEED) for i in range(2 * BANDS * ROWS)], np.uint64)
_TIMES, _PLUS = _DRAWN[: BANDS * ROWS, None] | np.uint64(1), _DRAWN[BANDS * ROWS :, None]


def sketch(words: list[bytes], hashes: dict[bytes, int], shingle: int) -> tuple[int, list[int], list[int]]:
    """(different shingles, the keys of the bands, for each of ``ODD`` classes of shingles whether
    their number is odd, as bits); a text without words has no keys."""
    if not words:
        return 0, [], [0] * (ODD // 64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    last = len(each) - size + 1
    rolled = np.full(last, size, np.uint64)
    for k in range(size):
        rolled = _mixed(rolled + each[k : k + last])
    own = np.unique(rolled)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), SHINGLES_AT_ONCE):
        part = own[at : at + SHINGLES_AT_ONCE]
        least = np.minimum(least, (part * _TIMES + _PLUS).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + column)
    odd = np.bincount((own >> np.uint64(64 - ODD_BITS)).astype(np.int64), minlength=ODD) & 1
    return len(own), keys.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sketches(shingle: int, by_simhash: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            texts = clean(batch)
            rows = []
            for part in chunks(texts):
                for text in texts[part]:
                    words = words_of(text)
                    fp = simhash.signed_fingerprint(text) if by_simhash else 0
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words)), *sketch(words, hashes, shingle), fp))
            yield pd.DataFrame(rows, columns=["cls", "n", "bands", "odd", "fp"])

    return run


def shingles(text: str, shingle: int = SHINGLE) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a: set, b: set, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is high enough."""
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(shingle: int, similarity: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kept: OrderedDict[str, set] = OrderedDict()

        def of(text: str) -> set:
            if text not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.popitem(last=False)
                kept[text] = shingles(text, shingle)
            kept.move_to_end(text)
            return kept[text]

        for left, right in batches:
            yield pd.Series(
                [alike(of(a), of(b), similarity) for a, b in zip(clean(left), clean(right))], dtype=bool
            )

    return run


def _sizes_allow(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9


def _odd_allow(a: str, b: str, similarity: float) -> Column:
    """Whether sets of ``n`` shingles can be alike: their parity bits differ no oftener than alike sets may."""
    each = F.zip_with(f"{a}.odd", f"{b}.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(each, F.lit(0), lambda total, bits: total + bits)
    return differing <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _simhash_links(classes: DataFrame) -> DataFrame:
    """(a, b): classes with the first one of their component of fingerprints."""
    pairs = stage_table(simhash.links(classes.select("fp").distinct()), "near-pairs")
    roots = stars(pairs).withColumnRenamed("node", "fp")
    placed = classes.select("cls", "fp").join(roots, "fp", "left").select("cls", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("cls").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    heads = stage_table(heads, "fingerprint-groups")
    return join_checked(placed, heads, "root", "inner", salt_by="cls").where("cls <> a").select("a", F.col("cls").alias("b"))


def near_copies(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    text: str = "text",
    doc_id: str = "doc_id",
    by_simhash: bool = False,
) -> DataFrame:
    """(doc_id, text_key, group, component_id): one row per row of ``docs``.

    ``text_key`` is the text's xxhash64, ``component_id`` the smallest id of the group.
    """
    small_batches(docs.sparkSession)
    sketched = F.pandas_udf(_sketches(shingle, by_simhash), SKETCH)
    verified = F.pandas_udf(_verified(shingle, similarity), "boolean")
    marked = stage_table(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), sketched(F.col(text)).alias("s")
        ).select("doc_id", "text_key", "s.*"),
        "sketches",
    )
    classes = stage_table(
        marked.groupBy("cls").agg(
            F.min("doc_id").alias("first"),
            F.min("text_key").alias("text_key"),
            F.any_value("n").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("odd").alias("odd"),
            F.any_value("fp").alias("fp"),
        ),
        "copy-classes",
    )
    banded = classes.select("cls", "n", "text_key", F.explode("bands").alias("band"))
    one = F.struct("cls", "n", "text_key")
    shared = banded.groupBy("band").agg(F.min(one).alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = stage_table(shared, "shared-keys")
    members = stage_table(join_checked(banded, shared, "band", "inner", salt_by="cls"), "key-members")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of classes with their text keys ka and kb, those that are near copies."""
        pairs = stage_table(pairs, "copy-candidates")
        keys = pairs.select(F.explode(F.array("ka", "kb")).alias("k")).distinct()
        texts = docs.select(F.xxhash64(text).alias("k"), F.col(text).alias("t"))
        texts = stage_table(
            join_checked(texts, keys, "k", "left_semi", salt_by="t").groupBy("k").agg(F.any_value("t").alias("t")),
            "candidate-texts",
        )
        left = texts.select(F.col("k").alias("ka"), F.col("t").alias("ta"))
        right = texts.select(F.col("k").alias("kb"), F.col("t").alias("tb"))
        both = pairs.join(left, "ka").join(right, "kb")
        return stage_table(both.where(verified("ta", "tb")).select("a", "b"), "copy-links")

    first = members.where(F.col("cls") != F.col("m.cls")).where(_sizes_allow(F.col("n"), F.col("m.n"), similarity))
    first = first.select(
        F.col("m.cls").alias("a"), F.col("cls").alias("b"), F.col("m.text_key").alias("ka"), F.col("text_key").alias("kb")
    ).distinct()
    links = linked(first)
    if by_simhash:
        links = stage_table(links.unionByName(_simhash_links(classes)), "first-links")
    roots = stars(links).select(F.col("node").alias("cls"), "root")
    placed = stage_table(
        members.join(roots, "cls", "left").select(
            "band", "cls", "n", "text_key", F.coalesce("root", "cls").alias("root"), F.col("m.cls").alias("m")
        ),
        "placed-members",
    )
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rest = join_checked(placed, split.select("band"), "band", "left_semi", salt_by="cls")
    rest = stage_table(rest.join(classes.select("cls", "odd"), "cls"), "split-keys")
    a, b = rest.alias("a"), rest.alias("b")
    # neither is the first of the key: those pairs have been compared
    across = (
        a.join(b, F.col("a.band") == F.col("b.band"))
        .where("a.cls < b.cls and a.root <> b.root and a.cls <> a.m and b.cls <> b.m")
        .where(_sizes_allow(F.col("a.n"), F.col("b.n"), similarity))
        .where(_odd_allow("a", "b", similarity))
        .select(
            F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.text_key").alias("ka"), F.col("b.text_key").alias("kb")
        )
        .distinct()
    )
    links = links.unionByName(linked(across))
    grouped = classes.join(stars(links).withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "first", F.coalesce("root", "cls").alias("group")
    )
    names = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    named = stage_table(grouped.join(names, "group").select("cls", "group", "component_id"), "copy-groups")
    return marked.select("doc_id", "text_key", "cls").join(named, "cls").select(
        "doc_id", "text_key", "group", "component_id"
    )
