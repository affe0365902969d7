"""Token counts that follow edits.

A document's pre-tokens stand in runs of ``LEAF``, at most twice as many after edits,
the leaves of a segment tree whose nodes hold the characters and tokens below them. An edit finds its
leaf by characters, cuts the pre-tokens it touches again together with their
boundary context, takes in old pre-tokens until old and new boundaries meet, and
updates the sums on the paths to the touched leaves. The rest is not read.

The pattern looks at most two characters past the end of a pre-token, so cutting
starts at the pre-token ``CONTEXT`` characters before the edit, and a boundary
counts as met only ``CONTEXT`` characters before the end of what was taken in,
or at the end of the text.

Cases: a null text counts as empty, null edits as none, a null insertion as an
empty one. An edit that begins or reaches beyond the text is cut to it; negative
places and lengths count as 0. Edits apply in their order, each to the text that
the ones before it left. Repeated rows are counted alike. Results replace
columns of their names.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache
from typing import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from groundspan.llm.tables import clean, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, CONTEXT = 32, 3
CACHED = 200_000


class TokenCounter:
    """Token counts of pre-tokens, kept for the worker's life."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            n = self.known[token] = len(self.encoding.encode_ordinary(token))
        return n


class TokenTree:
    def __init__(self, text: str, counter: TokenCounter):
        self.counter = counter
        tokens = counter.cut.findall(text)
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.build([(sum(map(len, leaf)), sum(map(counter.count, leaf))) for leaf in self.leaves])
        self.recut = 0  # characters cut again by edits

    def build(self, sums: list[tuple[int, int]]) -> None:
        """The nodes over leaves of these characters and tokens."""
        self.width = 1
        while self.width < len(sums):
            self.width *= 2
        empty = [0] * (self.width - len(sums))
        self.chars = [0] * self.width + [c for c, _ in sums] + empty
        self.tokens = [0] * self.width + [t for _, t in sums] + empty
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, index in it, first character) of the pre-token over a character."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        leaf = node - self.width
        for i, token in enumerate(self.leaves[leaf]):
            if place < begin + len(token) or i + 1 == len(self.leaves[leaf]):
                return leaf, i, begin
            begin += len(token)
        return leaf, 0, begin

    def put(self, leaf: int, tokens: list[str]) -> None:
        self.leaves[leaf] = tokens
        node = self.width + leaf
        self.chars[node] = sum(map(len, tokens))
        self.tokens[node] = sum(map(self.counter.count, tokens))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        total = self.chars[1]
        start = min(max(start, 0), total)
        removed = min(max(removed, 0), total - start)
        leaf, index, begin = self.find(max(start - CONTEXT, 0))
        # old pre-tokens from the first one that is cut again
        old: list[str] = list(self.leaves[leaf][index:])
        upto, taken = leaf, sum(map(len, old))  # leaves and characters taken in
        ahead = CONTEXT * 4
        while True:
            while taken < start - begin + removed + ahead and upto + 1 < len(self.leaves):
                upto += 1
                old += self.leaves[upto]
                taken += self.chars[self.width + upto]
            whole = upto + 1 == len(self.leaves)
            source = "".join(old)
            fresh = source[: start - begin] + inserted + source[start - begin + removed :]
            shift = len(inserted) - removed
            bounds, at = {}, 0
            for i, token in enumerate(old):
                bounds[at] = i
                at += len(token)
            new, end, meet = [], 0, None
            for m in self.counter.cut.finditer(fresh):
                new.append(m.group())
                end = m.end()
                if end >= start - begin + len(inserted) and end - shift in bounds and end <= len(fresh) - CONTEXT:
                    meet = bounds[end - shift]
                    break
            if meet is not None or whole:
                break
            ahead *= 4
        self.recut += end
        rest = old[meet:] if meet is not None else []
        kept = self.leaves[leaf][:index] + new
        if upto == leaf:
            self.put(leaf, kept + rest)
            self.split(leaf)
            return
        # what is left of the last leaf stays there; leaves in between are empty now
        last = self.leaves[upto]
        tail = rest[-len(last) :] if last and len(rest) >= len(last) else rest
        self.put(leaf, kept + rest[: len(rest) - len(tail)])
        for between in range(leaf + 1, upto):
            self.put(between, [])
        self.put(upto, tail)
        self.split(leaf)

    def split(self, leaf: int) -> None:
        """Cut a leaf over twice ``LEAF`` into leaves of ``LEAF``, and drop empty ones.

        Only sums are set anew for the other leaves, and this many pre-tokens have come
        in since the last time.
        """
        tokens = self.leaves[leaf]
        if len(tokens) <= 2 * LEAF:
            return
        sums = [(self.chars[self.width + i], self.tokens[self.width + i]) for i in range(len(self.leaves))]
        parts = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)]
        self.leaves[leaf : leaf + 1] = parts
        sums[leaf : leaf + 1] = [(sum(map(len, p)), sum(map(self.counter.count, p))) for p in parts]
        held = [i for i, own in enumerate(self.leaves) if own]
        self.leaves = [self.leaves[i] for i in held]
        self.build([sums[i] for i in held])


@cache
def counter(path: str) -> TokenCounter:
    """One counter per worker process."""
    return TokenCounter(path)


EDIT = "struct<start: bigint, removed: bigint, inserted: string>"
RESULT = (
    "n_pretokens bigint, n_tokens bigint, n_tokens_edited bigint, n_chars_edited bigint, "
    "recut_chars bigint, edited_crc32 bigint"
)


def count_edited(docs: DataFrame, edits: str = "edits", text: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with the columns of ``RESULT``; ``edits`` is an array of ``EDIT``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        names = [part.split()[0] for part in RESULT.split(", ")]
        for batch, steps in batches:
            rows = []
            for t, script in zip(clean(batch), steps):
                tree = TokenTree(t, own)
                row = [sum(map(len, tree.leaves)), tree.tokens[1]]
                for e in [] if script is None else script:
                    tree.edit(int(e["start"] or 0), int(e["removed"] or 0), e["inserted"] or "")
                crc = zlib.crc32(tree.text().encode("utf-8", "surrogatepass"))
                rows.append([*row, tree.tokens[1], tree.chars[1], tree.recut, crc])
            yield pd.DataFrame(rows, columns=names, dtype="int64")

    small_batches(docs.sparkSession)
    udf = F.pandas_udf(run, RESULT)
    names = [part.split()[0] for part in RESULT.split(", ")]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    held = docs.select(F.struct(*others).alias("row"), udf(F.col(text), F.col(edits)).alias("counted"))
    return held.select("row.*", *[f"counted.{n}" for n in names])


def revisions(docs: DataFrame, count: int = 3) -> DataFrame:
    """``docs`` with ``count`` edits each, drawn from its id: a few characters give way
    to a passage from elsewhere in the same text."""
    size = F.length(F.coalesce("text", F.lit("")))

    def drawn(what: str, i: int, upto):
        return F.pmod(F.xxhash64(F.lit(what), F.lit(i), "doc_id"), upto)

    def edit(i: int):
        passage = F.substring(
            F.coalesce("text", F.lit("")), drawn("from", i, size + 1) + 1, drawn("length", i, F.lit(40))
        )
        return F.struct(
            drawn("start", i, size + 1).alias("start"),
            drawn("removed", i, F.lit(24)).alias("removed"),
            passage.alias("inserted"),
        )

    return docs.withColumn("edits", F.array(*[edit(i) for i in range(count)]).cast(f"array<{EDIT}>"))


def edit_count_query(docs: DataFrame, path: str = RANKS) -> DataFrame:
    counted = count_edited(revisions(docs.select("doc_id", "text")), path=path)
    return counted.drop("text", "edits")
