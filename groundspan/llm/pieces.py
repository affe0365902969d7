"""SentencePiece encoding with forward scores shared along a trie of words.

White space is marked (``▁``) and a mark is put in front of the text; no piece
has a mark inside, so marked words are encoded by themselves. Per batch the
distinct marked words are sorted, which puts them in the depth-first order of
their trie; going from one word to the next keeps the forward state of every
prefix they share and only works out the rest.

The public model file is a BPE model. Its best path is not the one with the
largest sum of scores, so the forward step admits only the pieces that byte-pair
merging can leave next to each other: two neighbours are admissible if merging
their joined text gives back just these two. A prefix has exactly one admissible
piece at its end, the one its merging leaves there. This gives the ids of the
public library; ``merged`` is the plain merging that defines admissibility.

A unigram vocabulary is another matter: there the best path is the one with the
largest sum, and ``best_paths`` finds it by the same walk with summed forward
scores, which sorted words share along their common prefixes.

Characters outside the vocabulary become their UTF-8 bytes' pieces.

Cases: a null or empty text has no ids. Only a text that holds the mark itself
does not come back (it comes back with spaces); ``round_trip`` says so. Repeated
rows are encoded alike. Results replace columns of their names.
"""

from __future__ import annotations

import math
import re
from functools import cache
from itertools import chain
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from groundspan.llm.tables import chunks, clean, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")
# what a unigram path pays for a character outside the vocabulary, under the lowest score
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
CACHED_PAIRS = 500_000


def marked_words(text: str) -> list[str]:
    """The words of the marked text, each without its first mark."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [unit[1:] for unit in _UNITS.findall(MARK + text.replace(" ", MARK))]


def by_ending(pieces: Iterable[str]) -> tuple[dict, str | None]:
    """The pieces read from their ends: a node holds its next characters and its piece."""
    root: tuple[dict, str | None] = ({}, None)
    for piece in pieces:
        children = root[0]
        for char in reversed(piece[1:]):
            node = children.get(char)
            if node is None:
                node = children[char] = ({}, None)
            children = node[0]
        children[piece[0]] = (children.get(piece[0], ({}, None))[0], piece)
    return root


def best_paths(words: Iterable[str], scores: dict[str, float]) -> dict[str, tuple[float, list[str]]]:
    """(sum, pieces) with the largest sum of scores for each of the words, by a unigram vocabulary.

    A character without a piece of its own is one by itself, at ``UNKNOWN_PENALTY``
    under the lowest score. Of equal sums the path with the longer last piece stays.
    An empty word has no pieces; an empty vocabulary leaves single characters.
    """
    endings = by_ending(scores)[0]
    unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    forward: list[tuple[float, str]] = [(0.0, "")]  # the best sum of each prefix of ``path`` and its last piece
    path, found = "", {}
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, last = -math.inf, ""
            if word[end - 1] not in scores:
                best, last = forward[end - 1][0] + unknown, word[end - 1]
            at, children = end, endings
            while at:
                at -= 1
                node = children.get(word[at])
                if node is None:
                    break
                children, piece = node
                if piece is not None and forward[at][0] + scores[piece] >= best:
                    best, last = forward[at][0] + scores[piece], piece
            forward.append((best, last))
        path, back, end = word, [], len(word)
        while end:
            back.append(forward[end][1])
            end -= len(back[-1])
        found[word] = forward[-1][0], back[::-1]
    return found


class PieceModel:
    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.vocab_size()
        plain = [i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.ids = {own.id_to_piece(i): i for i in plain}
        self.scores = {own.id_to_piece(i): own.get_score(i) for i in plain}
        self.byte_ids = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
        self.raw = [b""] * size
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        self.endings = by_ending(self.ids)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has white space inside; words cannot be encoded apart")
        self.pairs: dict[tuple[str, str], bool] = {}
        # ids of four bytes each, of words met lately and of those met before them
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain byte-pair merging: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, before: str, piece: str) -> bool:
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.merged(before + piece) == [p for p in (before, piece) if p]
            self.pairs[before, piece] = known
        return known

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of every word (without its first mark) into ``words``.

        Prefixes shared in sorted order are worked out once.
        """
        last: list[str] = [""]  # the piece at the end of each prefix of ``path``
        path, endings, pairs = "", self.endings[0], self.pairs
        for plain in sorted(words):
            word = MARK + plain
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at, children, fits = end, endings, []
                while at:
                    at -= 1
                    node = children.get(word[at])
                    if node is None:
                        break
                    children, piece = node
                    if piece is not None:
                        fits.append((last[at], piece))
                chosen = word[end - 1]  # a character outside the vocabulary
                for pair in reversed(fits):
                    known = pairs.get(pair)
                    if known or known is None and self.admissible(*pair):
                        chosen = pair[1]  # the only one: merging has one result
                        break
                last.append(chosen)
            path = word
            found, end = [], len(word)
            while end:
                piece = last[end]
                found.append(piece)
                end -= len(piece)
            ids = self.ids
            self.words[plain] = np.array(
                [i for p in reversed(found) for i in ((ids[p],) if p in ids else self.bytes_of(p))],
                np.int32,
            ).tobytes()

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [found.tolist() for found in self.id_arrays(texts)]

    def id_arrays(self, texts: list[str]) -> list[np.ndarray]:
        units = [marked_words(t) for t in texts]
        distinct = set(chain.from_iterable(units))
        new = distinct - self.words.keys()
        if len(self.words) + len(new) > CACHED_WORDS // 2:
            self.older, self.words = self.words, {}
            new = distinct
        known = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        self.encode_words(list(new - known))
        of = self.words.__getitem__
        return [np.frombuffer(b"".join(map(of, own)), np.int32) for own in units]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@cache
def model(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)


def encode_texts(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model(path)
        for batch in batches:
            texts = clean(batch)
            ids, same = [], []
            for part in chunks(texts):
                for t, found in zip(texts[part], own.id_arrays(texts[part])):
                    ids.append(found)
                    same.append(own.decode(found.tolist()) == t)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "n": [len(i) for i in ids], "same": pd.Series(same, dtype=bool)})

    small_batches(docs.sparkSession)
    udf = F.pandas_udf(run, "ids array<int>, n int, same boolean")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {"ids", "n_tokens", "round_trip"}]
    held = docs.select(F.struct(*others).alias("row"), udf(F.col(text)).alias("pieces"))
    return held.select(
        "row.*", "pieces.ids", F.col("pieces.n").alias("n_tokens"), F.col("pieces.same").alias("round_trip")
    )


def decode_ids(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(path)
        for batch in batches:
            yield pd.Series([own.decode([] if i is None else list(i)) for i in batch], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))


def pieces_query(docs: DataFrame, path: str = MODEL) -> DataFrame:
    return encode_texts(docs.select("doc_id", "text"), path=path).select("doc_id", "n_tokens", "ids", "round_trip")
