"""Benchmark decontamination as a prefix-filtered set join.

Every run of ``WINDOW`` consecutive item words is a window; a shorter item is
one window. A document that contains a window contains its rarest token, so the
prefix that containment needs has one token: that of the word which occurs least
in all documents. Neighbouring windows mostly share it. Where a document has the
token, it places the item along the document (a diagonal), and with it each
window that chose the token; a window must fit in front (position) and behind
(length). What fits is verified on the words themselves.

Documents are exploded word by word, in narrow rows and without a shuffle,
against tables made from the benchmark. Those are broadcast in slices of a
checked number of rows, one pass over the documents for each slice. Tokens fold
case beyond A-Z too, which can only add candidates. The candidates of a document
then join its text once, where they are verified and their words counted.

Cases: a null text, or one without words, has no words and no hits and is clean.
Items without words have no windows; equal items count each by its id; a null
item id is left out of the item list. Repeated rows are judged alike, rows of
one id with different texts each by their own text. Results carry only their
own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundspan.staging import BROADCAST_ROWS, stage_table

WINDOW = 13
# All of ASCII but letters and digits stands between words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BETWEEN_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in its own case."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BETWEEN))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, BETWEEN_RUN, -1))


def joined(words: Column) -> Column:
    """Words as one string, A-Z lowered; words have no spaces."""
    return F.translate(F.array_join(words, " "), _UPPER, _LOWER)


def tokens_of(text: Column) -> Column:
    """The words of a text for joining: case is folded, places are those of ``words_of``."""
    return words_of(F.lower(text))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, at, size, window, tokens, ids): each window of each different item text."""
    words = (
        items.select(F.col("item_id").cast("string").alias("id"), words_of(F.col("text")).alias("words"))
        .where("size(words) > 0")
        .groupBy(joined(F.col("words")).alias("item"))
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumn("words", F.split("item", " "))
    )
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = words.select("item", "ids", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    own = F.slice("words", F.col("at") + 1, window)
    return cut.select(
        "item", "ids", "at", F.size(own).alias("size"), F.array_join(own, " ").alias("window"), F.transform(own, lambda w: F.lower(w)).alias("tokens")
    )


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, at, token): a narrow row for each word of each document."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), tokens_of(F.col("text")).alias("words"))
    # the count first: beside the explode it would carry the array along in every row
    counted = words.select("doc_id", "text_key", F.size("words").alias("n"), "words")
    # the plain explode would have Spark filter out empty arrays first, and cut every text once more to do so
    return counted.select("doc_id", "text_key", "n", F.posexplode_outer("words").alias("at", "token")).where("token is not null")


def in_slices(rows: DataFrame, by: str, limit: int) -> list[DataFrame]:
    """``rows`` as tables of at most about ``limit`` rows each."""
    slices = -(-rows.count() // limit)
    if slices <= 1:
        return [rows] * slices
    return [rows.where(F.pmod(F.xxhash64(by), F.lit(slices)) == i) for i in range(slices)]


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def candidates(docs: DataFrame, windows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """(doc_id, text_key, places): where windows may stand, by their rarest token.

    None if there are no windows or no document has a token of theirs.
    """
    spots = positions(docs)
    tokens = windows.select("item", "at", "size", "window", "ids", F.posexplode("tokens").alias("offset", "token"))
    known = stage_table(tokens.select("token").distinct(), "benchmark-tokens")
    counted = [
        spots.select("token").join(F.broadcast(part), "token").groupBy("token").agg(F.count("*").alias("frequency"))
        for part in in_slices(known, "token", limit)
    ]
    if not counted:
        return None
    # a token that no document has keeps its windows out
    rarest = stage_table(
        tokens.join(stage_table(united(counted), "token-frequency"), "token")
        .groupBy("item", "at", "size", "window", "ids")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("token", "offset"), F.struct("frequency", "offset")).alias("p"))
        .where("n = size")
        .select("item", "ids", "size", "window", "at", F.col("p.token").alias("token"), F.col("p.offset").alias("offset")),
        "window-prefixes",
    )
    # windows that share a token of the item at the same place meet a document together
    anchors = stage_table(
        rarest.groupBy("item", "ids", "token", (F.col("at") + F.col("offset")).alias("anchor")).agg(
            F.collect_list(F.struct((-F.col("offset")).alias("shift"), "size", "window")).alias("windows")
        ),
        "anchors",
    )
    start = F.col("at") + F.col("w.shift")
    found = [
        spots.join(F.broadcast(part), "token")
        .select("doc_id", "text_key", "n", "at", "ids", F.explode("windows").alias("w"))
        .where((start >= 0) & (start + F.col("w.size") <= F.col("n")))
        .select("doc_id", "text_key", F.struct(start.alias("start"), F.col("w.size").alias("size"), F.col("w.window").alias("window"), "ids").alias("place"))
        for part in in_slices(anchors, "token", limit)
    ]
    if not found:
        return None
    return united(found).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, contaminated) for each row of ``docs``."""
    windows = stage_table(windows_of(items, window), "windows")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = candidates(docs, windows, limit)
    if found is None:
        joined_rows = own.withColumn("places", F.expr("cast(null as array<struct<start: int, size: int, window: string, ids: array<string>>>)"))
    else:
        found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "places")
        joined_rows = own.join(
            found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
        )
    rows = joined_rows.select("doc_id", "text_key", "places", words_of(F.col("text")).alias("words"))
    true = F.filter(
        "places", lambda p: joined(F.slice("words", p["start"] + 1, p["size"])) == p["window"]
    )
    rows = rows.select(
        "doc_id",
        "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        F.array_sort(F.coalesce(true, F.expr("cast(array() as array<struct<start: int, size: int, window: string, ids: array<string>>>)"))).alias("hits"),
    )
    # words under the union of the hits, which stand in the order of their starts
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda seen, h: F.struct(
            (seen["n"] + F.greatest(h["start"] + h["size"] - F.greatest(h["start"], seen["end"]), F.lit(0))).alias("n"),
            F.greatest(seen["end"], h["start"] + h["size"]).alias("end"),
        ),
    )
    judged = rows.select(
        "doc_id",
        "text_key",
        "n_words",
        covered["n"].cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"])))).alias("items"),
    )
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontamination_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


# DuckDB: the plain join of every 13-word run with every window.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, hash(text) AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), n AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 13], ' ') AS gram, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM n),
g AS (
  SELECT doc_id, k, size, i, array_to_string(w[i + 1 : i + size], ' ') AS gram
  FROM (SELECT doc_id, k, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (SELECT DISTINCT doc_id, k, item_id, i, g.size FROM g JOIN n ON g.gram = n.gram AND g.size = n.size),
hit AS (
  SELECT doc_id, k, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, k, unnest(range(i, i + size)) AS p FROM m) GROUP BY ALL
), its AS (
  SELECT doc_id, k, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, k, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY ALL
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id IS NOT DISTINCT FROM d.doc_id AND hit.k IS NOT DISTINCT FROM d.k
LEFT JOIN its ON its.doc_id IS NOT DISTINCT FROM d.doc_id AND its.k IS NOT DISTINCT FROM d.k
"""
