"""URL rules and lists behind a blocked Bloom filter.

Everything listed is a key: a rule is its host and path prefix, a listed page its
canonical URL. The keys' hashes fill a blocked Bloom filter, built by a Spark
aggregation: one 512-bit block a key, a bit in each of its eight words. A url has
a fixed number of possible keys; those the filter passes go to an exact hash
join, which removes false positives. The filter has at most ``MAX_BLOCKS``
blocks (8 MB) whatever is listed; beyond some four million keys it passes more
false hits, and results stay exact.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is not listed. Equal urls are judged once and repeated rows alike.
A url that fits no rule is blocked if its canonical form is listed, else
allowed. Of equally long rules the one that sorts first wins. Results carry only
their own columns.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.staging import join_checked, stage_table

# Host and path prefix of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Query parameters that do not change the page.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid".split()
BITS_PER_KEY, BLOCK_BITS, WORDS = 16, 512, 8
MAX_BLOCKS = 1 << 17


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path and sorted query without scheme, default port, last slash, tracking or fragment."""
    query = F.split(F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(
        F.filter(query, lambda p: (p != "") & ~F.split(p, "=")[0].isin(TRACKING))
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.coalesce(tail, F.lit("")))


def entries_of(spark: SparkSession, rules, listed: DataFrame | None) -> DataFrame:
    """(key, kind, verdict): all that the filter must pass. ``listed``: column ``url``."""
    own = spark.createDataFrame(
        [(f"{host}{path}", "rule", verdict) for verdict, host, path in rules], "key string, kind string, verdict string"
    )
    if listed is None:
        return own
    pages = listed.select(canonical(F.col("url")).alias("key")).where("key != ''").distinct()
    return own.unionByName(pages.select("key", F.lit("page").alias("kind"), F.lit("block").alias("verdict")))


class BlockedBloom:
    """``bits``: (blocks, 8) words of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        block = self.bits[first & (len(self.bits) - 1)]
        ok = np.ones(len(first), bool)
        for w in range(WORDS):
            ok &= (block[:, w] >> ((second >> (6 * w)) & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def build_filter(keys: DataFrame, total: int) -> BlockedBloom:
    """The filter of a table with ``key``; at most one row a block reaches the driver."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * BLOCK_BITS < total * BITS_PER_KEY:
        blocks *= 2
    second = F.xxhash64(F.lit("second"), "key")
    words = [
        F.bit_or(F.expr(f"shiftleft(1L, cast((shiftright(second, {6 * w}) & 63) as int))")).alias(f"w{w}")
        for w in range(WORDS)
    ]
    found = (
        keys.select(F.xxhash64("key").bitwiseAND(F.lit(blocks - 1)).alias("block"), second.alias("second"))
        .groupBy("block")
        .agg(*words)
        .toArrow()
    )
    bits = np.zeros((blocks, WORDS), np.uint64)
    at = found["block"].to_numpy()
    for w in range(WORDS):
        bits[at, w] = found[f"w{w}"].to_numpy().view(np.uint64)
    return BlockedBloom(bits)


def possible_keys(url: Column, rules) -> Column:
    """The host's ends and path beginnings of the lengths that rules have, and the canonical form."""
    labels = sorted({host.count(".") + 1 for _, host, _ in rules})
    lengths = sorted({len(path) for _, _, path in rules})
    parts, path = F.split(host_of(url), r"\."), path_of(url)
    ends = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in labels]
    keys = [
        F.when(F.length(path) >= n, F.concat(end, F.substring(path, 1, n))) for end in ends for n in lengths
    ]
    keyed = [F.struct(F.lit("rule").alias("kind"), k.alias("key")) for k in keys]
    return F.array(*keyed, F.struct(F.lit("page").alias("kind"), canonical(url).alias("key")))


def filter_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(url, rule, verdict, listed) for each distinct url of ``pages``."""
    spark = pages.sparkSession
    entries = stage_table(entries_of(spark, rules, listed), "url-entries")
    bloom = spark.sparkContext.broadcast(build_filter(entries, entries.count()))

    @F.pandas_udf("boolean")
    def may_hold(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in batches:
            yield pd.Series(bloom.value.may_hold(first.to_numpy(np.int64), second.to_numpy(np.int64)))

    urls = pages.select(F.col(url).alias("url")).distinct()
    hits = (
        urls.select("url", F.inline(possible_keys(F.col("url"), rules)))
        .where("key is not null and key != ''")
        .where(may_hold(F.xxhash64("key"), F.xxhash64(F.lit("second"), "key")))
    )
    exact = join_checked(hits, entries, ["key", "kind"], "inner", salt_by="url")
    rule = F.col("kind") == "rule"
    best = F.min_by(
        F.when(rule, F.struct("key", "verdict")),
        F.when(rule, F.struct((-F.length("key")).alias("n"), "key")),
    )
    judged = exact.groupBy("url").agg(best.alias("r"), F.coalesce(F.bool_or(~rule), F.lit(False)).alias("listed"))
    judged = judged.select(
        F.col("url").alias("_url"),
        F.col("r.key").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
    return (
        urls.join(judged, F.col("url") == F.col("_url"), "left")
        .drop("_url")
        .withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "listed": F.coalesce("listed", F.lit(False))})
    )


def url_query(pages: DataFrame) -> DataFrame:
    """The list is made of the table's own pages on hosts whose first label is ``spam-farm``."""
    listed = pages.select("url").where(host_of(F.col("url")).startswith("spam-farm."))
    judged = filter_urls(pages, RULES, listed).withColumnRenamed("url", "_url")
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", "verdict", "listed"
    )


ORACLE_SQL = r"""
WITH r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), best AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN starts_with(host, 'spam-farm.') THEN 'block' ELSE 'allow' END) AS verdict,
  starts_with(host, 'spam-farm.') AS listed
FROM u LEFT JOIN best USING (n)
"""
