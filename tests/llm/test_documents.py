"""SimHash, shards, decontamination and licence scans against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from groundspan.llm import decontamination, license_scan, minimax_shards, simhash
from groundspan.llm.tables import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, words int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """Nulls, empty and long texts, copies, repeated rows, marks of all kinds."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from home today again"
    texts = [None, "", "  \n\t", "Word", "two Words", base, base, base.upper(), base + " x", LONG, "ÉÀ é 　 ß", "\x00 a\x7fb 🙂 c", None]
    rows = [(i, t, "en", "s", 1, "x", 2) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    names = sorted(set(prints.values()))
    root = {p: p for p in names}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {i: min(j for j, q in prints.items() if find(q) == find(p)) for i, p in prints.items()}


def test_simhash_equals_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    classes = plain_components(prints)
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == classes


def test_simhash_links_lose_nothing(spark):
    """Chains and dense balls of fingerprints, the extremes included."""
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(15):
            prints.add(p)
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints |= {p ^ (1 << b) for b in range(0, 64, 5)}
    want = {(a, b) for a in prints for b in prints if simhash._signed(a) < simhash._signed(b) and (a ^ b).bit_count() <= 2}
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    found = simhash.links(rows)
    mask = (1 << 64) - 1
    assert sorted((r["a"] & mask, r["b"] & mask) for r in found.collect()) == sorted(want)
    roots = {r["node"]: r["root"] for r in simhash.stars(found).collect()}
    for a, b in want:
        a, b = simhash._signed(a), simhash._signed(b)
        assert roots.get(a, a) == roots.get(b, b)
    assert all(root < node for node, root in roots.items())


def test_simhash_odd_rows(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[0]["fingerprint"] == "0" * 16 and by_id[12]["component_id"] == 0
    assert by_id[6]["component_id"] == by_id[7]["component_id"] == 5
    assert by_id[9]["fingerprint"] == f"{plain_fingerprint(LONG):016x}"
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def plain_capacity(sizes, shards):
    def fits(capacity):
        used, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("kind", ["even", "heavy", "tiny", "few"])
def test_capacity_is_the_smallest(spark, kind):
    rng = random.Random(kind)
    sizes = {
        "even": [rng.randrange(1, 3000) for _ in range(3000)],
        "heavy": [rng.choice([1, 5, 200_000]) for _ in range(400)],
        "tiny": [1] * 1000,
        "few": [7, 300, 2],
    }[kind]
    rows = spark.createDataFrame([(f"{i:06d}", i, s) for i, s in enumerate(sizes)], "k string, t bigint, size bigint")
    placed, capacity = minimax_shards.contiguous_shards(rows, "k", "t", "size", 16)
    assert capacity == plain_capacity(sizes, 16)
    found = placed.orderBy("t").collect()
    shards = [r["shard"] for r in found]
    assert shards == sorted(shards) and len(found) == len(sizes)
    for shard in set(shards):
        own = [r for r in found if r["shard"] == shard]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert sum(r["size"] for r in own) <= capacity


def test_sharding_odd_rows(spark, odd):
    found = minimax_shards.sharding_query(odd).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r["doc_id"] is None:
            continue
        raw = (odd_rows()[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    one_shard = {}
    for r in found:
        assert one_shard.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    assert minimax_shards.sharding_query(odd.limit(0)).count() == 0


def plain_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, found = set(), set()
    for item, words_of_item in items:
        size = min(13, len(words_of_item))
        for i in range(len(words_of_item) - size + 1) if size else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == words_of_item[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
    ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [500_000, 3])
def test_decontamination_odd_rows(spark, odd, limit, monkeypatch):
    """Also in slices of three rows."""
    monkeypatch.setattr(decontamination.decontaminate, "__defaults__", (13, limit))
    items = [(1, "The quick brown FOX jumps over the lazy dog and runs far away from home"), (2, "Word"), (3, "words two"), (4, "two words"), (5, None), (6, "..."), (7, "Word"), (10, "É"), (None, "b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plain = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))) for i, t in items if i is not None]
    found = decontamination.decontamination_query(odd, bench).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r["doc_id"] in (None, 11):
            continue
        assert tuple(r)[1:] == plain_hits(odd_rows()[r["doc_id"]][1], plain), r
    assert decontamination.decontamination_query(odd, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontamination.decontamination_query(odd.limit(0), bench).count() == 0


def test_decontamination_is_native(spark, sf, capsys):
    q = decontamination.decontamination_query(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    q.explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    out = []
    for notice in license_scan.BASE_NOTICES:
        own = notice.phrase.split()
        out += [(i, notice.label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return len(words), sorted(out)


@pytest.mark.parametrize("source", ["table", "made"])
def test_license_base_places(spark, sf, odd, source):
    docs = table(spark, sf, "documents") if source == "table" else odd.unionByName(
        spark.createDataFrame(
            [(50, "Apache-License, the MIT license! CC BY cc by cc by", *[None] * 5), (51, "mit license mit license apache license mit license", *[None] * 5), (52, "É GNU General Public License\x7fapache licensed emit license", *[None] * 5)],
            DOCS,
        )
    )
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for r in license_scan.license_query(docs).where("doc_id is not null").collect():
        n, places = plain_base(texts[r["doc_id"]])
        starts = [p[0] for p in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places)), texts[r["doc_id"]]
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_edits(spark):
    _, places = license_scan.scan("Licensed under the GNU Genral Publik License, v3")
    assert [p[:5] for p in places] == [("gpl", False, 3, 4, 2)]
    assert license_scan.scan("gnu gene publi licen")[1] == []
    _, places = license_scan.scan("apache licence and apache license")
    assert [(p[0], p[1], p[2], p[4]) for p in places] == [("apache", False, 0, 1), ("apache", True, 3, 0)]
