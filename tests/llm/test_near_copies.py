"""The near-dedup stage against all pairs of five-word shingle sets."""

import random
from itertools import combinations

import corpus_pipeline
from groundspan.llm import near_copies, simhash
from groundspan.llm.tables import table

STAGE = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_groups(texts, similarity=0.8):
    """{id: smallest id of its group}, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both * 10 >= round(10 * similarity) * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    return group


def planted():
    """Texts of 30 to 300 words, copies with a few changed words, chains and a large group."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(30, 300))]
        texts.append(base)
        for changes in (1, 2, 3, 5):
            base = list(base)
            for _ in range(changes):
                base[rng.randrange(len(base))] = word()
            texts.append(base)
    hub = [word() for _ in range(80)]
    for _ in range(60):  # alike through the hub alone: a change in the middle alters five shingles
        copy = list(hub)
        copy[rng.randrange(10, 70)] = word()
        texts.append(copy)
    texts += [hub, ["a", "b"], ["A", " b"], ["a"] * 5, ["a"] * 9]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_stage_finds_near_copies(spark, sf):
    texts = planted()
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in texts.items()], ROW)
    want = plain_groups(texts)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == want and len(set(want.values())) < 200
    kept = STAGE(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_one_changed_word_of_a_hundred(spark, sf):
    words = [f"x{i * 7919 % 1009}" for i in range(100)]
    rows = [(1, " ".join(words)), *[(2 + i, " ".join([*words[:k], "other", *words[k + 1 :]])) for i, k in enumerate(range(20, 80, 10))]]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], ROW)
    assert [r["doc_id"] for r in STAGE(spark, docs, sf).collect()] == [1]


def test_stage_on_the_tables(spark, sf):
    docs = table(spark, sf, "documents")
    want = plain_groups({r["doc_id"]: r["text"] or "" for r in docs.collect()})
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_stage_odd_rows(spark, sf):
    rows = [(3, None), (4, ""), (4, ""), (None, None), (None, "a b c d e f g"), (6, "a b c d e f g"), (7, "A  b c d e f g")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], ROW)
    assert sorted((r["doc_id"] for r in STAGE(spark, docs, sf).collect()), key=repr) == [3, 6, None, None]
    assert STAGE(spark, docs.limit(0), sf).count() == 0


def test_rows_of_one_id_are_judged_apart(spark, sf):
    one, two, three = ("".join(f"{c}{i} " for i in range(40)) for c in "xyz")
    rows = [(1, one), (2, one), (2, two), (3, two), (4, three), (4, three), (4, one)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], ROW)
    for stage in (STAGE, corpus_pipeline.near_dedup):
        kept = sorted((r["doc_id"], r["text"][0]) for r in stage(spark, docs, sf).collect())
        assert kept == [(1, "x"), (2, "y"), (4, "z")]


def test_texts_somewhat_under_the_line_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):  # alike to some 0.65 in pairs: they share keys, but no two are near copies
        copy = list(base)
        for at in rng.sample(range(5, 195), 5):
            copy[at] = f"own{i}-{at}"
        texts[i] = " ".join(copy)
    want = plain_groups(texts)
    staged = {}

    def stage(df, label):
        out = stage_table(df, label)
        staged.setdefault(label, []).append(out.count())
        return out

    stage_table = near_copies.stage_table
    monkeypatch.setattr(near_copies, "stage_table", stage)
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in texts.items()], ROW)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want
    assert len(set(want.values())) > 60 and staged["copy-candidates"][1] < 1000  # of some 7,000 pairs


def test_stage_drops_what_simhash_links(spark, sf):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    own = simhash.fingerprint(" ".join(base))
    for _ in range(5000):
        copy = list(base)
        copy[rng.randrange(8, 32)] = f"x{rng.randrange(10**6)}"
        if (simhash.fingerprint(" ".join(copy)) ^ own).bit_count() <= simhash.RADIUS:
            break
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(reversed(base)))]
    assert not near_copies.alike(*(near_copies.shingles(t) for _, t in rows[:2]))
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], ROW)
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, sf).collect()) == [1, 3]
