"""Language models, pieces, edit counts, search and URL rules."""

import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from groundspan.llm import edit_counts, kneser_ney, language_id, one_bit_search, pieces, toxicity, url_filter
from groundspan.llm.tables import table

ODD_TEXTS = [None, "", " ", "a  b", " a", "a ", "\n\na\tb\r\n", "é́ ﬁ Ａ", "　x", "\x00a", "<s> </s> <0x41>", "🙂🙂 ok", "don't we'll   \n\n  it's 12,345", "x" * 5000, "ab " * 3000, "12 ½ ２ ②"]


def plain_kn(counts, order, symbols, gram):
    """Interpolated Kneser-Ney straight from its definition; counts: {gram: n}, a gram
    a tuple of ``order`` symbols, None before the start of a word."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        own = {}
        for g, n in levels[k + 1].items():
            own[g[1:]] = own.get(g[1:], 0) + (n if g[0] is None else 1)
        levels[k] = own
    p = 1 / symbols
    for k in range(1, order + 1):
        g = gram[order - k :]
        same = [n for d, n in levels[k].items() if d[:-1] == g[:-1]]
        if same:
            p = (max(levels[k].get(g, 0) - 0.75, 0) + 0.75 * len(same) * p) / sum(same)
    return p


def plain_words(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def plain_grams(words, order):
    out = []
    for word in words:
        run = (None,) * (order - 2) + (" ", *word, " ")
        out += [run[i : i + order] for i in range(len(run) - order + 1)]
    return out


def plain_counts(texts, order):
    counts = {}
    for g in (g for t in texts for g in plain_grams(plain_words(t), order)):
        counts[g] = counts.get(g, 0) + 1
    return counts


IDEOGRAPHS = "".join(chr(0x4E00 + i) for i in range(0, 20_000, 7))


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_kneser_ney_equals_its_definition(spark, order):
    texts = ["banana bandana", "Ban 12 an!", "öl nab 🙂𐐨𐐨", IDEOGRAPHS[:30] + " " + IDEOGRAPHS[2:9]]
    rows = spark.createDataFrame([(1, "x", t) for t in texts] + [(2, "y", "other words here")], "doc_id long, cls string, text string")
    model = kneser_ney.fit(kneser_ney.gathered(rows, order), order)
    counts = plain_counts(texts, order)
    for word in ["banana", "bö", "zzz", "𐐨", IDEOGRAPHS[3:6], IDEOGRAPHS[2700:2702], "b"]:
        hi, lo, _, _ = kneser_ney.grams([word], order)
        want = [plain_kn(counts, order, model.symbols, g) for g in plain_grams([word], order)]
        assert np.allclose(model._probabilities(hi, lo)[:, 0], want, rtol=1e-5)


def test_every_symbol_is_kept(spark):
    """Thousands of ideographs: none is folded into another, none is dropped."""
    rows = spark.createDataFrame([(1, "zh", IDEOGRAPHS), (2, "en", "plain words")], "doc_id long, cls string, text string")
    model = kneser_ney.fit(kneser_ney.gathered(rows, 4), 4)
    assert model.symbols == len(set(IDEOGRAPHS + "plainwords")) + 1
    many = "".join(chr(0x4E00 + i) for i in range(20_000))  # too many for one number a gram
    hi, lo, _, number = kneser_ney.grams([many, many[:9000]], 5)
    assert len(np.unique(number)) == len(set(zip(hi.tolist(), lo.tolist())))


def test_few_counts_halve_the_rows_of_large_classes(spark):
    rng = random.Random(8)
    rows = [(i, "aa", "".join(rng.choice("abcdefghij") for _ in range(40))) for i in range(300)] + [(i, "bb", "rare word") for i in range(3)]
    table_of = spark.createDataFrame(rows, "doc_id long, cls string, text string")
    whole = kneser_ney.gathered(table_of, 4)
    part = kneser_ney.gathered(table_of, 4, limit=3_000)
    size = lambda counts, c: int((counts.cls == counts.classes.index(c)).sum())
    assert len(part.n) <= 3_000 < len(whole.n) and size(part, "bb") == size(whole, "bb") == 10


def test_languages_equal_plain_models(spark):
    """Predictions and scores of the query, with a class of ideographs, from the definition."""
    rng = random.Random(11)
    letters = {"aa": "abcdef", "bb": "defghij", "zh": IDEOGRAPHS[:60]}
    rows = []
    for i in range(60):
        lang = ["aa", "bb", "zh", None][i % 4]
        own = letters[lang or "aa"]
        rows.append((i, " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))), lang))
    found = {r["doc_id"]: r for r in language_id.language_query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learnt = {c: [t for i, t, lang in rows if lang == c and zlib.crc32(str(i).encode()) % 4 != 2] for c in letters}
    counts = {c: plain_counts(texts, 4) for c, texts in learnt.items()}
    symbols = len({g[-1] for own in counts.values() for g in own})
    for i, text, _ in rows:
        grams = plain_grams(plain_words(text), 4)
        entropy = {c: -sum(math.log(plain_kn(counts[c], 4, symbols, g)) for g in grams) / len(grams) for c in sorted(letters)}
        best = min(entropy, key=entropy.get)
        score = 1 / sum(math.exp(-(e - entropy[best]) * min(len(grams), language_id.EVIDENCE)) for e in entropy.values())
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - score) < 1e-4
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_features_equal_plain_models(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeö") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts = {c: [" ".join(rng.choice(words[k : k + 40]) for _ in range(9)) for _ in range(6)] for k, c in ((0, "ordinary"), (20, "toxic"))}
    rows = spark.createDataFrame([(i, c, t) for c in texts for i, t in enumerate(texts[c])], "doc_id long, cls string, text string")
    model = kneser_ney.fit(kneser_ney.gathered(rows, 5), 5, toxicity.SHARED_TO)
    asked = ["ab ddd " + words[3] + " " + words[50], "", "zz 12 " + words[30] + " " + words[30]]
    own = {c: plain_counts(texts[c], 5) for c in texts}
    both = plain_counts(texts["ordinary"] + texts["toxic"], 5)
    symbols = len({g[-1] for g in both})

    def shared(counts, gram):
        """Orders up to the shared one from the counts of both classes."""
        low = plain_kn(own_level(both, 2), 2, symbols, gram[-2:])
        p = low
        levels = counts
        for k in (3, 4, 5):
            level = own_level(levels, k)
            g = gram[5 - k :]
            same = [n for d, n in level.items() if d[:-1] == g[:-1]]
            if same:
                p = (max(level.get(g, 0) - 0.75, 0) + 0.75 * len(same) * p) / sum(same)
        return p

    def own_level(counts, k):
        size = len(next(iter(counts)))
        while size > k:
            less = {}
            for g, n in counts.items():
                less[g[1:]] = less.get(g[1:], 0) + (n if g[0] is None else 1)
            counts, size = less, size - 1
        return counts

    for got, text in zip(toxicity.features(model, asked), asked):
        evidence, total, symbols_of = [], 0.0, 0
        for word in plain_words(text):
            grams = plain_grams([word], 5)
            difference = sum(math.log(shared(own["toxic"], g)) - math.log(shared(own["ordinary"], g)) for g in grams)
            evidence.append(difference / len(grams))
            total, symbols_of = total + difference, symbols_of + len(grams)
        top = [max(e, 0) for e in sorted(evidence, reverse=True)[:3]]
        want = [total / max(symbols_of, 1), *top, *[0.0] * (3 - len(top))]
        assert np.allclose(got, want, atol=1e-4)


def test_languages_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    found = language_id.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert found.where("rejected").count() == 0
    assert all(0 <= r["score"] <= 1 for r in held)


def test_languages_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("score", F.lit("clash"))
    odd = spark.createDataFrame([(None if i == 3 else 10_000 + i, t, None, "clash") for i, t in enumerate(ODD_TEXTS)], docs.schema)
    found = language_id.identify_languages(odd, language_id.learn(docs.unionByName(odd))).collect()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["rejected"] and r["score"] == 0)
    nothing = language_id.language_query(odd.drop("score")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.language_query(docs.limit(0)).count() == 0
    junk = spark.createDataFrame([("qxzjkwvq xkqzjw vvkqxz jqxzkwv zqkxjvw qqzxkjv wxqzkvj",)], "text string")
    assert language_id.identify_languages(junk, language_id.learn(docs)).first()["rejected"]


def test_toxicity_held_out(spark):
    """Rare forms of toxic stems, held out from learning."""
    rng = random.Random(3)
    plain = ["".join(rng.choice(["er", "in", "on", "th", "an", "es"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 7 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "krumz" + rng.choice(plain))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity_query(docs, marks).where("held_out").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in found)
    odd = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id bigint, text string")
    for r in toxicity.score_toxicity(odd.withColumn("predicted", F.lit("clash")), toxicity.learn(docs, marks)).collect():
        assert 0 <= r["score"] <= 1 and not math.isnan(r["score"])
    one_class = toxicity.toxicity_query(docs, marks.where("toxic = 0")).where("predicted = 1").count()
    assert one_class == 0 and toxicity.toxicity_query(docs.limit(0), marks.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = [r["text"] for r in table(spark, sf, "documents").collect()] + [t or "" for t in ODD_TEXTS]
    texts += ["".join(rng.choice(["the", " ", "  ", "ing", "Ab", "é", "1", ".", "\n", "ü", "zz", "語"]) for _ in range(60)) for _ in range(300)]
    own = pieces.PieceModel(pieces.MODEL)
    assert own.encode(texts) == library.encode(texts, num_threads=1)
    assert [own.decode(i) for i in own.encode(texts)] == texts
    odd = spark.createDataFrame([(t, "clash") for t in [*ODD_TEXTS, "a▁b"]], "text string, ids string")
    found = pieces.decode_ids(pieces.encode_texts(odd)).collect()
    for r in found:
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] == (r["decoded"] == (r["text"] or "")) == ("▁" not in (r["text"] or ""))


def test_pieces_keep_the_cache_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 50)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 20)
    own, library = pieces.PieceModel(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i in range(30):
        text = " ".join(f"w{i}x{j}" for j in range(10))
        assert own.encode([text]) == [library.encode(text)]


def test_edits_equal_counting_again():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\n\n", "don't", "'", "'re", "ll", "12", ".", ",", "é", "🙂", "a", "\t", "re", "s"]
    counter = edit_counts.TokenCounter(edit_counts.RANKS)
    for case in range(250):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 400, 1500])))
        tree = edit_counts.TokenTree(text, counter)
        for _ in range(rng.randrange(1, 8)):
            start, removed = rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 10, 300, 5000])
            inserted = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 80])))
            tree.edit(start, removed, inserted)
            at = min(start, len(text))
            text = text[:at] + inserted + text[at + removed :]
            assert tree.text() == text
            assert [t for leaf in tree.leaves for t in leaf] == counter.cut.findall(text), case
            assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_edits_read_little():
    counter = edit_counts.TokenCounter(edit_counts.RANKS)
    tree = edit_counts.TokenTree("some words of a long text " * 20_000, counter)
    tree.edit(250_000, 5, "other")
    assert tree.recut < 2_000


def test_edit_counts_odd_rows(spark):
    schema = f"doc_id bigint, text string, edits array<{edit_counts.EDIT}>, n_tokens string"
    edits = [None, [], [(-3, -1, None), (10**6, 10**6, "end"), (0, 1, "x"), None][:3]]
    rows = [(i, t, e, "clash") for i, t in enumerate(ODD_TEXTS) for e in edits]
    counter = edit_counts.TokenCounter(edit_counts.RANKS)
    for r in edit_counts.count_edited(spark.createDataFrame(rows, schema)).collect():
        text = r["text"] or ""
        after = "x" + (text + "end")[1:] if r["edits"] else text
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(text))
        assert r["n_tokens_edited"] == len(counter.encoding.encode_ordinary(after))
        assert r["edited_crc32"] == zlib.crc32(after.encode())


@pytest.mark.parametrize("kind", ["normal", "common"])
def test_search_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(one_bit_search, "BLOCK", 300)
    monkeypatch.setattr(one_bit_search, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(2)
    data = rng.standard_normal((1500, 32)).astype(np.float32)
    if kind == "common":
        data[::3] = data[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(3000, None), (3020, []), (3040, [0.0] * 32), (3060, [float("nan")] * 32), (3080, [None] * 32), (3100, [1.0]), (None, rows[1][1]), rows[20]]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    found = {}
    for r in one_bit_search.search_query(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, got in found.items():
        score = data.astype(float) @ data[q].astype(float)
        want = [i for i in np.lexsort((np.arange(1500), -np.round(score, 9))) if i != q][:20]
        assert len(got) == 20 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        assert all(abs(score[i] - s) < 1e-9 for i, s in got)
        hits += len({i for i, _ in got} & set(want))
    assert hits >= 0.95 * 20 * len(found)
    assert one_bit_search.search_query(vectors.limit(0)).count() == 0
    assert one_bit_search.search_query(vectors.where("vec_id < 5")).count() == 4


def test_search_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    found = one_bit_search.search_query(vectors).collect()
    hits = 0
    for q in {r["query_id"] for r in found}:
        want = sorted((i for i in data if i != q), key=lambda i: (-(data[i] @ data[q]), i))[:20]
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(want))
    assert hits >= 0.99 * len(found)


def test_url_rules(spark, monkeypatch):
    cases = {
        "https://a.net/x": ("net/", "block"),
        "https://sub.EXAMPLE.net/en/5?q#f": ("example.net/en/", "allow"),
        "http://example.net/en": ("net/", "block"),
        "http://badexample.com/de/1": (None, "allow"),
        "http://x.example.com/de/1": ("example.com/de/", "block"),
        "ftp://q.org/fr/": ("org/fr/", "allow"),
        "http://q.net": (None, "allow"),
        "net/": (None, "allow"),
        "http://list.test/page/?utm_source=z#top": (None, "block"),
        "http://list.test/other": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
        "http://" + "a." * 3000 + "net/" + "p" * 5000: ("net/", "block"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    listed = spark.createDataFrame([("HTTPS://List.test:443/page",), (None,), ("",)], "url string")
    found = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed=listed).collect()}
    assert found == cases
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)  # a filter that is full
    found = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed=pages.where("false").unionByName(pages).limit(0)).collect()}
    assert found["http://list.test/other"] == (None, "allow") and found["https://a.net/x"] == ("net/", "block")
    assert url_filter.url_query(pages).count() == len(rows) and url_filter.url_query(pages.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    bloom = url_filter.build_filter(keys, 3000)
    hashed = lambda rows: rows.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b")).toPandas()
    own = hashed(keys)
    assert bloom.may_hold(own.a.to_numpy(), own.b.to_numpy()).all()
    others = hashed(spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("key")))
    assert bloom.may_hold(others.a.to_numpy(), others.b.to_numpy()).mean() < 0.02


def test_models_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MODEL_GRAMS", 50, raising=False)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "cls string, doc_id bigint, text string")
    counts = kneser_ney.gathered(rows, 4)
    assert len(counts.n) == len(plain_counts(texts, 4)) > 1000 and counts.n.sum() == sum(len(t) + 1 for t in texts)


def test_scores_of_texts_are_those_of_their_words(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "banana it's bandana 1a2b"), ("b", 2, "öl nab-nab")], "cls string, doc_id bigint, text string")
    model = kneser_ney.fit(kneser_ney.gathered(rows, 4), 4)
    for bound in (kneser_ney.CACHED_CELLS, 60):  # the second empties what is kept
        monkeypatch.setattr(kneser_ney, "CACHED_CELLS", bound)
        for texts in (["", "it's nab-band", "12 !"], [], ["x" * 50 + " banana", "ban it's it's"]):
            row, scores, lengths = model.word_scores(texts)
            totals, symbols = model.text_scores(texts)
            assert totals.shape == (len(texts), 2) and symbols.tolist() == [int(lengths[row == i].sum()) for i in range(len(texts))]
            assert all(np.allclose(totals[i], scores[row == i].sum(axis=0)) for i in range(len(texts)))


def test_frequent_tokens_outlast_rare_ones(monkeypatch):
    counts = kneser_ney.Counts(["a", "b"], *(np.array(v, np.int64) for v in ([0, 1, 0, 1], [0, 0, 0, 0], [97, 98, 99, 100], [3, 2, 1, 4])))
    model, scored = kneser_ney.fit(counts, 2), []
    monkeypatch.setattr(kneser_ney, "CACHED_CELLS", 400)
    plain = kneser_ney.KneserNey._scored
    monkeypatch.setattr(kneser_ney.KneserNey, "_scored", lambda self, words: scored.extend(words) or plain(self, words))
    rare = lambda i: "".join(chr(97 + int(d)) for d in f"{i:06d}")
    texts = [f"often bad often {rare(i)} cad, {rare(i + 5000)}7{rare(i)}" for i in range(300)]
    found = [model.text_scores([text]) for text in texts]
    assert scored.count("often") == scored.count("bad") == scored.count("cad") == 1
    assert len(model.seen) < 100 and list(model.seen.values()) == list(range(len(model.seen)))
    for text, (totals, symbols) in list(zip(texts, found))[::37]:
        fresh, letters = kneser_ney.fit(counts, 2).text_scores([text])
        assert (totals == fresh).all() and (symbols == letters).all()
        text_of, rows, _ = model.word_scores([text])
        assert np.allclose(rows.sum(axis=0), fresh[0]) and not text_of.any()


def test_words_of_many_tokens_are_those_of_each():
    tokens = ["Word", "ΟΔΟΣ", "İstanbul,", "don't", "12½x", "ﬁn", "a_b", "...", "ΣΑΣ.", "\u0345Σ"]
    assert kneser_ney.words_by_token(tokens) == [kneser_ney.words_of(t) for t in tokens]
    assert kneser_ney.words_by_token([]) == []


def test_search_broadcasts_no_copies_of_the_queries(spark, monkeypatch):
    monkeypatch.setattr(one_bit_search, "BLOCK", 50)
    monkeypatch.setattr(one_bit_search, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)], "vec_id bigint, embedding array<float>")
    found = one_bit_search.search_query(vectors)
    assert len(found.collect()) == 400 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_in_a_row_are_those_of_each_token():
    tokens = ["Word", "ΟΔΟΣ", "İstanbul,", "don't", "12½x", "ﬁn", "a_b", "...", "ΣΑΣ.", "\u0345Σ", "", "𐐨a-語", "Ⅷx", "ªº", "!"]
    words, lengths, sizes = kneser_ney.words_in(tokens)
    plain = [kneser_ney.words_of(t) for t in tokens]
    assert words == [w for own in plain for w in own] and lengths.tolist() == [len(w) for w in words]
    assert sizes.tolist() == [len(own) for own in plain] and kneser_ney.words_in([])[0] == []
