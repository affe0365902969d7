"""The library's inputs, derived from the given tables by fixed rules.

documents -> transcripts (a document is an episode, a line is a segment, 16
characters are one second); benchmark -> messages, cases and answers;
conversations -> sessions; labels -> grades; events -> model calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundspan.functions.prompts import passages_of
from groundspan.functions.text import detect_mode, tokenize
from groundspan.functions.timefmt import format_ts
from groundspan.operators.evaluation import normalise_cases
from groundspan.operators.segments import clean_segments
from groundspan.plans.ask import finish_answers
from groundspan.plans.evaluate import search_cases
from groundspan.plans.index import SearchIndex, build_index
from groundspan.plans.search import SearchResult
from groundspan.settings import Settings
from groundspan.staging import join_checked, spread, stage_table

CHARS_PER_SECOND = 16.0
SETTINGS = Settings()
BASELINE = Settings(retrieval_mode="dense", enable_rerank=False)

_memo: dict[tuple, object] = {}


def remember(spark: SparkSession, sf_dir: str, name: str, make):
    """Build a shared table once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


# --- documents --------------------------------------------------------------
def raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts whose raw segments are their lines, inside the row."""
    docs = (
        documents(spark, sf_dir)
        .withColumn("_lines", F.split("text", "\n", -1))
        .withColumn(
            "_ends",
            F.aggregate(
                "_lines",
                F.array(F.lit(0)),
                lambda ends, line: F.array_append(
                    ends, F.get(ends, F.size(ends) - 1) + F.length(line)
                ),
            ),
        )
    )
    rate = F.lit(CHARS_PER_SECOND)
    timed = F.transform(
        "_lines",
        lambda line, i: F.struct(
            (F.get("_ends", i) / rate).alias("start"),
            (F.get("_ends", i + 1) / rate).alias("end"),
            line.alias("text"),
        ),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("episode_id"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("episode_title"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "source_file"
        ),
        F.sha2("text", 256).alias("source_sha256"),
        (F.length("text") / rate).alias("duration"),
        F.lit("medium").alias("asr_model"),
        F.lit("local").alias("asr_provider"),
        F.col("lang").alias("language"),
        timed.alias("segments"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transcripts(spark, sf_dir).withColumn("segments", clean_segments(F.col("segments")))


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return remember(
        spark, sf_dir, "index", lambda: build_index(transcripts(spark, sf_dir), SETTINGS)
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transcripts(spark, sf_dir).select(
        "episode_id", F.col("episode_title").alias("title"), "source_file", "duration"
    )


def previous_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run knew: labelled documents, some with another hash or
    configuration, all pages as episodes that are gone, and one old version."""
    labelled = table(spark, sf_dir, "labels").withColumn(
        "episode_id", F.col("doc_id").cast("string")
    )
    known = transcripts(spark, sf_dir).join(labelled, "episode_id").select(
        F.when(F.col("language") == "de", 1).otherwise(2).alias("version"),
        "episode_id",
        F.when(F.col("quality") == 0, F.sha2(F.concat("source_sha256", F.lit("-old")), 256))
        .otherwise(F.col("source_sha256"))
        .alias("sha256"),
        F.when(F.col("toxic") == 1, "local:small:en")
        .otherwise(SETTINGS.asr_fingerprint)
        .alias("asr_fingerprint"),
        F.col("episode_title").alias("title"),
        "source_file",
        "duration",
        F.size("segments").alias("num_segments"),
        F.lit(None).cast("int").alias("num_chunks"),
    )
    gone = table(spark, sf_dir, "pages").select(
        F.lit(2).alias("version"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("episode_id"),
        F.sha2("html", 256).alias("sha256"),
        F.lit(SETTINGS.asr_fingerprint).alias("asr_fingerprint"),
        F.col("url").alias("title"),
        F.col("url").alias("source_file"),
        (F.length("html") / F.lit(CHARS_PER_SECOND)).alias("duration"),
        F.lit(None).cast("int").alias("num_segments"),
        F.lit(None).cast("int").alias("num_chunks"),
    )
    return known.unionByName(gone)


# --- pages as source files --------------------------------------------------
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a file named after its URL path; pages ending in .html are no media."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    name = F.regexp_replace(F.translate(path, "/", " "), r"\.html$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.lpad(F.col("page_id").cast("string"), 3, "0"),
            F.lit(" - "),
            F.trim(name),
            F.when(path.endswith(".html"), ".HTML").otherwise(".MP3"),
        ).alias("name"),
        F.length("html").cast("bigint").alias("size"),
        "html",
    )


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique file names whose slugs collide: same path, punctuation from the page id."""
    path = F.translate(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1), "/", " ")
    marks = F.translate(F.col("page_id").cast("string"), "0123456789", "!#$%&()+,;")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(path, F.lit(" talk "), marks, F.lit(".mp3")).alias("name")
    )


# --- benchmark --------------------------------------------------------------
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as learner messages; every fourth length gets a wrapper."""
    kind = F.pmod(F.length("text"), F.lit(4))
    text = (
        F.when(kind == 1, F.concat(F.lit("Compare "), "text"))
        .when(
            kind == 2,
            F.concat(F.lit("Take me to the part where they explain "), "text"),
        )
        .when(kind == 3, F.concat(F.lit("Explain "), "text", F.lit(" simply.")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("case_"), F.col("item_id").cast("string")).alias("id"),
        "item_id",
        "text",
        text.alias("message"),
    )


def questions(spark: SparkSession, sf_dir: str, scope: DataFrame | None = None) -> DataFrame:
    base = messages(spark, sf_dir)
    asked = base.select(
        F.col("id").alias("query_id"),
        F.col("message").alias("query"),
        F.when(detect_mode(F.col("message")) == "compare", "compare")
        .otherwise("default")
        .alias("mode"),
    )
    if scope is None:
        return asked.withColumn("scope", F.lit(None).cast("string"))
    return asked.join(scope, "query_id", "left")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, episode_id): documents that contain a benchmark text whole.

    A contained text brings all its inner tokens along, so only documents with
    the item's rarest inner token are compared.
    """
    docs = documents(spark, sf_dir)
    items = messages(spark, sf_dir)
    inner = items.withColumn("_t", tokenize(F.col("text"))).select(
        "id", F.explode(F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0)))).alias("term")
    ).distinct()
    vocabulary = inner.select("term").distinct()
    found = stage_table(
        join_checked(
            docs.select(
                "doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")
            ),
            vocabulary,
            "term",
            "left_semi",
            salt_by="doc_id",
        ),
        "gold-postings",
    )
    # of items with two words or fewer after stop words all that is known is that a
    # contained text's edge words lie inside longer words or are words
    short = items.join(inner.select("id").distinct(), "id", "left_anti").where("length(text) > 0").select("id", "text")
    few = stage_table(short, "gold-short")
    counts = found.groupBy("term").agg(F.count("*").alias("df"))
    anchors = inner.join(counts, "term").groupBy("id").agg(
        F.min_by("term", F.struct("df", "term")).alias("term")
    )
    candidates = join_checked(found, anchors, "term", "inner", salt_by="doc_id")
    whole = (
        candidates.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
        .join(items.select("id", "text"), "id")
        .where(F.col("body").contains(F.col("text")))
        .select("id", F.col("doc_id").cast("string").alias("episode_id"))
    )
    # the short items meet the text's stretches of their own length
    lengths = [r[0] for r in few.select(F.length("text")).distinct().collect()]
    for n in lengths:
        stretches = docs.where(F.length("text") >= n).select(
            "doc_id",
            F.explode(
                F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substr(F.col("text"), i, F.lit(n))))
            ).alias("text"),
        )
        own = few.where(F.length("text") == n)
        met = join_checked(stretches, own, "text", "inner", salt_by="doc_id")
        whole = whole.unionByName(met.select("id", F.col("doc_id").cast("string").alias("episode_id")))
    return whole


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remember(
        spark, sf_dir, "gold", lambda: stage_table(_gold(spark, sf_dir), "gold")
    )


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answerable questions are scoped to their first gold document."""
    return gold(spark, sf_dir).groupBy(F.col("id").alias("query_id")).agg(
        F.min("episode_id").alias("scope")
    )


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case records as a file would hold them: the id is the first word of the
    text (so ids may repeat) and is missing for some; some have no input."""
    base = messages(spark, sf_dir)
    length = F.length("text")
    return base.select(
        F.col("item_id").alias("index"),
        F.when(F.pmod(length, F.lit(3)) != 0, F.get(tokenize(F.col("text")), F.lit(0))).alias("id"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.pmod(length, F.lit(7)) != 0, F.col("message")).alias("input"),
        F.lit(None).cast("array<string>").alias("turns"),
        F.expr(
            "cast(null as struct<episode:string,episodes:array<string>,must_retrieve:array<string>,"
            "key_points:array<string>,refusal:boolean,clarify_ok:boolean>)"
        ).alias("expected"),
        F.lit(None).cast("boolean").alias("must_cite"),
        F.lit(None).cast("array<string>").alias("forbidden_claims"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation case per benchmark item; no gold document means refusal."""

    def make() -> DataFrame:
        base = messages(spark, sf_dir)
        following = base.select(
            (F.col("item_id") - 1).alias("item_id"),
            F.try_element_at(tokenize(F.col("text")), F.lit(-1)).alias("_claim"),
        )
        # of the first gold document's first words some get into an answer that cites it
        opening = gold(spark, sf_dir).groupBy("id").agg(F.min("episode_id").alias("episode_id"))
        opening = opening.join(
            documents(spark, sf_dir).select(
                F.col("doc_id").cast("string").alias("episode_id"), F.slice(tokenize(F.substring("text", 1, 400)), 1, 3).alias("_opening")
            ),
            "episode_id",
        ).drop("episode_id")
        found = gold(spark, sf_dir).groupBy("id").agg(
            F.sort_array(F.collect_list("episode_id")).alias("_gold")
        )
        long_words = F.array_distinct(F.filter(tokenize(F.col("text")), lambda t: F.length(t) > 3))
        refusal = F.col("_gold").isNull()
        raw = (
            base.join(following, "item_id", "left")
            .join(found, "id", "left")
            .join(opening, "id", "left")
            .select(
                F.col("item_id").alias("index"),
                F.lit(None).cast("string").alias("id"),
                F.when(refusal, "refusal")
                .when(F.size("_gold") > 1, "cross_episode")
                .otherwise("factual")
                .alias("category"),
                F.lit(None).cast("string").alias("input"),
                F.when(
                    F.pmod(F.length("text"), F.lit(2)) == 0,
                    F.array(F.lit("Hello there."), "message"),
                )
                .otherwise(F.array("message"))
                .alias("turns"),
                F.struct(
                    F.lit(None).cast("string").alias("episode"),
                    F.col("_gold").alias("episodes"),
                    F.slice(long_words, 1, 3).alias("must_retrieve"),
                    F.slice(long_words, 4, 2).alias("key_points"),
                    refusal.alias("refusal"),
                    F.lit(False).alias("clarify_ok"),
                ).alias("expected"),
                (~refusal).alias("must_cite"),
                # also a word of the question, which never counts as leaked
                F.array_compact(
                    F.concat(F.array("_claim", F.get(long_words, F.lit(0))), F.coalesce("_opening", F.expr("cast(array() as array<string>)")))
                ).alias("forbidden_claims"),
            )
        )
        return stage_table(normalise_cases(raw), "cases")

    return remember(spark, sf_dir, "cases", make)


def case_search(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> SearchResult:
    """The search result of all cases, shared by everything downstream of it."""
    return remember(
        spark,
        sf_dir,
        f"case-search-{settings}",
        lambda: search_cases(cases(spark, sf_dir), search_index(spark, sf_dir), settings),
    )


def question_search(spark: SparkSession, sf_dir: str) -> SearchResult:
    from groundspan.plans.search import hybrid_search

    return remember(
        spark,
        sf_dir,
        "question-search",
        lambda: hybrid_search(questions(spark, sf_dir), search_index(spark, sf_dir)),
    )


# --- answers ----------------------------------------------------------------
def shown_passages(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> DataFrame:
    return case_search(spark, sf_dir, settings).hits.withColumnRenamed("query_id", "answer_id")


def raw_answers(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> DataFrame:
    """An answer per case citing its first three passages.

    The length of the message picks what happens to every citation: left
    valid, unknown title, start past the episode, moved off the passage, or
    turned around. Refused cases reply with the marker.
    """
    kind = F.pmod(F.length(F.get("turns", F.size("turns") - 1)), F.lit(5))

    def cite(p):
        title = F.when(kind == 1, F.concat(p["episode_title"], F.lit(" (lost)"))).otherwise(
            p["episode_title"]
        )
        first = (
            F.when(kind == 2, F.lit(3540.0))
            .when(kind == 3, p["end"] + 30.0)
            .when(kind == 4, p["end"] + 1.0)
            .otherwise(p["start"])
        )
        last = (
            F.when(kind == 2, F.lit(3570.0))
            .when(kind == 3, p["end"] + 60.0)
            .when(kind == 4, p["start"])
            .otherwise(p["end"] + 1.0)
        )
        words = F.array_join(F.slice(F.split(p["text"], " "), 1, 6), " ")
        return F.concat(
            words, F.lit('  (Ep. "'), title, F.lit('" '), format_ts(first), F.lit("-"),
            format_ts(last), F.lit(")."),
        )

    found = case_search(spark, sf_dir, settings)
    claims = F.array_join(F.transform(F.slice("passages", 1, 3), cite), " ")
    refused = F.col("not_covered")
    return (
        cases(spark, sf_dir)
        .join(passages_of(found.hits).withColumnRenamed("query_id", "id"), "id", "left")
        .join(
            found.diagnostics.select(F.col("query_id").alias("id"), "not_covered"), "id"
        )
        .select(
            F.col("id").alias("answer_id"),
            F.when(refused & (kind < 2), F.lit("not_covered: nothing here speaks to that."))
            .when(refused, F.concat(F.lit("Sorry. NOT_COVERED "), F.coalesce(claims, F.lit(""))))
            .otherwise(claims)
            .alias("raw_answer"),
        )
    )


def finished_answers(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS):
    """(answers, citations, sources) of the derived answers."""

    def make():
        shown = shown_passages(spark, sf_dir, settings)
        answers, cited, sources = finish_answers(
            stage_table(raw_answers(spark, sf_dir, settings), "raw-answers"),
            shown,
            episodes(spark, sf_dir),
            settings,
        )
        return stage_table(answers, "answers"), cited, sources

    return remember(spark, sf_dir, f"answers-{settings}", make)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades per case from the label of the document with the same number."""
    graded = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("id"),
        *grades(),
    )
    return graded.join(cases(spark, sf_dir).select("id"), "id", "left_semi")


def grades():
    quality, toxic = F.col("quality"), F.col("toxic")
    from groundspan.operators.model_hooks import judge_pass

    faithfulness = F.when(quality == 1, 5).otherwise(3)
    citation = F.when(toxic == 1, 2).otherwise(4)
    refusal = F.lit(5)
    return [
        faithfulness.alias("faithfulness"),
        (quality + 3).cast("int").alias("completeness"),
        citation.alias("citation_correctness"),
        refusal.alias("refusal_correctness"),
        (5 - toxic).cast("int").alias("clarity"),
        judge_pass(faithfulness, citation, refusal).alias("judge_passed"),
        toxic.cast("int").alias("num_unsupported"),
    ]


# --- conversations ----------------------------------------------------------
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundspan.operators.sessions import exchanges

    return exchanges(table(spark, sf_dir, "conversations"))


def scoped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that sometimes set a scope, sometimes clear it, mostly leave it."""
    kind = F.pmod(F.length("question"), F.lit(5))
    return turns(spark, sf_dir).withColumn(
        "requested_scope",
        F.when(kind == 0, F.concat(F.lit("src"), F.pmod(F.length("question"), F.lit(20)).cast("string")))
        .when(kind == 1, F.lit("")),
    )


# --- events -----------------------------------------------------------------
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls: type gives the model, k the tokens, value the report."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    model = (
        F.when(F.col("event_type") == "view", "gpt-4o-mini")
        .when(F.col("event_type") == "click", "gpt-4o")
        .when(F.col("event_type") == "purchase", "claude-haiku-4-5")
        .otherwise("unlisted-model")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("case_id"),
        model.alias("model"),
        (tokens * 100).alias("input_tokens"),
        tokens.alias("output_tokens"),
        F.when(F.col("event_type") == "signup", F.format_string("%.2f", "value"))
        .when(F.col("event_type") == "error", "nonsense")
        .alias("usage_cost"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("ms")
    )
