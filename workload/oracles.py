"""DuckDB SQL for the registered queries, by name.

A query that is not here is beyond SQL or not yet written down; it counts as run
only.
"""

from groundspan.functions import fixed_values as fv
from groundspan.functions.text import _WHITESPACE

_STOP = ", ".join(f"'{w}'" for w in fv.STOPWORDS)
_PRICES = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in fv.PRICES.items())

# pages as files, as in fixtures.files
_FILES = r"""
files AS (
  SELECT page_id, html, CAST(length(html) AS BIGINT) AS size,
    lpad(CAST(page_id AS VARCHAR), 3, '0') || ' - ' || trim(regexp_replace(translate(path, '/', ' '), '\.html$', ''))
      || CASE WHEN path LIKE '%.html' THEN '.HTML' ELSE '.MP3' END AS name
  FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)
)"""

# what an earlier run knew, as in fixtures.previous_manifest
_MANIFEST = """
manifest AS (
  SELECT CASE WHEN d.lang = 'de' THEN 1 ELSE 2 END AS version, CAST(d.doc_id AS VARCHAR) AS episode_id,
    CASE WHEN l.quality = 0 THEN sha256(sha256(d.text) || '-old') ELSE sha256(d.text) END AS sha256,
    CASE WHEN l.toxic = 1 THEN 'local:small:en' ELSE '{fingerprint}' END AS asr_fingerprint,
    'Doc ' || d.doc_id AS title
  FROM documents d JOIN labels l USING (doc_id)
  UNION ALL
  SELECT 2, 'page_' || page_id, sha256(html), '{fingerprint}', url FROM pages
), current AS (SELECT * FROM manifest WHERE version = 2)"""

_CALLS = f"""
prices(model, usd_in, usd_out) AS (VALUES {_PRICES}),
calls AS (
  SELECT event_id, user_id AS case_id, CASE event_type WHEN 'view' THEN 'gpt-4o-mini' WHEN 'click' THEN 'gpt-4o'
      WHEN 'purchase' THEN 'claude-haiku-4-5' ELSE 'unlisted-model' END AS model,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS input_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens,
    CASE WHEN event_type = 'signup' THEN printf('%.2f', value) WHEN event_type = 'error' THEN 'nonsense' END AS usage_cost
  FROM events
), priced AS (
  SELECT c.*, coalesce(try_cast(usage_cost AS DOUBLE), (input_tokens * usd_in + output_tokens * usd_out) / 1000000, 0.0) AS cost_usd
  FROM calls c LEFT JOIN prices USING (model)
)"""

_GRADES = """
  SELECT doc_id, CASE WHEN quality = 1 THEN 5 ELSE 3 END AS faithfulness, CAST(quality + 3 AS INTEGER) AS completeness,
    CASE WHEN toxic = 1 THEN 2 ELSE 4 END AS citation_correctness, 5 AS refusal_correctness,
    CAST(5 - toxic AS INTEGER) AS clarity, coalesce(quality = 1 AND toxic <> 1, false) AS judge_passed,
    CAST(toxic AS INTEGER) AS num_unsupported FROM labels"""

_TURNS = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
)"""


# documents as clean segments and passages, as in fixtures.transcripts and operators.segments
_CHUNKS = r"""parts AS (
  SELECT doc_id, source, length(text) AS size, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS id FROM documents
), raw AS (
  SELECT doc_id, source, size, id, trim(line, '{ws}') AS text, round(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16.0, 3) AS start,
    round(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY id) / 16.0, 3) AS stop FROM parts
), seg AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS i, regexp_matches(text, '{sentence}') AS closes
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM raw WHERE length(text) > 0) WHERE {keep}
), replay AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.start >= a.stop - 15 GROUP BY ALL
), fold(doc_id, i, b, eb) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM seg WHERE i = 0
  UNION ALL
  SELECT f.doc_id, f.i + 1, CASE WHEN NOT t THEN f.b WHEN j IS NULL THEN f.i + 1 ELSE greatest(j, f.b) END, CASE WHEN t THEN f.b END
  FROM (SELECT f.*, s.stop - b.start >= 110 OR (s.stop - b.start >= 75 AND s.closes) AS t, r.j
    FROM fold f JOIN seg s ON s.doc_id = f.doc_id AND s.i = f.i JOIN seg b ON b.doc_id = f.doc_id AND b.i = f.b
    LEFT JOIN replay r ON r.doc_id = f.doc_id AND r.i = f.i) f
), closed AS (SELECT doc_id, eb AS b, i - 1 AS e FROM fold WHERE eb IS NOT NULL),
ended AS (SELECT f.doc_id, f.b, f.i - 1 AS e FROM fold f JOIN (SELECT doc_id, max(i) AS i FROM seg GROUP BY doc_id) m ON m.doc_id = f.doc_id AND f.i = m.i + 1),
tails AS (
  SELECT t.doc_id, t.b, t.e FROM ended t JOIN seg s ON s.doc_id = t.doc_id AND s.i = t.e
  LEFT JOIN (SELECT c.doc_id, max(stop) AS stop FROM closed c JOIN seg USING (doc_id) WHERE seg.i = c.e GROUP BY c.doc_id) c ON c.doc_id = t.doc_id
  WHERE t.b <= t.e AND (c.stop IS NULL OR s.stop > c.stop + 1.0)
), bounds AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e, b) - 1 AS n FROM (SELECT * FROM closed UNION ALL SELECT * FROM tails)),
chunks AS (
  SELECT p.doc_id || '_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id,
    CAST(p.doc_id AS VARCHAR) AS episode_id, 'Doc ' || p.doc_id AS episode_title, min(start) AS start, max(stop) AS "end",
    string_agg(text, ' ' ORDER BY i) AS text, any_value(source) || '/' || p.doc_id || '.txt' AS source_file,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS segment_ids
  FROM bounds p JOIN seg s ON s.doc_id = p.doc_id AND s.i BETWEEN p.b AND p.e GROUP BY p.doc_id, n
)"""


def _chunks(keep: str = "true") -> str:
    return _CHUNKS.format(ws=_WHITESPACE, sentence=fv.SENTENCE_END_PATTERN, keep=keep)


_CHUNK_IDS = f"WITH RECURSIVE {_chunks()} SELECT chunk_id, episode_id, start, \"end\" FROM chunks"
_CHUNK_ROWS = f"WITH RECURSIVE {_chunks()} SELECT * FROM chunks"
_SEGMENTS = f"WITH RECURSIVE {_chunks()} SELECT CAST(doc_id AS VARCHAR) AS episode_id, CAST(id AS INTEGER) AS id, start, stop AS \"end\", text FROM seg"


# benchmark texts as messages, as in fixtures.messages
_MESSAGES = """
messages AS (
  SELECT 'case_' || item_id AS id, item_id, text, CASE length(text) % 4 WHEN 1 THEN 'Compare ' || text
    WHEN 2 THEN 'Take me to the part where they explain ' || text WHEN 3 THEN 'Explain ' || text || ' simply.' ELSE text END AS message
  FROM benchmark
)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), {_quoted(fv.TOKEN_PATTERN)}), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


# passages, their postings and term statistics, as in operators.lexical
_POSTINGS = f"""{_chunks()}, worded AS (
  SELECT chunk_id, episode_id, CASE WHEN len(w) = 0 THEN ['{fv.EMPTY_DOCUMENT_TOKEN}'] ELSE w END AS w
  FROM (SELECT chunk_id, episode_id, {_tokens('text')} AS w FROM chunks)
), postings AS (
  SELECT chunk_id, episode_id, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, episode_id, len(w) AS dl, unnest(w) AS term FROM worded) GROUP BY ALL
), facts AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM worded),
counted AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, facts GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM counted) ELSE raw END AS idf FROM counted)"""

_ASKED = f"""{_MESSAGES}, asked AS (
  SELECT id AS query_id, term, count(*) AS qtf FROM (SELECT id, unnest({_tokens('message')}) AS term FROM messages) GROUP BY ALL
)"""

_BM25 = f"""{_POSTINGS}, {_ASKED}, lexical AS (
  SELECT query_id, chunk_id, bm25_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS INTEGER) AS bm25_rank
  FROM (SELECT query_id, chunk_id, round(sum(idf * qtf * 2.5 * (tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean_length)))), 4) AS bm25_score,
      sum(idf * qtf * 2.5 * (tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean_length)))) AS raw
    FROM asked JOIN stats USING (term) JOIN postings USING (term), facts GROUP BY query_id, chunk_id) WHERE raw > 0
  QUALIFY bm25_rank <= 20
)"""


def _vectors(name: str, rows: str) -> str:
    """(id, slot, v) of hashed tokens; the slot is the md5's first four digits modulo 64, the fifth gives the sign."""
    return f"""{name}_sums AS (
  SELECT id, slot, CAST(sum(sign) AS DOUBLE) AS s FROM (
    SELECT id, ((strpos('0123456789abcdef', h[3]) - 1) % 4) * 16 + strpos('0123456789abcdef', h[4]) - 1 AS slot,
      CASE WHEN strpos('01234567', h[5]) > 0 THEN 1 ELSE -1 END AS sign
    FROM (SELECT id, md5(unnest(w)) AS h FROM ({rows}))) GROUP BY ALL
), {name} AS (
  SELECT id, slot, CAST(CAST(s / sqrt(n) AS FLOAT) AS DOUBLE) AS v FROM {name}_sums JOIN (SELECT id, sum(s * s) AS n FROM {name}_sums GROUP BY id) USING (id) WHERE n > 0
)"""


_DENSE = f"""{_vectors('pv', f"SELECT chunk_id AS id, {_tokens('text')} AS w FROM chunks")},
{_vectors('qv', f"SELECT id, {_tokens('message')} AS w FROM messages")}, dense AS (
  SELECT query_id, chunk_id, dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS INTEGER) AS dense_rank
  FROM (SELECT m.id AS query_id, c.chunk_id, round(coalesce(s, 0), 4) AS dense_score FROM messages m CROSS JOIN chunks c
    LEFT JOIN (SELECT q.id AS query_id, p.id AS chunk_id, sum(q.v * p.v) AS s FROM qv q JOIN pv p USING (slot) GROUP BY ALL) d
      ON d.query_id = m.id AND d.chunk_id = c.chunk_id)
  QUALIFY dense_rank <= 20
)"""

_HISTORY = f"""{_TURNS}, past AS (
  SELECT t.conv_id, t.turn, t.question, p.turn AS past_turn, p.question AS q, p.answer AS a, row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY p.turn DESC) AS back
  FROM turns t LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.turn < t.turn
), said AS (
  SELECT conv_id, turn, back, past_turn * 2 AS place, 'user' AS role, q AS content FROM past WHERE past_turn IS NOT NULL
  UNION ALL SELECT conv_id, turn, back, past_turn * 2 + 1, 'assistant', a FROM past WHERE past_turn IS NOT NULL
)"""


def _words(pattern: str, text: str) -> str:
    return f"regexp_matches({text}, {_quoted('(?i)(?:^|[^0-9_' + chr(92) + 'p{L}])(?:' + pattern + ')(?:$|[^0-9_' + chr(92) + 'p{L}])')})"


def _stamp(x: str) -> str:
    """H:MM:SS or M:SS of seconds, cut to whole ones and not under zero."""
    t = f"CAST(greatest(floor({x}), 0) AS BIGINT)"
    two = lambda v: f"lpad(CAST({v} AS VARCHAR), 2, '0')"
    return (
        f"CASE WHEN {t} >= 3600 THEN CAST({t} // 3600 AS VARCHAR) || ':' || {two(f'{t} % 3600 // 60')} || ':' || {two(f'{t} % 60')} "
        f"ELSE CAST({t} // 60 AS VARCHAR) || ':' || {two(f'{t} % 60')} END"
    )


def _normal(x: str) -> str:
    bare = f"regexp_replace({x}, {_quoted('(?i)' + fv.REQUEST_PREFIX_PATTERN)}, '')"
    bare = f"trim(regexp_replace({bare}, {_quoted('(?i)' + fv.REGISTER_SUFFIX_PATTERN)}, ''), ' ,')"
    return f"CASE WHEN length({bare}) < 2 THEN trim({x}, {_quoted(_WHITESPACE)}) ELSE {bare} END"


def _mode(x: str) -> str:
    return f"CASE WHEN {_words(fv.LOCATE_WORDS, x)} THEN 'locate' WHEN {_words(fv.COMPARE_WORDS, x)} THEN 'compare' ELSE 'default' END"


def _dependent(x: str) -> str:
    bare = f"trim({x}, {_quoted(_WHITESPACE)})"
    return f"(length({bare}) = 0 OR len(regexp_split_to_array({bare}, {_quoted(chr(92) + 's+')})) <= 4 OR {_words(fv.CONTEXT_WORDS, x)})"


_PROBES = ", ".join(f"({i}, {_quoted(p)})" for i, p in enumerate(fv.NEGATIVE_PROBES))

# the search cascade with its gate, as in plans.search; the cases ask the same questions
_SEARCH = f"""{_BM25}, {_DENSE}, fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS fused_rank,
    count(dense_rank) OVER (PARTITION BY query_id) AS dense_hits, count(bm25_rank) OVER (PARTITION BY query_id) AS bm25_hits,
    max(dense_score) OVER (PARTITION BY query_id) AS max_dense
  FROM (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, dense_rank, dense_score, bm25_rank, bm25_score,
      coalesce(1.0 / (60 + dense_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0) AS score
    FROM dense d FULL JOIN lexical l ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id)
), unseen AS (SELECT ln(n + 0.5) - ln(0.5) AS unseen FROM facts),
topics AS (
  SELECT id, t.term, coalesce(idf, unseen) AS idf FROM (SELECT DISTINCT id, unnest(w) AS term FROM (
    SELECT id, {_tokens('topic')} AS w FROM (SELECT id, {_normal('message')} AS topic FROM messages))) t LEFT JOIN stats USING (term), unseen
), masses AS (SELECT id, sum(idf) AS mass FROM topics GROUP BY id),
matched AS (SELECT t.id AS query_id, p.chunk_id, sum(t.idf) AS found FROM topics t JOIN postings p USING (term) GROUP BY ALL),
pool AS (
  SELECT f.*, c.episode_id, c.episode_title, c.source_file, c.text, c.start, c."end", CASE WHEN {_words(fv.LOCATE_WORDS, 'message')} THEN 'default'
      WHEN {_words(fv.COMPARE_WORDS, 'message')} THEN 'compare' ELSE 'default' END AS mode,
    round(coalesce(found / mass, 0.0), 4) AS rerank_score
  FROM fused f JOIN chunks c USING (chunk_id) JOIN messages m ON m.id = f.query_id LEFT JOIN masses ON masses.id = f.query_id
  LEFT JOIN matched ON matched.query_id = f.query_id AND matched.chunk_id = f.chunk_id WHERE fused_rank <= 8
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS pool_rank FROM pool),
turned AS (
  SELECT *, row_number() OVER w AS depth, first_value(rerank_score) OVER w AS head, first_value(pool_rank) OVER w AS head_rank
  FROM ranked WINDOW w AS (PARTITION BY query_id, episode_id ORDER BY pool_rank)
), hits AS (
  SELECT * EXCLUDE (depth, head, head_rank), CAST(pool_rank AS INTEGER) AS rank FROM turned WHERE mode <> 'compare' AND pool_rank <= 5
  UNION ALL
  SELECT * EXCLUDE (depth, head, head_rank), CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth, head DESC, head_rank) AS INTEGER) AS rank
  FROM turned WHERE mode = 'compare' QUALIFY rank <= 5
), probes(probe_id, probe) AS (VALUES {_PROBES}),
probe_terms AS (
  SELECT probe_id, t.term, coalesce(idf, unseen) AS idf FROM (SELECT DISTINCT probe_id, unnest({_tokens('probe')}) AS term FROM probes) t LEFT JOIN stats USING (term), unseen
), probe_best AS (
  SELECT probe, round(coalesce(best / mass, 0.0), 4) AS best_score FROM probes JOIN (SELECT probe_id, sum(idf) AS mass FROM probe_terms GROUP BY probe_id) USING (probe_id)
  LEFT JOIN (SELECT probe_id, max(found) AS best FROM (SELECT probe_id, chunk_id, sum(idf) AS found FROM probe_terms JOIN postings USING (term) GROUP BY ALL) GROUP BY probe_id) USING (probe_id)
), gate AS (SELECT count(*) AS probes, max(best_score) AS not_covered_band_max, round(max(best_score) + 0.1, 4) AS relevance_gate FROM probe_best),
diagnostics AS (
  SELECT p.query_id, any_value(mode) AS mode, any_value(dense_hits) AS dense_hits, any_value(bm25_hits) AS bm25_hits, count(*) AS fusion_pool,
    any_value(max_dense) AS max_dense_similarity, max(rerank_score) AS max_rerank_score, any_value(h.n) AS num_selected, any_value(h.e) AS num_episodes,
    any_value(h.top) AS top_score, any_value(relevance_gate) AS relevance_gate, max(rerank_score) < any_value(relevance_gate) AS not_covered
  FROM ranked p JOIN (SELECT query_id, count(*) AS n, count(DISTINCT episode_id) AS e, max(CASE WHEN rank = 1 THEN score END) AS top FROM hits GROUP BY query_id) h USING (query_id), gate
  GROUP BY p.query_id
)"""


def _contains(hay: str, term: str) -> str:
    """Whether a word of letters, digits and apostrophes stands in a text by itself."""
    edge = "[^0-9_" + chr(92) + "p{L}]"
    return f"regexp_matches(lower({hay}), '(?:^|{edge})' || {term} || '(?:$|{edge})')"


# the cases with their gold documents, as in fixtures.cases
_CASES = f"""gold AS (SELECT m.id, CAST(d.doc_id AS VARCHAR) AS episode_id FROM messages m JOIN documents d ON contains(d.text, m.text) WHERE length(m.text) > 0),
long_words AS (
  SELECT id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM (SELECT id, list_filter({_tokens('text')}, lambda t: length(t) > 3) AS w FROM messages)
), cases AS (
  SELECT m.id, m.message, CASE WHEN g.n IS NULL THEN 'refusal' WHEN g.n > 1 THEN 'cross_episode' ELSE 'factual' END AS category,
    coalesce(g.e, []) AS expected, w[1:3] AS must_retrieve, g.n IS NULL AS refusal
  FROM messages m JOIN long_words USING (id) LEFT JOIN (SELECT id, count(*) AS n, list(episode_id ORDER BY episode_id) AS e FROM gold GROUP BY id) g USING (id)
)"""

_METRICS = f"""{_SEARCH}, {_CASES}, contexts AS (
  SELECT query_id AS id, string_agg(text, ' ' ORDER BY rank) AS context, list(DISTINCT episode_id) AS episodes, count(*) AS n FROM hits GROUP BY query_id
), metrics AS (
  SELECT c.*, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_filter(expected, lambda e: list_contains(episodes, e))) / CAST(len(expected) AS DOUBLE) END AS episode_hit,
    CASE WHEN len(must_retrieve) = 0 THEN 1.0 ELSE (SELECT avg(CASE WHEN {_contains('x.context', 't.term')} THEN 1.0 ELSE 0.0 END)
      FROM (SELECT unnest(c.must_retrieve) AS term) t) END AS term_coverage,
    n AS num_retrieved, len(episodes) AS num_episodes_retrieved, d.top_score, d.max_dense_similarity, d.not_covered
  FROM cases c JOIN contexts x USING (id) JOIN diagnostics d ON d.query_id = c.id
), checks AS (
  SELECT *, CASE WHEN refusal THEN not_covered END AS evidence_gate_fired, CASE WHEN NOT refusal THEN episode_hit >= 0.999 END AS retrieved_expected_episode,
    CASE WHEN NOT refusal THEN term_coverage >= 0.5 END AS term_coverage_ok, CASE WHEN NOT refusal THEN NOT not_covered END AS evidence_gate_open,
    list_filter([CASE WHEN refusal AND NOT not_covered THEN 'evidence gate did not fire for an out-of-scope question (max similarity ' || printf('%.3f', round(max_dense_similarity, 3)) || ')' END,
      CASE WHEN NOT refusal AND episode_hit < 0.999 THEN 'missed expected episode(s) (hit ' || CAST(CAST(round_even(episode_hit * 100, 0) AS INTEGER) AS VARCHAR) || '%)' END,
      CASE WHEN NOT refusal AND term_coverage < 0.5 THEN 'retrieved passages covered only ' || CAST(CAST(round_even(term_coverage * 100, 0) AS INTEGER) AS VARCHAR) || '% of the expected terms' END,
      CASE WHEN NOT refusal AND not_covered THEN 'evidence gate wrongly refused an answerable question' END], lambda f: f IS NOT NULL) AS failures
  FROM metrics
), run AS (
  SELECT *, coalesce(evidence_gate_fired, true) AND coalesce(retrieved_expected_episode, true) AND coalesce(term_coverage_ok, true)
    AND coalesce(evidence_gate_open, true) AS passed FROM checks
)"""

_SUMMARY = """SELECT count(*) AS num_cases, count_if(passed) AS passed, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate, 0 AS errors,
  round(coalesce(avg(CASE WHEN NOT refusal THEN episode_hit END), 0.0), 4) AS mean_episode_hit,
  round(coalesce(avg(CASE WHEN NOT refusal THEN term_coverage END), 0.0), 4) AS mean_term_coverage, round(avg(top_score), 6) AS mean_top_score,
  count_if(refusal) AS num_refusal_cases, round(coalesce(avg(CASE WHEN refusal THEN CAST(passed AS INTEGER) END), 0.0), 4) AS refusal_accuracy,
  count_if(NOT refusal AND not_covered) AS false_refusals FROM run"""

# answers made from the hits, their citations and checks, as in fixtures.raw_answers and plans.ask
_ANSWERS = f"""{_METRICS}, raws AS (
  SELECT m.id AS answer_id, m.message, CASE WHEN not_covered AND k < 2 THEN 'not_covered: nothing here speaks to that.'
    WHEN not_covered THEN 'Sorry. {fv.NOT_COVERED_MARKER} ' || claims ELSE claims END AS raw_answer
  FROM (SELECT *, length(message) % 5 AS k FROM messages) m JOIN diagnostics d ON d.query_id = m.id JOIN (
    SELECT query_id, string_agg(words || '  (Ep. "' || title || '" ' || {_stamp('a')} || '-' || {_stamp('z')} || ').', ' ' ORDER BY rank) AS claims FROM (
      SELECT query_id, rank, array_to_string(string_split(text, ' ')[1:6], ' ') AS words, episode_title || CASE WHEN k = 1 THEN ' (lost)' ELSE '' END AS title,
        CASE k WHEN 2 THEN 3540.0 WHEN 3 THEN "end" + 30.0 WHEN 4 THEN "end" + 1.0 ELSE start END AS a,
        CASE k WHEN 2 THEN 3570.0 WHEN 3 THEN "end" + 60.0 WHEN 4 THEN start ELSE "end" + 1.0 END AS z
      FROM (SELECT h.*, length(message) % 5 AS k FROM hits h JOIN messages m ON m.id = h.query_id) WHERE rank <= 3)
    GROUP BY query_id) c ON c.query_id = m.id
), bare AS (SELECT *, trim(raw_answer, {_quoted(_WHITESPACE)}) AS b FROM raws),
marked AS (
  SELECT answer_id, message, raw_answer, starts_with(upper(b), '{fv.NOT_COVERED_MARKER}') OR contains(b, '{fv.NOT_COVERED_MARKER}') AS not_covered,
    CASE WHEN starts_with(upper(b), '{fv.NOT_COVERED_MARKER}') THEN coalesce(nullif(ltrim(substr(b, {len(fv.NOT_COVERED_MARKER) + 1}), ' :-' || chr(10)), ''), {_quoted(fv.NOT_COVERED_MESSAGE)})
      WHEN contains(b, '{fv.NOT_COVERED_MARKER}') THEN trim(replace(b, '{fv.NOT_COVERED_MARKER}', ''), {_quoted(_WHITESPACE)}) ELSE b END AS answer
  FROM bare
), found AS (
  SELECT answer_id, unnest(range(0, len(r))) AS pos, unnest(r) AS raw, trim(unnest(t)) AS title, unnest(s) AS s, unnest(e) AS e FROM (
    SELECT answer_id, regexp_extract_all(answer, {_quoted(fv.CITATION_PATTERN)}, 0) AS r, regexp_extract_all(answer, {_quoted(fv.CITATION_PATTERN)}, 1) AS t,
      regexp_extract_all(answer, {_quoted(fv.CITATION_PATTERN)}, 2) AS s, regexp_extract_all(answer, {_quoted(fv.CITATION_PATTERN)}, 3) AS e FROM marked)
), citations AS (
  SELECT answer_id, CAST(pos AS INTEGER) AS pos, title, raw, @A@ AS start, @Z@ AS "end" FROM found
), validated AS (
  SELECT c.*, CASE WHEN d.doc_id IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) END AS episode_id,
    CASE WHEN c."end" <= c.start THEN '{fv.REASON_MALFORMED}' WHEN shown IS NULL THEN '{fv.REASON_NOT_RETRIEVED}'
      WHEN c.start > length(d.text) / 16.0 THEN '{fv.REASON_BEYOND_END}' WHEN NOT meets THEN '{fv.REASON_NO_OVERLAP}' END AS reason
  FROM citations c LEFT JOIN (SELECT c.answer_id, c.pos, true AS shown, bool_or(c.start <= h."end" + 5 AND c."end" >= h.start - 5) AS meets
    FROM citations c JOIN hits h ON h.query_id = c.answer_id AND lower(h.episode_title) = lower(c.title) GROUP BY ALL) s ON s.answer_id = c.answer_id AND s.pos = c.pos
  LEFT JOIN documents d ON 'doc ' || d.doc_id = lower(c.title)
), answers AS (
  SELECT m.answer_id, m.message, m.not_covered, coalesce(n, 0) AS num_citations, coalesce(bad, 0) AS num_invalid, coalesce(reasons, '') AS reasons,
    CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE (n - bad) / CAST(n AS DOUBLE) END AS citation_validity,
    trim(CASE WHEN coalesce(bad, 0) > 0 THEN regexp_replace(list_reduce(list_prepend(answer, bads), lambda x, y: replace(x, y, '')), '[ \\t]{{2,}}', ' ', 'g') ELSE answer END,
      {_quoted(_WHITESPACE)}) AS answer
  FROM marked m LEFT JOIN (SELECT answer_id, count(*) AS n, count(reason) AS bad, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons,
    list(raw ORDER BY pos) FILTER (WHERE reason IS NOT NULL) AS bads FROM validated GROUP BY answer_id) v ON v.answer_id = m.answer_id
), openings AS (
  SELECT g.id, {_tokens('substr(d.text, 1, 400)')}[1:3] AS words FROM (SELECT id, min(episode_id) AS episode_id FROM gold GROUP BY id) g
  JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.episode_id
), claims AS (
  SELECT id, unnest(c) AS claim, unnest(range(0, len(c))) AS place FROM (
    SELECT id, list_filter(list_concat([{_tokens('n.text')}[-1], l.w[1]], coalesce(o.words, [])), lambda c: c IS NOT NULL) AS c
    FROM messages m JOIN long_words l USING (id) LEFT JOIN openings o USING (id) LEFT JOIN benchmark n ON n.item_id = m.item_id + 1)
), leaked AS (
  SELECT c.id, c.claim, c.place FROM claims c JOIN answers a ON a.answer_id = c.id JOIN messages m ON m.id = c.id
  WHERE {_contains('a.answer', 'c.claim')} AND NOT {_contains("CASE WHEN length(m.text) % 2 = 0 THEN 'Hello there. ' ELSE '' END || m.message", 'c.claim')}
), graded AS (
  SELECT 'case_' || doc_id AS id, * EXCLUDE (doc_id) FROM ({_GRADES}) WHERE faithfulness IS NOT NULL
), full_checks AS (
  SELECT t.id, t.category, t.refusal, t.episode_hit, t.term_coverage, t.top_score, a.answer, a.not_covered, a.num_citations, a.num_invalid, a.citation_validity, a.reasons,
    length(trim(a.answer)) > 0 AS non_empty_answer, CASE WHEN refusal THEN a.not_covered END AS refused_correctly,
    CASE WHEN NOT refusal THEN NOT a.not_covered END AS answered_when_covered, l.names IS NULL AS no_forbidden_claims,
    CASE WHEN NOT refusal AND NOT a.not_covered THEN a.num_citations > 0 END AS has_citation, a.num_invalid = 0 AS citations_valid,
    CASE WHEN NOT refusal THEN t.episode_hit >= 0.999 END AS retrieved_expected_episode, l.names, g.* EXCLUDE (id)
  FROM metrics t JOIN answers a ON a.answer_id = t.id LEFT JOIN (SELECT id, list(claim ORDER BY place) AS names FROM leaked GROUP BY id) l ON l.id = t.id LEFT JOIN graded g ON g.id = t.id
), answered AS (
  SELECT *, checks_passed AND coalesce(judge_passed, true) AS passed FROM (SELECT *, non_empty_answer AND coalesce(refused_correctly, true) AND coalesce(answered_when_covered, true)
    AND no_forbidden_claims AND coalesce(has_citation, true) AND citations_valid AND coalesce(retrieved_expected_episode, true) AS checks_passed FROM full_checks)
)""".replace(
    "@A@", "list_reduce(list_transform(string_split(s, ':'), lambda x: CAST(x AS DOUBLE)), lambda x, y: x * 60 + y)",
).replace(
    "@Z@", "list_reduce(list_transform(string_split(e, ':'), lambda x: CAST(x AS DOUBLE)), lambda x, y: x * 60 + y)",
)
_MEANS = ", ".join(f"round(coalesce(avg({n}), 0.0), 3) AS mean_{n}" for n in ("faithfulness", "completeness", "citation_correctness", "refusal_correctness", "clarity"))
_REPORT = f"""SELECT count(*) AS num_cases, count_if(passed) AS passed, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate, 0 AS errors,
  round(coalesce(avg(CASE WHEN NOT refusal THEN episode_hit END), 0.0), 4) AS mean_episode_hit,
  round(coalesce(avg(CASE WHEN NOT refusal THEN term_coverage END), 0.0), 4) AS mean_term_coverage, round(avg(top_score), 6) AS mean_top_score,
  count_if(refusal) AS num_refusal_cases, round(coalesce(avg(CASE WHEN refusal THEN CAST(passed AS INTEGER) END), 0.0), 4) AS refusal_accuracy,
  count_if(NOT refusal AND not_covered) AS false_refusals, round(avg(citation_validity), 4) AS mean_citation_validity,
  CAST(sum(num_citations) AS BIGINT) AS total_citations, CAST(sum(num_invalid) AS BIGINT) AS invalid_citations,
  count_if(NOT no_forbidden_claims) AS forbidden_claim_violations, CAST(coalesce(sum(num_unsupported), 0) AS BIGINT) AS judge_unsupported_claims,
  count(faithfulness) AS num_judged, round(coalesce(avg(CAST(judge_passed AS INTEGER)), 0.0), 4) AS judge_pass_rate, {_MEANS},
  round(avg(length(answer)), 1) AS mean_ms, round(CAST(max(length(answer)) AS DOUBLE), 1) AS max_ms, round(sum(round(length(answer) / 1000.0, 3)), 6) AS estimated_usd FROM answered"""


_SCOPED = f"""{_POSTINGS}, {_ASKED}, {_CASES}, scopes AS (SELECT id AS query_id, min(episode_id) AS scope FROM gold GROUP BY id),
scored AS (
  SELECT a.query_id, chunk_id, any_value(episode_id) AS episode_id, any_value(scope) AS scope,
    sum(idf * qtf * 2.5 * (tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean_length)))) AS raw
  FROM asked a LEFT JOIN scopes USING (query_id) JOIN stats USING (term) JOIN postings USING (term), facts GROUP BY a.query_id, chunk_id
), rounded AS (SELECT *, round(raw, 4) AS bm25_score FROM scored WHERE raw > 0)"""
_RANK = "SELECT query_id, chunk_id, bm25_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS INTEGER) AS bm25_rank"

_PLANNED = f"""{_HISTORY}, planned AS (
  SELECT t.conv_id, t.turn, t.question, count(s.role) > 0 AND {_dependent('any_value(t.question)')} AS rewrite,
    max_by(s.content, s.place) AS last_content, count(s.role) AS n_messages
  FROM turns t LEFT JOIN said s ON s.conv_id = t.conv_id AND s.turn = t.turn AND s.back <= 8 GROUP BY t.conv_id, t.turn, t.question
), lines AS (
  SELECT conv_id, turn, place, CASE role WHEN 'user' THEN 'Learner' ELSE 'Assistant' END || ': ' ||
    CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '...' ELSE content END AS line
  FROM said WHERE back <= 8 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY place DESC) <= 4
), spoken AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY place) AS spoken FROM lines GROUP BY ALL)"""


def _manifest() -> str:
    from workload.fixtures import SETTINGS

    return _MANIFEST.format(fingerprint=SETTINGS.asr_fingerprint)


_SUFFIXES = ", ".join(f"'{s}'" for s in fv.MEDIA_SUFFIXES)

ORACLES: dict[str, str] = {
    "catalogue_scan": f"WITH {_FILES} SELECT name, size, size = 0 AS rejected FROM files "
    rf"WHERE lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) IN ({_SUFFIXES}) AND NOT starts_with(name, '.')",
    "content_hash": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "slug_ids": rf"WITH {_FILES} SELECT name, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(name, '^(.+)\.[^.]+$', '\1')), "
    rf"'[^a-z0-9]+', '_', 'g'), '_'), ''), '{fv.FALLBACK_EPISODE_ID}') AS slug FROM files",
    "tokenized": "WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?'), "
    f"lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS w FROM documents) "
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t",
    "manifest_current": f"WITH {_manifest()} SELECT episode_id, sha256, asr_fingerprint FROM current",
    "prune_removed": f"WITH {_manifest()} SELECT episode_id, title FROM current WHERE episode_id NOT IN "
    "(SELECT CAST(doc_id AS VARCHAR) FROM documents)",
    "ingest_plan": f"WITH {_manifest()}, p AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, sha256(text) AS sha256, "
    "length(text) / 16.0 >= 20 AS stored FROM documents), r AS (SELECT p.episode_id, p.sha256, CASE WHEN c.sha256 IS NULL THEN 'new' "
    "WHEN c.sha256 <> p.sha256 THEN 'content changed' "
    "WHEN c.asr_fingerprint <> (SELECT max(asr_fingerprint) FROM current WHERE starts_with(episode_id, 'page_')) "
    "THEN 'configuration changed' WHEN NOT p.stored THEN 'transcript missing' END AS reason "
    "FROM p LEFT JOIN current c USING (episode_id)) "
    "SELECT episode_id, sha256, CASE WHEN reason IS NULL THEN 'reuse' ELSE 'transcribe' END AS action, reason FROM r",
    "llm_cost": f"WITH {_CALLS} SELECT event_id, model, round(cost_usd, 9) AS cost_usd FROM priced",
    "llm_cost_by_case": f"WITH {_CALLS} SELECT case_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
    "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM priced GROUP BY case_id",
    "stage_latency": "SELECT event_type AS stage, count(*) AS n, round(avg(value), 3) AS mean_ms, max(value) AS max_ms, "
    "round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type",
    "judge_passes": _GRADES,
    "judge_summary": f"SELECT count(*) AS num_judged, round(coalesce(avg(CAST(judge_passed AS DOUBLE)), 0), 4) AS judge_pass_rate, "
    "round(avg(faithfulness), 3) AS mean_faithfulness, round(avg(completeness), 3) AS mean_completeness, "
    "round(avg(citation_correctness), 3) AS mean_citation_correctness, round(avg(refusal_correctness), 3) AS mean_refusal_correctness, "
    f"round(avg(clarity), 3) AS mean_clarity FROM ({_GRADES}) WHERE faithfulness IS NOT NULL",
    "last_turns": f"WITH {_TURNS} SELECT conv_id, max(turn) AS turn, arg_max(question, turn) AS question, "
    "max_by(struct_pack(a := answer), turn).a AS answer, count(*) AS num_turns FROM turns GROUP BY conv_id",
    "scored_turns": "SELECT conv_id, arg_max(text, turn) AS scored_input, max(turn) AS turn FROM conversations "
    "WHERE role = 'user' GROUP BY conv_id",
    "sticky_scopes": f"WITH {_TURNS}, r AS (SELECT conv_id, turn, CASE WHEN length(question) % 5 = 0 "
    "THEN 'src' || length(question) % 20 WHEN length(question) % 5 = 1 THEN '' END AS q FROM turns) "
    "SELECT conv_id, turn, nullif(last_value(q IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS scope FROM r",
    "redacted": """WITH k AS (SELECT event_id, event_type || '_Token' AS t FROM events)
SELECT e.event_id, array_to_string(['K', k.t, 'api_key'], ',') AS keys,
  array_to_string([json_extract_string(props, '$.k'), '<redacted>', '<redacted>'], '|') AS vals FROM events e JOIN k USING (event_id)""",
    "stream_latency": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS stage, count(*) AS n, max(value) AS max_ms, "
    "round(sum(value), 4) AS sum_ms FROM events GROUP BY ALL",
    "clean_segments": _SEGMENTS,
    "read_transcript_files": _SEGMENTS,
    "chunk_passages": _CHUNK_ROWS,
    "long_passages": _CHUNK_ROWS,
    "stream_chunks": _CHUNK_ROWS,
    "chunk_store_roundtrip": _CHUNK_IDS,
    "stream_ingest": f"WITH RECURSIVE {_chunks('size % 5 <> 2 AND (size % 5 <> 1 OR k > 1)')} "
    'SELECT chunk_id, episode_id, start, "end", text FROM chunks',
    "transcript_texts": f"WITH RECURSIVE {_chunks()} SELECT CAST(d.doc_id AS VARCHAR) AS episode_id, "
    "md5(coalesce(string_agg(s.text, ' ' ORDER BY s.i), '')) AS text_md5 FROM documents d LEFT JOIN seg s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
    "per_episode_stats": f"WITH RECURSIVE {_chunks()}, c AS (SELECT episode_id, count(*) AS n, round(avg(\"end\" - start), 1) AS m FROM chunks GROUP BY ALL), "
    "g AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, count(*) AS n FROM seg GROUP BY doc_id) "
    "SELECT CAST(doc_id AS VARCHAR) AS episode_id, coalesce(g.n, 0) AS num_segments, coalesce(c.n, 0) AS num_chunks, "
    "coalesce(c.m, 0.0) AS mean_chunk_seconds FROM documents LEFT JOIN g ON g.episode_id = CAST(doc_id AS VARCHAR) "
    "LEFT JOIN c ON c.episode_id = CAST(doc_id AS VARCHAR)",
    "episode_catalogue": f"WITH RECURSIVE {_chunks()}, c AS (SELECT episode_id, count(*) AS n FROM chunks GROUP BY ALL), "
    "g AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, count(*) AS n FROM seg GROUP BY doc_id) "
    "SELECT CAST(doc_id AS VARCHAR) AS episode_id, 'Doc ' || doc_id AS title, source || '/' || doc_id || '.txt' AS source_file, "
    "length(text) / 16.0 AS duration, sha256(text) AS sha256, CAST(coalesce(g.n, 0) AS INTEGER) AS num_segments, "
    "CAST(coalesce(c.n, 0) AS INTEGER) AS num_chunks FROM documents LEFT JOIN g ON g.episode_id = CAST(doc_id AS VARCHAR) "
    "LEFT JOIN c ON c.episode_id = CAST(doc_id AS VARCHAR)",
    "bm25_stats": f"WITH RECURSIVE {_POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "bm25_top": f"WITH RECURSIVE {_BM25} SELECT * FROM lexical",
    "bm25_top_blocks": f"WITH RECURSIVE {_BM25} SELECT * FROM lexical",
    "embed_passages": f"WITH RECURSIVE {_POSTINGS}, {_ASKED}, {_DENSE} SELECT chunk_id, CAST(r.slot AS INTEGER) AS slot, round(coalesce(v, 0), 5) AS v "
    "FROM chunks CROSS JOIN (SELECT unnest(range(0, 64)) AS slot) r LEFT JOIN pv ON pv.id = chunk_id AND pv.slot = r.slot",
    "dense_top": f"WITH RECURSIVE {_POSTINGS}, {_ASKED}, {_DENSE} SELECT * FROM dense",
    "rrf_scores": f"WITH RECURSIVE {_BM25}, {_DENSE} SELECT query_id, chunk_id AS item_id, round(sum(1.0 / (60 + r)), 8) AS score "
    "FROM (SELECT query_id, chunk_id, bm25_rank AS r FROM lexical UNION ALL SELECT query_id, chunk_id, dense_rank FROM dense) GROUP BY ALL",
    "rrf_fused": f"WITH RECURSIVE {_BM25}, {_DENSE} SELECT * EXCLUDE (raw), CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, dense_rank NULLS LAST, "
    "bm25_rank NULLS LAST, chunk_id) AS INTEGER) AS fused_rank, round(raw, 8) AS score FROM (SELECT coalesce(d.query_id, l.query_id) AS query_id, "
    "coalesce(d.chunk_id, l.chunk_id) AS chunk_id, dense_rank, dense_score, bm25_rank, bm25_score, "
    "coalesce(1.0 / (60 + dense_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0) AS raw "
    "FROM dense d FULL JOIN lexical l ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id)",
    "normalized_queries": f"WITH {_MESSAGES} SELECT id, {_normal('message')} AS topic FROM messages",
    "message_modes": f"WITH {_MESSAGES}, b AS (SELECT id, message AS m FROM messages UNION ALL SELECT conv_id || ':' || turn, text FROM conversations) "
    f"SELECT id, {_mode('m')} AS mode, {_dependent('m')} AS context_dependent FROM b",
    "turn_history": f"WITH {_HISTORY} SELECT t.conv_id, t.turn, count(s.role) AS n_messages, md5(coalesce(string_agg(CASE WHEN s.role IS NOT NULL "
    "THEN s.role || coalesce('=' || s.content, '') END, chr(10) ORDER BY s.place), '')) AS history_md5, count(s.role) > 0 AS is_followup "
    "FROM turns t LEFT JOIN said s ON s.conv_id = t.conv_id AND s.turn = t.turn AND s.back <= 4 GROUP BY ALL",
    "outline": f"WITH RECURSIVE {_chunks()} SELECT episode_id, episode_title AS title, chunk_id, start, \"end\", "
    f"{_stamp('start')} || '{fv.EN_DASH}' || {_stamp(chr(34) + 'end' + chr(34))} AS timestamp, substr(text, 1, 200) AS preview FROM chunks",
    "dense_top_vectors": """WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, CAST(CAST(round(avg(CAST(x AS DOUBLE)), 6) AS FLOAT) AS DOUBLE) AS v FROM x GROUP BY ALL),
s AS (SELECT 'label_' || m.label AS query_id, CAST(x.vec_id AS VARCHAR) AS chunk_id, round(sum(m.v * CAST(x.x AS DOUBLE)), 4) AS dense_score
  FROM m JOIN x ON x.i = m.i GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS INTEGER) AS dense_rank FROM s QUALIFY dense_rank <= 20""",
    "reranked": f"WITH RECURSIVE {_SEARCH} SELECT query_id, chunk_id, CAST(fused_rank AS INTEGER) AS fused_rank, rerank_score, CAST(pool_rank AS INTEGER) AS pool_rank FROM ranked",
    "hybrid_search": f"WITH RECURSIVE {_SEARCH} SELECT query_id, rank, chunk_id, episode_id, round(score, 6) AS score, dense_rank, bm25_rank, dense_score, bm25_score, rerank_score FROM hits",
    "query_diagnostics": f"WITH RECURSIVE {_SEARCH} SELECT * EXCLUDE (not_covered) REPLACE (round(top_score, 6) AS top_score) FROM diagnostics",
    "episodes_found": f"WITH RECURSIVE {_SEARCH}, t AS (SELECT query_id, episode_title, min(rank) AS r FROM hits GROUP BY ALL) "
    "SELECT h.query_id, string_agg(DISTINCT episode_id, ',' ORDER BY episode_id) AS episode_ids, any_value(e.episodes) AS episodes FROM hits h "
    "JOIN (SELECT query_id, string_agg(episode_title, '|' ORDER BY r) AS episodes FROM t GROUP BY query_id) e USING (query_id) GROUP BY h.query_id",
    "gate_calibration": f"WITH RECURSIVE {_SEARCH} SELECT * FROM gate",
    "probe_best_scores": f"WITH RECURSIVE {_SEARCH} SELECT * FROM probe_best",
    "evidence_gate": f"WITH RECURSIVE {_SEARCH} SELECT query_id, not_covered AS by_gate, max_dense_similarity < 0.3 AS by_cosine, false AS unknown, true AS no_hits FROM diagnostics",
    "balanced_top": f"WITH RECURSIVE {_SEARCH}, s AS (SELECT query_id, chunk_id, split_part(source_file, '/', 1) AS episode_id, rerank_score, pool_rank FROM ranked), "
    "d AS (SELECT *, row_number() OVER w AS depth, first_value(rerank_score) OVER w AS head, first_value(pool_rank) OVER w AS head_rank FROM s "
    "WINDOW w AS (PARTITION BY query_id, episode_id ORDER BY pool_rank)) SELECT query_id, chunk_id, episode_id, "
    "CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth, head DESC, head_rank) AS INTEGER) AS rank FROM d QUALIFY rank <= 5",
    "index_meta": f"WITH RECURSIVE {_SEARCH} SELECT count(*) AS num_chunks, count(DISTINCT episode_id) AS num_episodes, 64 AS embed_dimension, "
    "(SELECT relevance_gate FROM gate) AS relevance_gate FROM chunks",
    "contained_terms": f"WITH {_MESSAGES}, {_CASES} SELECT c.id, g.episode_id, t.term, {_contains('d.text', 't.term')} AS found FROM (SELECT id, unnest(must_retrieve) AS term FROM cases) t "
    "JOIN cases c USING (id) JOIN gold g USING (id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.episode_id",
    "scoped_search": f"WITH RECURSIVE {_SCOPED} {_RANK} FROM rounded WHERE scope IS NULL OR scope = episode_id QUALIFY bm25_rank <= 20",
    "scoped_search_post_filter": f"WITH RECURSIVE {_SCOPED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS place FROM rounded) "
    f"{_RANK} FROM p WHERE (scope IS NULL AND place <= 20) OR (place <= 60 AND scope = episode_id) QUALIFY bm25_rank <= 20",
    "episode_hit": f"WITH RECURSIVE {_METRICS} SELECT id, round(episode_hit, 6) AS episode_hit FROM metrics",
    "retrieval_metrics": f"WITH RECURSIVE {_METRICS} SELECT id, round(episode_hit, 6) AS episode_hit, round(term_coverage, 6) AS term_coverage, num_retrieved, "
    "num_episodes_retrieved, round(top_score, 6) AS top_score, max_dense_similarity FROM metrics",
    "retrieval_checks": f"WITH RECURSIVE {_METRICS} SELECT id, evidence_gate_fired, retrieved_expected_episode, term_coverage_ok, evidence_gate_open, "
    "array_to_string(failures, '; ') AS failures, passed AS checks_passed FROM run",
    "eval_retrieval": f"WITH RECURSIVE {_METRICS} SELECT id, category, passed, round(episode_hit, 6) AS episode_hit, round(term_coverage, 6) AS term_coverage, not_covered FROM run",
    "eval_summary": f"WITH RECURSIVE {_METRICS} {_SUMMARY}",
    "refusal_metrics": f"WITH RECURSIVE {_METRICS} SELECT num_refusal_cases, refusal_accuracy, false_refusals FROM ({_SUMMARY})",
    "eval_by_category": f"WITH RECURSIVE {_METRICS} SELECT category, count(*) AS total, count_if(passed) AS passed, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate "
    "FROM run GROUP BY ROLLUP (category)",
    "eval_category_cases": f"WITH RECURSIVE {_METRICS} SELECT category, id, passed, array_to_string(failures, '; ') AS failures FROM run",
    "rewrite_plan": f"WITH {_PLANNED} SELECT conv_id, turn, rewrite, CASE WHEN rewrite AND length(o) BETWEEN 1 AND 300 THEN o ELSE question END AS query "
    "FROM (SELECT *, regexp_split_to_array(trim(trim(last_content, '" + _WHITESPACE.replace("'", "''") + "'), '\"'), '\\r\\n|[\\n\\r]')[1] AS o FROM planned)",
    "rewrite_contexts": f"WITH {_PLANNED} SELECT p.conv_id, p.turn, md5('CONVERSATION SO FAR:' || chr(10) || coalesce(spoken, '(no prior turns)') || chr(10) || chr(10) "
    "|| 'FOLLOW-UP MESSAGE: ' || question || chr(10) || chr(10) || 'Standalone search query:') AS prompt_md5 FROM planned p LEFT JOIN spoken USING (conv_id, turn)",
    "ingest_stats": f"WITH RECURSIVE {_chunks()}, {_manifest()}, p AS (SELECT CAST(d.doc_id AS VARCHAR) AS episode_id, length(text) / 16.0 AS duration, "
    "c.sha256 IS NOT NULL AND c.sha256 = sha256(d.text) AND c.asr_fingerprint = (SELECT max(asr_fingerprint) FROM current WHERE starts_with(episode_id, 'page_')) "
    "AND length(text) / 16.0 >= 20 AS reuse FROM documents d LEFT JOIN current c ON c.episode_id = CAST(d.doc_id AS VARCHAR)) "
    "SELECT count(*) AS episodes, count_if(NOT reuse) AS transcribed, count_if(reuse) AS reused, round(sum(duration), 1) AS total_audio_seconds, "
    "(SELECT count(*) FROM seg) AS total_segments, (SELECT count(*) FROM chunks) AS total_chunks FROM p",
    "dense_top_scoped": f"WITH RECURSIVE {_POSTINGS}, {_ASKED}, {_CASES}, {_DENSE.replace('QUALIFY dense_rank <= 20', '')}, o AS ("
    "SELECT id AS query_id, min(episode_id) AS scope FROM gold GROUP BY id) SELECT d.query_id, d.chunk_id, d.dense_score, "
    "CAST(row_number() OVER (PARTITION BY d.query_id ORDER BY d.dense_score DESC, d.chunk_id) AS INTEGER) AS dense_rank FROM dense d "
    "JOIN chunks c USING (chunk_id) LEFT JOIN o ON o.query_id = d.query_id WHERE scope IS NULL OR scope = c.episode_id "
    "QUALIFY row_number() OVER (PARTITION BY d.query_id ORDER BY d.dense_score DESC, d.chunk_id) <= 20",
    "capped_context": f"WITH RECURSIVE {_SEARCH} SELECT query_id, rank, chunk_id FROM hits "
    "QUALIFY rank = 1 OR sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) <= 3000",
    "rendered_context": f"WITH RECURSIVE {_SEARCH} SELECT query_id, md5(string_agg('[Passage ' || rank || ']' || chr(10) || 'Episode: \"' || episode_title || '\"' "
    f"|| chr(10) || 'Timestamp: ' || {_stamp('start')} || '{fv.EN_DASH}' || {_stamp(chr(34) + 'end' + chr(34))} || chr(10) || 'Transcript: ' || text, "
    "chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits GROUP BY query_id",
    "validated_cases": f"WITH {_MESSAGES}, r AS (SELECT coalesce(nullif(CASE WHEN length(text) % 3 <> 0 THEN {_tokens('text')}[1] END, ''), 'case_' || item_id) AS id, "
    "length(text) % 7 <> 0 AS asked FROM messages) SELECT id, 'duplicate case id: ' || id AS problem FROM r GROUP BY id HAVING count(*) > 1 "
    "UNION ALL SELECT id, 'case ''' || id || ''' has neither ''input'' nor ''turns''' FROM r WHERE NOT asked",
    "batch_complete": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS request_id, length(text) AS n FROM documents), b AS (SELECT *,
  '{"faithfulness": ' || n % 6 || ', "completeness": "' || n % 4 || '", "citation_correctness": 4.5, "refusal_correctness": null, "clarity": 9, '
  || '"unsupported_claims": ["a {b}", "c"], "rationale": "len ' || n || '"}' AS body FROM d)
SELECT request_id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN n % 5 = 1 THEN 'Here you go: ' || body || ' Done.'
    WHEN n % 5 = 2 THEN substr(body, 1, length(body) - 1) WHEN n % 5 = 3 THEN 'no grades' ELSE body END AS text,
  CASE WHEN n % 7 <> 0 THEN 'gpt-4o' END AS model, CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS input_tokens, CASE WHEN n % 7 = 0 THEN 0 ELSE 10 END AS output_tokens,
  CAST(NULL AS VARCHAR) AS usage_cost, CASE WHEN n % 7 = 0 THEN 'ValueError: no reply' END AS error FROM b""",
    "formatted_times": f"WITH RECURSIVE {_chunks()} SELECT CAST(doc_id AS VARCHAR) AS episode_id, CAST(id AS INTEGER) AS id, {_stamp('start * 10')} AS ts, "
    f"{_stamp('start')} || '{fv.EN_DASH}' || {_stamp('stop')} AS range, "
    "CASE WHEN d >= 3600 THEN d // 3600 || 'h ' || lpad(CAST(d % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN d >= 60 THEN d // 60 || 'm ' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || 's' "
    "ELSE d || 's' END AS duration, floor(start * 10) AS parsed, floor(stop) + CAST('0.' || id AS DOUBLE) AS parsed_fraction, "
    f"CASE WHEN regexp_matches(p, {_quoted(fv.TIMESTAMP_PATTERN)}) THEN coalesce(try_cast(regexp_extract(p, {_quoted(fv.TIMESTAMP_PATTERN)}, 1) AS DOUBLE), 0.0) * 3600 "
    f"+ coalesce(try_cast(regexp_extract(p, {_quoted(fv.TIMESTAMP_PATTERN)}, 2) AS DOUBLE), 0.0) * 60 + coalesce(try_cast(regexp_extract(p, {_quoted(fv.TIMESTAMP_PATTERN)}, 3) AS DOUBLE), 0.0) END AS parsed_text "
    f"FROM (SELECT *, CAST(floor(stop * 7) AS BIGINT) AS d, trim(substr(text, 1, 4), {_quoted(_WHITESPACE)}) AS p FROM seg)",
    "render_transcripts": f"WITH RECURSIVE {_chunks()}, h AS (SELECT doc_id, '# Doc ' || doc_id || chr(10) || '# source: ' || source || '/' || doc_id || '.txt' || chr(10) || '# duration: ' "
    "|| CASE WHEN d >= 3600 THEN d // 3600 || 'h ' || lpad(CAST(d % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN d >= 60 THEN d // 60 || 'm ' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || 's' "
    "ELSE d || 's' END || chr(10) || '# asr: local (medium)' || chr(10) AS head FROM (SELECT *, CAST(floor(length(text) / 16.0) AS BIGINT) AS d FROM documents)), "
    f"b AS (SELECT doc_id, string_agg('[' || {_stamp('start')} || '] ' || text, chr(10) ORDER BY i) AS body FROM seg GROUP BY doc_id) "
    "SELECT CAST(doc_id AS VARCHAR) AS episode_id, md5(head || coalesce(chr(10) || body, '')) AS rendered_md5 FROM h LEFT JOIN b USING (doc_id)",
    "resolve_scopes": """WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS episode_id, 'Doc ' || doc_id AS title, row_number() OVER (ORDER BY 'Doc ' || doc_id, doc_id) - 1 AS position FROM documents),
q AS (SELECT item_id AS request_id, CASE length(text) % 6 WHEN 0 THEN ' doc ' || item_id || ' ' WHEN 1 THEN CAST(item_id AS VARCHAR) WHEN 2 THEN 'ALL'
  WHEN 3 THEN CAST(length(text) * 100 AS VARCHAR) WHEN 4 THEN 'DOC ' || length(text) ELSE 'Show ' || item_id END AS argument FROM benchmark),
a AS (SELECT *, trim(argument) AS arg, lower(trim(argument)) IN ('0', 'all', 'none', 'clear', '') AS clears, regexp_matches(trim(argument), '^[0-9]+$') AS is_number FROM q),
f AS (SELECT a.request_id, min_by(e.episode_id, e.position) AS episode_id FROM a JOIN e ON CASE WHEN is_number THEN try_cast(arg AS BIGINT) - 1 = e.position
  ELSE lower(arg) = e.episode_id OR lower(arg) = lower(e.title) END WHERE NOT clears GROUP BY a.request_id)
SELECT a.request_id, argument, f.episode_id, CASE WHEN clears OR f.episode_id IS NOT NULL THEN NULL WHEN is_number THEN 'there is no episode ' || arg
  ELSE 'no episode matches ''' || arg || '''' END AS error FROM a LEFT JOIN f USING (request_id)""",
    "rewritten_turns": f"WITH {_PLANNED}, heard AS (SELECT conv_id, turn, min_by(line, place) AS line FROM lines WHERE starts_with(line, 'Learner: ') GROUP BY ALL), "
    "w AS (SELECT p.*, list_concat(coalesce(list_filter(regexp_split_to_array(split_part(substr(line, 10), chr(10), 1), '\\s+'), lambda x: x <> '')[1:4], []), "
    "list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')[1:12]) AS words FROM planned p LEFT JOIN heard USING (conv_id, turn)), "
    "o AS (SELECT *, trim(array_to_string(words, ' '), '\"') AS offered FROM w) SELECT conv_id || ':' || turn AS query_id, question, "
    "CASE WHEN rewrite AND length(offered) BETWEEN 1 AND 300 THEN offered ELSE question END AS rewritten, n_messages FROM o",
    "stripped_markers": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, answer, not_covered FROM marked",
    "extracted_citations": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, pos, title, start, \"end\", raw, "
    f"{_stamp('start')} || '{fv.EN_DASH}' || {_stamp(chr(34) + 'end' + chr(34))} AS formatted FROM citations",
    "validated_citations": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, pos, title, start, \"end\", raw, episode_id, reason IS NULL AS valid, reason FROM validated",
    "stripped_answers": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, answer, not_covered FROM answers",
    "citation_validity": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, num_citations, num_invalid, round(citation_validity, 6) AS citation_validity FROM answers",
    "failure_reasons": f"WITH RECURSIVE {_ANSWERS} SELECT answer_id, reasons FROM answers",
    "answer_sources": f"WITH RECURSIVE {_ANSWERS}, v AS (SELECT * FROM validated WHERE reason IS NULL) SELECT h.query_id AS answer_id, chunk_id, h.episode_id, h.start, h.\"end\", "
    f"{_stamp('h.start')} || '{fv.EN_DASH}' || {_stamp('h.' + chr(34) + 'end' + chr(34))} AS timestamp, source_file, round(score, 6) AS score "
    "FROM hits h JOIN marked m ON m.answer_id = h.query_id WHERE NOT m.not_covered AND (h.query_id NOT IN (SELECT answer_id FROM v) OR EXISTS (SELECT 1 FROM v "
    "WHERE v.answer_id = h.query_id AND lower(v.title) = lower(h.episode_title) AND v.start <= h.\"end\" + 5 AND v.\"end\" >= h.start - 5))",
    "forbidden_claims": f"WITH RECURSIVE {_ANSWERS} SELECT id, claim FROM leaked",
    "full_checks": f"WITH RECURSIVE {_ANSWERS} SELECT id, non_empty_answer, refused_correctly, answered_when_covered, no_forbidden_claims, has_citation, citations_valid, "
    "retrieved_expected_episode, array_to_string(list_filter([CASE WHEN NOT non_empty_answer THEN 'the answer was empty' END, "
    "CASE WHEN refusal AND NOT not_covered THEN 'out-of-scope question was answered instead of refused' END, "
    "CASE WHEN NOT refusal AND not_covered THEN 'in-scope question was wrongly refused as not covered' END, "
    "CASE WHEN NOT no_forbidden_claims THEN 'used facts not in the episodes: ' || array_to_string(names, ', ') END, "
    "CASE WHEN has_citation = false THEN 'no citation was given for a claim-bearing answer' END, "
    "CASE WHEN num_invalid > 0 THEN num_invalid || ' citation(s) failed validation: ' || reasons END, "
    "CASE WHEN retrieved_expected_episode = false THEN 'retrieval missed expected episode(s) (hit ' || CAST(CAST(round_even(episode_hit * 100, 0) AS INTEGER) AS VARCHAR) || '%)' END], "
    "lambda f: f IS NOT NULL), '; ') AS failures, checks_passed FROM answered",
    "outcomes": f"WITH RECURSIVE {_ANSWERS} SELECT id, category, checks_passed, judge_passed, passed FROM answered",
    "citation_metrics": f"WITH RECURSIVE {_ANSWERS} SELECT mean_citation_validity, total_citations, invalid_citations FROM ({_REPORT})",
    "hallucination_metrics": f"WITH RECURSIVE {_ANSWERS} SELECT forbidden_claim_violations, judge_unsupported_claims FROM ({_REPORT})",
    "eval_latency_cost": f"WITH RECURSIVE {_ANSWERS} SELECT mean_ms, max_ms, estimated_usd FROM ({_REPORT})",
    "run_report": f"WITH RECURSIVE {_ANSWERS} {_REPORT}",
    "selected_cases": f"WITH RECURSIVE {_ANSWERS} SELECT id, category, array_to_string(expected, ',') AS expected_episodes, "
    "array_to_string(must_retrieve, ',') AS must_retrieve, coalesce(f, '') AS forbidden_claims, refusal, NOT refusal AS must_cite "
    "FROM cases LEFT JOIN (SELECT id, string_agg(claim, ',' ORDER BY place) AS f FROM claims GROUP BY id) USING (id) "
    "WHERE category = 'cross_episode' OR id IN ('case_0', 'case_7')",
    "derive_titles": rf"WITH {_FILES}, s AS (SELECT name, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem FROM files), "
    rf"t AS (SELECT *, trim(regexp_replace(translate(regexp_replace(stem, '{fv.TRACK_PREFIX_PATTERN}', ''), '_-', '  '), '\s+', ' ', 'g')) AS t FROM s) "
    "SELECT name, CASE WHEN length(t) = 0 THEN stem WHEN lower(t) = t AND upper(t) <> t THEN array_to_string(list_transform(string_split(t, ''), "
    r"lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '\p{L}') THEN upper(c) ELSE c END), '') ELSE t END AS title FROM t",
}
