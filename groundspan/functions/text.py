"""Text predicates and rewrites as column expressions; all stay in the JVM."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F

from groundspan.functions import fixed_values as fv

# Every character str.strip() treats as white space.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITESPACE))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


# --- lexical tokens ---------------------------------------------------------
def tokenize(text: Column) -> Column:
    """Lower-case word tokens without stop words and one-letter noise."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({fv.TOKEN_PATTERN})"), F.lit(1))
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(fv.STOPWORDS))


def document_tokens(text: Column) -> Column:
    """Tokens of an indexed passage; one placeholder when there are none."""
    return let(
        tokenize(text),
        lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit(fv.EMPTY_DOCUMENT_TOKEN))),
    )


def term_frequencies(tokens: Column) -> Column:
    """``array<struct<term,tf>>`` sorted by term, by run lengths of the sorted tokens.

    Everything happens inside the row, so building postings needs no shuffle.
    """

    def runs(t: Column) -> Column:
        n = F.size(t)
        first = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)),
        )
        return let(
            first,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    F.get(t, p).alias("term"),
                    (F.coalesce(F.get(at, j + 1), n) - p).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


# --- sentence and word tests ------------------------------------------------
def ends_sentence(text: Column) -> Column:
    return F.rtrim(strip_ws(text)).rlike(fv.SENTENCE_END_PATTERN)


def _word_match(alternatives: str) -> str:
    return r"(?iU)\b(?:" + alternatives + r")\b"


def detect_mode(message: Column) -> Column:
    """``locate`` beats ``compare`` beats ``default``."""
    return (
        F.when(message.rlike(_word_match(fv.LOCATE_WORDS)), "locate")
        .when(message.rlike(_word_match(fv.COMPARE_WORDS)), "compare")
        .otherwise("default")
    )


def context_dependent(message: Column) -> Column:
    """True when a message is too short, or refers back to something."""
    stripped = strip_ws(message)
    words = F.when(F.length(stripped) == 0, 0).otherwise(
        F.size(F.split(stripped, r"(?U)\s+"))
    )
    return (words <= 4) | message.rlike(_word_match(fv.CONTEXT_WORDS))


def term_pattern(term: Column) -> Column:
    """Whole-word pattern of a literal term with flexible inner white space."""
    escaped = F.regexp_replace(
        F.lower(term), r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1"
    )
    return F.concat(F.lit(r"(?U)\b"), F.replace(escaped, F.lit(" "), F.lit(r"\s+")), F.lit(r"\b"))


def contains_term(haystack: Column, term: Column) -> Column:
    return F.rlike(F.lower(haystack), term_pattern(term))


def normalize_query(query: Column) -> Column:
    """Drop the request wrapper and register suffix; keep the query if nothing is left."""
    bare = F.regexp_replace(query, "(?iU)" + fv.REQUEST_PREFIX_PATTERN, "")
    bare = F.regexp_replace(bare, "(?iU)" + fv.REGISTER_SUFFIX_PATTERN, "")
    return let(
        strip_chars(bare, " ,"),
        lambda t: F.when(F.length(t) < 2, strip_ws(query)).otherwise(t),
    )


# --- file names -------------------------------------------------------------
def file_suffix(name: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def slug_id(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(file_stem(name)), "[^a-z0-9]+", "_")
    return F.coalesce(
        F.nullif(strip_chars(slug, "_"), F.lit("")), F.lit(fv.FALLBACK_EPISODE_ID)
    )


def _title_case(text: Column) -> Column:
    """Upper-case every letter that does not follow a letter."""
    return let(
        F.split(text, ""),
        lambda chars: F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(
                    (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)
                ).otherwise(c),
            ),
            "",
        ),
    )


def derive_title(name: Column) -> Column:
    stem = file_stem(name)
    title = F.regexp_replace(stem, "(?U)" + fv.TRACK_PREFIX_PATTERN, "")
    title = strip_ws(F.regexp_replace(F.translate(title, "_-", "  "), r"(?U)\s+", " "))
    return let(
        title,
        lambda t: F.when(F.length(t) == 0, stem)
        .when((F.lower(t) == t) & (F.upper(t) != t), _title_case(t))
        .otherwise(t),
    )


# --- model output -----------------------------------------------------------
def marker_found(text: Column) -> Column:
    """Not-covered marker: any case at the start, exact case anywhere."""
    stripped = strip_ws(text)
    return F.upper(stripped).startswith(fv.NOT_COVERED_MARKER) | stripped.contains(
        fv.NOT_COVERED_MARKER
    )


def strip_marker(text: Column) -> Column:
    stripped = strip_ws(text)
    rest = F.ltrim(
        F.substr(stripped, F.lit(len(fv.NOT_COVERED_MARKER) + 1)), F.lit(" :\n-")
    )
    return (
        F.when(
            F.upper(stripped).startswith(fv.NOT_COVERED_MARKER),
            F.when(F.length(rest) == 0, fv.NOT_COVERED_MESSAGE).otherwise(rest),
        )
        .when(
            stripped.contains(fv.NOT_COVERED_MARKER),
            strip_ws(F.replace(stripped, F.lit(fv.NOT_COVERED_MARKER), F.lit(""))),
        )
        .otherwise(stripped)
    )


def redact_map(payload: Column) -> Column:
    """Blank the values of map keys that look like credentials."""
    hints = "|".join(fv.SECRET_KEY_HINTS)
    return F.transform_values(
        payload,
        lambda k, v: F.when(F.lower(k).rlike(hints), fv.REDACTED).otherwise(v),
    )
