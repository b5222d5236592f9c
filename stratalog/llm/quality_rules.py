"""Quality rules, line first, in DataFrame functions only.

Every line that holds a word is judged by itself: repetition of an earlier line, no sentence punctuation, shouting, navigation
(separators between its words), symbols, few different words, boilerplate phrases. Failed lines are removed, and a
document that loses more than ``MOST_LOST`` percent of its text is rejected, as is one that fails the base rules. Rules
on symbols, navigation and phrases run only on documents that hold one of their characters or phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import ORACLE_BLANKS, trimmed

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe to",
    "sign up for", "log in to", "enable javascript", "share this", "read more", "skip to content", "back to top",
)

_WORD = r"'[^\\x20\\x09-\\x0D]+'"
_LINES = "split(text, '\\n', -1)"


#: Lines stay where these hold, for documents on which the guard holds.
_SEPARATORS = "length(x) - length(translate(x, '|>\\u00BB', ''))"
_SYMBOLS = r"#*$%&|<>{}=~^\\\\"
_SPACES = "(length(x) - length(replace(x, ' ', '')) + 1)"
_GUARDED = (
    ("contains(text, '|') OR contains(text, '>') OR contains(text, '\\u00BB')", f"NOT ({_SEPARATORS} >= 2 AND 5 * ({_SEPARATORS}) >= {_SPACES})"),
    (f"rlike(text, '[{_SYMBOLS}]')", f"10 * length(regexp_replace(x, '[^{_SYMBOLS}]+', '')) < length(x)"),
    # Neither repeated windows nor runs of spaces are implied: ten words of two kinds can do without both.
    ("true", f"NOT ({_SPACES} >= 10 AND 4 * size(array_distinct(split(x, ' '))) <= {_SPACES})"),
    (" OR ".join(f"contains(lowered, '{p}')" for p in BOILERPLATE), "NOT (" + " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE) + ")"),
)


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as the struct ``row`` with counts, ``base_failed``, ``kept`` and ``clean_text``.

    A null or word-less text counts zero everywhere, fails the base rules and isn't kept; rows are judged one by one, so
    repeated rows and null ids come out as they went in. Very long texts are judged whole; an empty table gives an empty one;
    other columns come back in ``row``, whatever their names.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("row", "text", F.expr(f"regexp_extract_all(text, {_WORD}, 0)").alias("words"))
    grams = "CASE WHEN size(words) < 3 THEN array() ELSE transform(slice(words, 1, size(words) - 2), (x, i) -> xxhash64(x, get(words, i + 1), get(words, i + 2))) END"
    rows = rows.select("row", "text", F.size("words").cast("bigint").alias("n_words"), F.expr("aggregate(words, 0L, (a, x) -> a + length(x))").alias("word_chars"), F.expr(grams).cast("array<bigint>").alias("grams"))
    # Windows by hash, only where some hash repeats; then the places of repeated ones, whose gaps say how many words they cover.
    rows = rows.withColumn("ranked", F.expr("CASE WHEN size(array_distinct(grams)) < size(grams) THEN sort_array(transform(grams, (g, i) -> struct(g as g, i as i))) END"))
    rows = rows.withColumn("places", F.expr("sort_array(transform(filter(ranked, (x, k) -> coalesce(x.g = get(ranked, k - 1).g, false) OR coalesce(x.g = get(ranked, k + 1).g, false)), x -> x.i))"))
    repeat = "coalesce(aggregate(places, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n), 0L)"
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.select(
        "row", "text", "n_words", "word_chars", F.expr(repeat).alias("n_repeat_words"), F.lower("text").alias("lowered"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as bigint)").alias("n_symbols"),
        F.expr(f"filter({_LINES}, x -> {trimmed('x')} != '')").alias("full"),
    )
    rows = rows.withColumns({"n_dup_lines": F.expr("cast(size(full) - size(array_distinct(full)) as bigint)"), "lines": F.expr(f"transform(full, x -> {trimmed('x')})")})
    rows = rows.withColumn("good", F.expr("filter(array_distinct(lines), x -> rlike(x, '[.!?:;\\u2026]') AND (rlike(x, '\\\\p{Ll}') OR length(x) < 12 OR NOT rlike(x, '\\\\p{Lu}')))"))
    for guard, rule in _GUARDED:
        rows = rows.withColumn("good", F.expr(f"CASE WHEN {guard} THEN filter(good, x -> {rule}) ELSE good END"))
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    total = lambda c: F.expr(f"aggregate({c}, 0L, (a, x) -> a + length(x))")
    enough = 100 * (total("lines") - total("good")) <= MOST_LOST * total("lines")
    verdict = F.struct(*counts, "base_failed", (~F.col("base_failed") & enough).alias("kept"), F.array_join("good", "\n").alias("clean_text"))
    # As a generator's output, so that a filter on the verdict isn't pushed into the projections above and evaluated there anew.
    return rows.select("row", F.inline(F.array(verdict)))


_ORACLE_SEPARATORS = "length(x) - length(translate(x, '|>' || chr(187), ''))"
_ORACLE_SPACES = "(length(x) - length(replace(x, ' ', '')) + 1)"
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS three FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows WHERE three IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM found, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id
), lined AS (
  SELECT doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, {ORACLE_BLANKS}) <> '') AS full_lines
  FROM texts
), lines AS (
  SELECT *, list_transform(full_lines, lambda x: trim(x, {ORACLE_BLANKS})) AS trimmed FROM lined
), judged AS (
  SELECT *, list_filter(list_distinct(trimmed), lambda x: regexp_matches(x, '[.!?:;…]')
      AND (regexp_matches(x, '\p{{Ll}}') OR length(x) < 12 OR NOT regexp_matches(x, '\p{{Lu}}'))
      AND NOT ({_ORACLE_SEPARATORS} >= 2 AND 5 * ({_ORACLE_SEPARATORS}) >= {_ORACLE_SPACES})
      AND 10 * length(regexp_replace(x, '[^#*$%&|<>{{}}=~^\\]+', '', 'g')) < length(x)
      AND NOT ({_ORACLE_SPACES} >= 10 AND 4 * len(list_distinct(string_split(x, ' '))) <= {_ORACLE_SPACES})
      AND NOT ({" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)})) AS good
  FROM lines
), counted AS (
  SELECT j.doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(list_sum(list_transform(trimmed, lambda x: length(x))), 0) AS had, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS has
  FROM judged j LEFT JOIN repeats r ON j.doc_id = r.doc_id
), based AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (had - has) <= {MOST_LOST} * had AS kept
FROM based
"""
