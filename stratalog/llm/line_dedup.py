"""Line dedup over overlapping windows of three lines.

Windows are three consecutive lines that hold a word; lines between them without one belong to the window. A window is
known by two 64-bit hashes of its trimmed lines. Over all documents, the first occurrence of a window by (id, text, line)
stays and every later one covers its lines; covered lines are merged per document and removed. Each distinct line therefore
stays where it stands first.

A passage on one line or two has no such window. Windows of three sentences, of all lines alike, find it: ``without_repeated_passages``
gives both results.

Windows are written; then the repeated ones' first places are counted out and written, and the windows, read again, meet them.
What each text loses is written, then the texts meet it. Each step's shuffles are deleted when it is written, so that no two
of the three large ones (first places, windows, texts) lie on disk together; the written windows, half the texts' size, go before the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import ORACLE_BLANKS, trimmed
from .scratch import Scratch

_TEXT = "coalesce(text, '')"
_LINES = f"split({_TEXT}, '\\n', -1)"


def _sentences(of: str) -> str:
    return rf"split(regexp_replace({of}, '([.!?])([ \t])', '$1\n$2'), '\n', -1)"


def _units(sentences: bool) -> str:
    """The text's lines, or every line's sentences, with their line's number."""
    if not sentences:
        return f"transform({_LINES}, (x, i) -> struct(i as i, x as unit))"
    return f"flatten(transform({_LINES}, (x, i) -> transform({_sentences('x')}, s -> struct(i as i, s as unit))))"


def windows(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """``(id, text_key, start, end, h1, h2)`` for each window of ``docs(id, text)``; places are those of ``_units``."""
    # No sentence spans a line, so the whole text is split at once; hashes are taken of rows, where Spark compiles them.
    units = _sentences(_TEXT) if sentences else _LINES
    lines = docs.select("id", F.xxhash64("text").alias("text_key"), F.expr(units).alias("units"))
    lines = lines.select("id", "text_key", F.expr(f"filter(transform(units, (x, i) -> struct(i as at, {trimmed('x')} as line)), x -> x.line != '')").alias("body"))
    threes = ", ".join(f"slice(body, {k}, greatest(size(body) - 2, 0))" for k in (1, 2, 3))
    each = lines.select("id", "text_key", F.expr(f"explode(arrays_zip({threes}))").alias("w")).selectExpr("id", "text_key", "w.`0` AS a", "w.`1` AS b", "w.`2` AS c")
    return each.selectExpr("id", "text_key", "a.at AS start", "c.at AS end", "xxhash64(a.line, b.line, c.line) AS h1", "xxhash64(c.line, 3, a.line, b.line) AS h2")


def _covers(rows: DataFrame, scratch: Scratch, levels: list[bool]) -> DataFrame:
    """``(of_id, of_key, lines, sentences)``: the units that each of ``rows(id, text)`` loses by the windows of each of ``levels``, else null."""
    place, kind = F.struct("id", "text_key", "start"), ["h1", "h2", "level"]  # rows are sorted by the first alone where it tells them apart
    found = reduce(DataFrame.unionByName, [windows(rows, level).withColumn("level", F.lit(level)) for level in levels])
    # Written once: texts are dear to take apart, and the windows are read twice.
    found = scratch.table("windows", found)
    firsts = found.groupBy(*kind).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(*kind, "first")
    # Written, so that the join meets a plain table: adaptive execution can then split a window that very many texts share.
    firsts = scratch.table("firsts", firsts, free_shuffles=True)
    later = found.join(firsts, kind).where(place > F.col("first"))
    spans = [F.sort_array(F.collect_set(F.when(F.col("level") == level, F.struct("start", "end")))).alias(name) for name, level in (("lines", False), ("sentences", True))]
    each = "CASE WHEN size({0}) > 0 THEN array_distinct(flatten(transform({0}, s -> sequence(s.start, s.end)))) END AS {0}"
    covers = later.groupBy(F.col("id").alias("of_id"), F.col("text_key").alias("of_key")).agg(*spans).selectExpr("of_id", "of_key", *(each.format(name) for name in ("lines", "sentences")))
    covers = scratch.table("covers", covers, free_shuffles=True)
    scratch.drop("windows", "firsts")
    return covers


def _cleaned(docs: DataFrame, id_col: str, text_col: str, levels: list[bool]) -> DataFrame:
    """``docs`` as ``row`` and per level, its name before each, what is covered, which units are kept and the text of these."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    covers = _covers(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), scratch, levels)
    # The text is shuffled once, in its row. Covers grow with the texts, so they aren't broadcast where they happen to be small.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_key"))
    joined = rows.join(covers.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left").withColumn("text", F.col("row").getField(text_col))
    n_lines = F.when(F.col("text").isNotNull(), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(F.lit(0)).cast("bigint")
    for level in levels:
        name = "sentences" if level else "lines"
        covered = F.col(name).isNotNull()
        joined = joined.withColumn("units", F.when(covered, F.expr(_units(level))))
        joined = joined.withColumn(f"{name}_kept", F.when(covered, F.expr(f"transform(array_except(sequence(0, size(units) - 1), {name}), k -> get(units, k))")))
        whole = f"array_join(transform({name}_kept, (x, k) -> concat(CASE WHEN k > 0 AND x.i != get({name}_kept, k - 1).i THEN '\\n' ELSE '' END, x.unit)), '')"
        joined = joined.withColumn(f"{name}_text", F.when(covered, F.expr(whole)).otherwise(F.col("text")))
        joined = joined.withColumn(f"{name}_removed", F.coalesce(F.size(name), F.lit(0)).cast("bigint"))
    return joined.withColumn("n_lines", n_lines)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = False) -> DataFrame:
    """``docs`` as the struct ``row``, with ``n_lines``, ``n_removed`` (lines) and the cleaned ``text``.

    A text of fewer than three lines with a word stays as it is, a null text stays null (no lines), an empty one is one line.
    Rows that share id and text count as one document and get the same result; rows that share only the id are documents of
    their own, in the order of their texts' hashes. A null id sorts first. Very long texts are windows like others; an
    empty table gives an empty one. Other columns come back in ``row``, whatever their names.

    With ``sentences`` every line is taken apart at ``. ! ?`` before a space or tab, and windows are of three sentences: then
    ``n_removed_sentences`` counts these, and ``n_removed`` the lines that lose all of theirs.
    """
    clean = _cleaned(docs, id_col, text_col, [sentences])
    if not sentences:
        return clean.select("row", "n_lines", F.col("lines_removed").alias("n_removed"), F.col("lines_text").alias("text"))
    n_gone = F.coalesce(F.col("n_lines") - F.expr("size(array_distinct(transform(sentences_kept, x -> x.i)))"), F.lit(0)).cast("bigint")
    return clean.select("row", "n_lines", n_gone.alias("n_removed"), F.col("sentences_removed").alias("n_removed_sentences"), F.col("sentences_text").alias("text"))


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``without_repeats`` by lines, and beside it ``n_removed_sentences`` and ``passages_text``, what is left by sentences.

    Windows of three lines don't see a passage that stands on one line or two; windows of three sentences do, whatever a line's
    length, and what repeated lines lose they lose too. Both are found in one pass, and the texts are shuffled once.
    """
    clean = _cleaned(docs, id_col, text_col, [False, True])
    return clean.select("row", "n_lines", F.col("lines_removed").alias("n_removed"), F.col("lines_text").alias("text"), F.col("sentences_removed").alias("n_removed_sentences"), F.col("sentences_text").alias("passages_text"))


ORACLE_SQL = f"""
WITH units AS (
  SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS unit
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), body AS (
  SELECT doc_id, pos, trim(unit, {ORACLE_BLANKS}) AS line FROM units WHERE trim(unit, {ORACLE_BLANKS}) <> ''
), windows AS (
  SELECT doc_id, pos AS first_at, lead(pos, 2) OVER w AS last_at, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, first_at, last_at, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first_at) AS n
  FROM windows WHERE last_at IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first_at, last_at)) AS pos FROM ranked WHERE n > 1
), per_doc AS (
  SELECT u.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, string_agg(u.unit, chr(10) ORDER BY u.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM units u LEFT JOIN covered c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id
), parts AS (
  SELECT doc_id, pos AS line_at, string_split(regexp_replace(unit, '([.!?])([ \\t])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS parts FROM units
), sentences AS (
  SELECT doc_id, line_at, unit, row_number() OVER (PARTITION BY doc_id ORDER BY line_at, unit_at) AS pos
  FROM (SELECT doc_id, line_at, generate_subscripts(parts, 1) AS unit_at, unnest(parts) AS unit FROM parts)
), sentence_body AS (
  SELECT doc_id, pos, trim(unit, {ORACLE_BLANKS}) AS line FROM sentences WHERE trim(unit, {ORACLE_BLANKS}) <> ''
), sentence_windows AS (
  SELECT doc_id, pos AS first_at, lead(pos, 2) OVER w AS last_at, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM sentence_body WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), sentence_ranked AS (
  SELECT doc_id, first_at, last_at, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first_at) AS n
  FROM sentence_windows WHERE last_at IS NOT NULL
), sentence_covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first_at, last_at)) AS pos FROM sentence_ranked WHERE n > 1
), left_over AS (
  SELECT u.doc_id, u.line_at, string_agg(u.unit, '' ORDER BY u.pos) FILTER (WHERE c.pos IS NULL) AS line, count(c.pos) AS n_removed
  FROM sentences u LEFT JOIN sentence_covered c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id, u.line_at
), passages AS (
  SELECT doc_id, sum(n_removed) AS n_removed, string_agg(line, chr(10) ORDER BY line_at) FILTER (WHERE line IS NOT NULL) AS kept FROM left_over GROUP BY doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(p.kept, '')) END AS text_md5,
       coalesce(s.n_removed, 0)::BIGINT AS n_removed_sentences, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(s.kept, '')) END AS passages_md5
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN passages s ON d.doc_id = s.doc_id
"""
