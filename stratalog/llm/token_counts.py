"""Token counts by section: whole texts are encoded once and each token goes to one section by its characters.

The tokens' character spans are joined with the sections' intervals, both ascending, by binary search. A token that
crosses a section's end belongs to the section that holds the token's first byte, so counts over a document's sections
add up to the document's tokens exactly. Spans follow from the ids: a byte-level vocabulary splits the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import Text, texts
from .tokens import encoder, ids_of, token_lengths

NEWLINE = 10


def line_sections(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each section starts, and its row: one per line, the line end belongs to its line.

    An empty text is one empty section; the line end that ends a text starts no further section.
    """
    ends = np.flatnonzero(text.data == NEWLINE) + 1
    ends = ends[~np.isin(ends, text.offsets)] if len(ends) else ends
    starts = np.concatenate([text.offsets[:-1], ends])
    rows = np.concatenate([np.arange(text.rows), np.searchsorted(text.offsets, ends, "right") - 1])
    order = np.lexsort((starts, rows))
    return starts[order], rows[order]


def attribute(text: Text, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach past its end; ``ids`` are all rows' ids, one after another."""
    token_ends = np.cumsum(lengths[ids])
    token_starts = token_ends - lengths[ids]
    last = np.concatenate([starts[1:], [len(text.data)]])
    full = np.flatnonzero(last > starts)  # an empty section holds no byte, so no token starts in it
    at = full[np.searchsorted(starts[full], token_starts, "right") - 1] if len(full) else np.zeros(0, int)
    crossing = token_ends > last[at]
    return np.bincount(at, minlength=len(starts)), np.bincount(at[crossing], minlength=len(starts))


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, section, char_start, char_end, n_tokens, n_crossing)`` for each line of each whole text.

    A null or empty text is one empty section with no tokens; repeated rows and null ids come out as they went in. Very long texts are encoded whole; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    ``vocabulary`` is the path of a byte-level vocabulary in ranks form.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counts = ["section", "char_start", "char_end", "n_tokens", "n_crossing"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(vocabulary), token_lengths(vocabulary)
        for batch in batches:
            for text in texts(batch.column(1)):
                ids, _ = ids_of(text, encode)
                starts, of = line_sections(text)
                n_tokens, crossing = attribute(text, ids, lengths, starts, of)
                first = np.searchsorted(of, np.arange(text.rows))
                chars = np.concatenate([[0], np.cumsum((text.data & 0xC0) != 0x80)])
                base = chars[text.offsets[of]]
                ends = np.concatenate([starts[1:], [len(text.data)]])
                values = [np.arange(len(of)) - first[of], chars[starts] - base, chars[ends] - base, n_tokens, crossing]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + text.first_row)), *(pa.array(v.astype(np.int64)) for v in values)], [id_col, *counts])

    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in counts)])
    return rows.mapInArrow(counted, kind)


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, n_sections, n_tokens)`` by id."""
    return section_tokens(docs, id_col, text_col, vocabulary).groupBy(id_col).agg(F.count("*").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"))
