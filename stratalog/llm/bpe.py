"""Byte-level BPE on whole columns of text: encoding by rounds over padded matrices, decoding by one gather.

1. Texts are cut into pieces as the pattern of ``public_tokenizers`` does, by classes of code points: contractions, runs of
   letters, of digits and of other characters, each with a space before it, and runs of blanks.
2. Equal pieces of a chunk are encoded once. A piece that is a token itself is that token.
3. The others are sorted by length into buckets, each a matrix with a row per piece, padded to its longest. In a round every
   row merges its leftmost pair of least rank, the matrix is compacted by the column that this frees, and the two pairs
   beside the merge are looked up in a hash table of all pairs. Rows without a pair that merges leave.
4. A piece of over ``LONG`` bytes goes alone through a heap of its pairs, in the same order of merges: a row's rounds grow
   with the square of its length.

Memory is bounded by a chunk of ``CHUNK`` bytes, or by a text without a blank to cut at.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textarrays import Text, texts

#: Bytes of a chunk; longest piece that takes part in a matrix; most cells of a matrix.
CHUNK, LONG, CELLS = 1 << 20, 128, 1 << 20
BLANK, LETTER, DIGIT, OTHER = range(4)
#: White space, and the letters (1) and digits (2) that Unicode 16.0 added to 15.1.
SPACES = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ADDED = (
    (0x1C89, 0x1C8A, 1), (0xA7CB, 0xA7CD, 1), (0xA7DA, 0xA7DC, 1), (0x105C0, 0x105F3, 1), (0x10D40, 0x10D49, 2), (0x10D4A, 0x10D65, 1), (0x10D6F, 0x10D85, 1),
    (0x10EC2, 0x10EC4, 1), (0x11380, 0x11389, 1), (0x1138B, 0x1138B, 1), (0x1138E, 0x1138E, 1), (0x11390, 0x113B5, 1), (0x113B7, 0x113B7, 1), (0x113D1, 0x113D1, 1),
    (0x113D3, 0x113D3, 1), (0x116D0, 0x116E3, 2), (0x11BC0, 0x11BE0, 1), (0x11BF0, 0x11BF9, 2), (0x13460, 0x143FA, 1), (0x16100, 0x1611D, 1), (0x16130, 0x16139, 2),
    (0x16D40, 0x16D6C, 1), (0x16D70, 0x16D79, 2), (0x18CFF, 0x18CFF, 1), (0x1CCF0, 0x1CCF9, 2), (0x1E5D0, 0x1E5ED, 1), (0x1E5F0, 0x1E5F0, 1), (0x1E5F1, 0x1E5FA, 2),
)
#: What may follow an apostrophe that begins a piece.
AFTER_APOSTROPHE = ("s", "t", "m", "d", "re", "ve", "ll")
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(1)
def _classes() -> np.ndarray:
    of = {"L": LETTER, "N": DIGIT}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for first, last, kind in ADDED:
        out[first : last + 1] = kind
    out[list(SPACES)] = BLANK
    return out


class PairTable:
    """Ranks of token pairs by open addressing: a multiplicative hash, then the next slots up to an empty one."""

    def __init__(self, pairs: dict[int, int]):
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(8, (4 * max(1, len(keys))).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(np.arange(len(keys)), put, assume_unique=True)
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it doesn't merge; an id below 0 is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.nonzero((held != keys) & (held >= 0) & (keys >= 0))
        keys, slot = keys[open_], slot[open_]
        while len(keys):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys
            out[tuple(x[hit] for x in open_)] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            keys, slot, open_ = keys[on], slot[on], tuple(x[on] for x in open_)
        return out


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.table = PairTable(self.pairs)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, padded with -1, after all merges: the matrix and each row's length."""
        out, rows, ids = np.full(ids.shape, -1, np.int32), np.arange(len(ids)), ids.copy()
        ranks = self.table(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < NONE
            if not live.all():
                out[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.table(ids[before, at[before] - 1], best[before])
            ranks[after, at[after]] = self.table(best[after], ids[after, at[after] + 1])
        out[rows, : ids.shape[1]] = ids
        return out, (out >= 0).sum(1)

    def merged_long(self, piece: bytes) -> list[int]:
        """One long piece, by a heap of (rank, place)."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)] + [-1]
        heap = [r << 40 | i for i, r in enumerate(current) if r >= 0]
        heapq.heapify(heap)

        def look(i: int) -> None:
            rank = get(ids[i] << 32 | ids[after[i]], -1) if after[i] < n else -1
            if rank != current[i]:
                current[i] = rank
                if rank >= 0:
                    heapq.heappush(heap, rank << 40 | i)

        while heap:
            top = heapq.heappop(heap)
            i, rank = top & ((1 << 40) - 1), top >> 40
            if current[i] != rank:
                continue
            j = after[i]
            ids[i], current[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            current[i] = -1
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [x for x in ids if x >= 0]

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces in some order, and where each piece's begin and how many it has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        begin, count = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        whole = tokens >= 0
        parts, filled = [tokens[whole]], int(whole.sum())
        begin[whole] = np.arange(filled)
        for k in np.flatnonzero(~whole & (sizes > LONG)).tolist():
            parts.append(np.array(self.merged_long(pieces[k]), np.int32))
            begin[k], count[k] = filled, len(parts[-1])
            filled += len(parts[-1])
        rest = np.flatnonzero(~whole & (sizes <= LONG))
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        ascending, first = sizes[rest], 0
        while first < len(rest):
            most = ascending[first] + ascending[first] // 4
            last = min(int(np.searchsorted(ascending, most, "right")), first + max(1, CELLS // int(most)))
            bucket, size = rest[first:last], ascending[first:last]
            full = np.arange(size[-1]) < size[:, None]
            ids = np.full(full.shape, -1, np.int32)
            ids[full] = self.of_byte[np.frombuffer(b"".join(map(pieces.__getitem__, bucket.tolist())), np.uint8)]
            out, n = self.merged(ids)
            parts.append(out[out >= 0])
            begin[bucket], count[bucket] = filled + np.cumsum(n) - n, n
            filled, first = filled + len(parts[-1]), last
        return np.concatenate(parts), begin, count

    def decoded(self, ids: np.ndarray) -> bytes:
        return self.bytes[_spans(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """One per worker process. The file has a token in base64 and its rank per line; all 256 bytes must be tokens."""
    with open(path or default_vocabulary(), "rb") as file:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces begin, ascending; the rows of ``offsets`` are texts of their own."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(size)])
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(place, offsets)] = True
    kind = _classes()[points]
    start = row[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before something else stands alone or, if a space, goes with it.
    led = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~row[1:-1]) + 1
    start[led - 1] = True
    start[led] = points[led - 1] != 0x20
    marks = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~row[1:-1])
    ahead = np.concatenate([points, np.zeros(2, np.uint32)])
    inside = np.concatenate([~row[:-1], np.zeros(2, bool)])
    for ending in AFTER_APOSTROPHE:
        fits = np.ones(len(marks), bool)
        for k, c in enumerate(ending, 1):
            fits &= (ahead[marks + k] == ord(c)) & inside[marks + k]
        for k in range(1, len(ending) + 1):
            start[marks[fits] + k] = False
        beyond = marks[fits] + len(ending) + 1
        start[beyond[beyond < n]] = True
    return place[np.flatnonzero(start)]


def _cut(data: np.ndarray) -> list[int]:
    """Edges of parts of about ``CHUNK`` bytes, between a visible ASCII character and a blank: there a piece always ends."""
    blank = (data[1:] == 0x20) | (data[1:] == 0x0A)
    at = np.flatnonzero(blank & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
    edges = [0]
    while len(data) - edges[-1] > 2 * CHUNK:
        k = np.searchsorted(at, edges[-1] + CHUNK)
        if k == len(at):
            break
        edges.append(int(at[k]))
    return [*edges, len(data)]


def _encoded_chunk(data: np.ndarray, offsets: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    starts = piece_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    sizes = ends - starts
    short = sizes <= 64
    text = Text(data, offsets, 0)
    of = np.zeros(len(starts), np.int64)
    _, first, of[short] = np.unique(text.span_hashes(starts[short], ends[short]), return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(starts[short][first].tolist(), ends[short][first].tolist(), strict=True)]
    others: dict[bytes, int] = {}
    long = np.flatnonzero(~short)
    of[long] = [others.setdefault(raw[a:b], len(pieces) + len(others)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    flat, begin, count = words.encoded([*pieces, *others])
    counts = count[of]
    ids = flat[_spans(begin[of], counts)]
    upto = np.concatenate([[0], np.cumsum(counts)])
    return ids, upto[np.searchsorted(starts, offsets)]


def ids_of(text: Text, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and where each row's begin and end."""
    if text.rows > 1 or len(text.data) <= 2 * CHUNK:
        return _encoded_chunk(text.data, text.offsets, words)
    cuts = _cut(text.data)
    parts = [_encoded_chunk(text.data[a:b], np.array([0, b - a]), words)[0] for a, b in zip(cuts, cuts[1:], strict=False)]
    ids = np.concatenate(parts)
    return ids, np.array([0, len(ids)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id_col, n_tokens, ids)`` per row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers in a row.

    A null or empty text has no ids. Repeated rows, null and repeated ids come back as often as they come; other columns of
    ``docs`` are ignored, whatever their names; an empty table gives an empty one. Very long texts are cut where a piece
    ends anyway. Nothing is a special token.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for text in texts(batch.column(1), CHUNK):
                ids, edges = ids_of(text, words)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), text.rows, [None, pa.py_buffer((4 * edges).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(text.first_row, text.rows), pa.array(np.diff(edges)), packed.cast(pa.binary())], [id_col, "n_tokens", "ids"])

    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(encoded, kind)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for; null ids give null, and so does an id that isn't in the vocabulary."""
    names = encoded.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            out, size, first = [], 0, 0
            for k, packed in enumerate(batch.column(names.index(ids_col))):
                ids = np.frombuffer(packed.as_buffer(), "<u4") if packed.is_valid else None
                known = ids is not None and (not len(ids) or (ids.max() < len(words.lengths) and words.lengths[ids].all()))
                out.append(words.decoded(ids) if known else None)
                size += len(out[-1] or b"")
                if size > CHUNK or k == batch.num_rows - 1:
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, "decoded"])
                    out, size, first = [], 0, k + 1

    return encoded.mapInArrow(decoded, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
