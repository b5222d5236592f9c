"""Content hashes by algorithm name. md5, sha1 and sha256 run in the JVM; XXH64 (seed 0) and BLAKE3 are vectorised UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The numbers that file names carry.
ALGORITHMS = {"md5": 0, "sha1": 1, "sha256": 2, "blake3": 3, "xxhash": 4}
NATIVE = ("md5", "sha1", "sha256")
DEFAULT = "sha1"


def algorithm_id(name: str) -> int:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {name!r}: one of {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name]


def algorithm_name(number: Column) -> Column:
    """Name by number; empty for an unknown one."""
    names = F.create_map(*(F.lit(x) for name, n in ALGORITHMS.items() for x in (n, name)))
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.lit(""))


@F.pandas_udf(StringType())
def other_digest(content: pd.Series, algorithm: pd.Series) -> pd.Series:
    """Digests by algorithms without a native form; null content stays null."""
    return pd.Series([None if b is None else _digest(bytes(b), a) for b, a in zip(content, algorithm, strict=True)], dtype=object)


def _digest(data: bytes, algorithm: str) -> str:
    h = hasher(algorithm)
    h.update(data)
    return h.hexdigest()


@F.pandas_udf(StringType())
def xxh64(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(b, seed=0))


@F.pandas_udf(StringType())
def blake3(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else blake3_hex(bytes(b)))


def content_hash(content: Column, algorithm: str = DEFAULT) -> Column:
    """Lower-case hex digest of a binary column; null stays null."""
    algorithm_id(algorithm)
    native = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "xxhash": xxh64, "blake3": blake3}
    return native[algorithm](content)


def slug(path: Column) -> Column:
    """Last path component in lower case, only a-z, 0-9 and -, then 8 hex characters of the whole path's SHA-256."""
    last = F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1)), "[^a-z0-9-]", "")
    return F.concat(last, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


# BLAKE3 after its published specification: 1 KiB chunks of 64-byte blocks, joined by a binary tree; all chunks of a stretch at once.
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
CHUNK, STRETCH = 1 << 10, 1 << 20
#: The initial state and the message permutation.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_ROUND = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint32(bits) | x << np.uint32(32 - bits)


def _compress(chaining, words, counter: np.ndarray, size: int, flags: int) -> list[np.ndarray]:
    """One compression for many blocks: each of the 8 chaining values and 16 words is an array over them."""
    like = lambda x: np.full(len(counter), x, np.uint32)
    v = [*chaining, *map(like, _IV[:4]), counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), like(size), like(flags)]
    m = list(words)
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_ROUND):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turned(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = _turned(v[b] ^ v[c], r2)
        if turn < 6:
            m = [m[p] for p in _PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _initial(n: int) -> list[np.ndarray]:
    return [np.full(n, x, np.uint32) for x in _IV]


def _chunk_values(data: bytes, first: int, root: int = 0) -> list[np.ndarray]:
    """Chaining values of the chunks of ``data``, the first of which is number ``first``; the last may be short."""
    full, out = len(data) // CHUNK, []
    tail = data[full * CHUNK :]
    for at, n, blocks, body in ((0, full, 16, data[: full * CHUNK]), (full, 1, max(1, -(-len(tail) // 64)), tail)):
        if not n or (at and not tail):
            continue
        words = np.frombuffer(body.ljust(n * blocks * 64, b"\0"), "<u4").reshape(n, blocks, 16).transpose(1, 2, 0)
        counter, value = np.arange(first + at, first + at + n, dtype=np.uint64), _initial(n)
        for b in range(blocks):
            size = 64 if body is not tail else min(64, len(tail) - 64 * b)
            value = _compress(value, words[b], counter, size, (_START if b == 0 else 0) | ((_END | root) if b == blocks - 1 else 0))
        out.append(value)
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _joined(values: list[np.ndarray], root: int) -> list[np.ndarray]:
    """The tree above some chaining values: neighbours pair up, an odd last one waits for the next level."""
    while (n := len(values[0])) > 1:
        words = [v[k : n - n % 2 : 2] for k in (0, 1) for v in values]
        parents = _compress(_initial(n // 2), words, np.zeros(n // 2, np.uint64), 64, _PARENT | (root if n == 2 else 0))
        values = [np.concatenate([p, v[n - n % 2 :]]) for p, v in zip(parents, values, strict=True)]
    return values


class Blake3:
    """Incremental: full stretches become one value of the tree as soon as more data follows, so memory is a stretch."""

    def __init__(self) -> None:
        self.rest, self.done = b"", []

    def update(self, data: bytes) -> Blake3:
        self.rest += data
        while len(self.rest) > STRETCH:
            self.done.append(_joined(_chunk_values(self.rest[:STRETCH], len(self.done) * (STRETCH // CHUNK)), 0))
            self.rest = self.rest[STRETCH:]
        return self

    def hexdigest(self) -> str:
        first = len(self.done) * (STRETCH // CHUNK)
        alone = not self.done and len(self.rest) <= CHUNK
        last = _chunk_values(self.rest, first, _ROOT if alone else 0)
        if self.done:
            last = [np.concatenate(x) for x in zip(*self.done, _joined(last, 0), strict=True)]
        return np.array([v[0] for v in _joined(last, _ROOT)], "<u4").tobytes().hex()


def blake3_hex(data: bytes) -> str:
    return Blake3().update(data).hexdigest()


def hasher(algorithm: str):
    """An incremental hash with ``update`` and ``hexdigest``."""
    algorithm_id(algorithm)
    if algorithm == "blake3":
        return Blake3()
    if algorithm == "xxhash":
        import xxhash

        return xxhash.xxh64(seed=0)
    return hashlib.new(algorithm)


def file_hash(path: str, algorithm: str) -> str:
    """Hex digest of a file, read in blocks."""
    h = hasher(algorithm)
    with open(path, "rb") as f:
        while block := f.read(STRETCH):
            h.update(block)
    return h.hexdigest()


@F.pandas_udf(StringType())
def file_digest(path: pd.Series, algorithm: pd.Series) -> pd.Series:
    """Hex digests of files that the executors can open, read in blocks; null for a null path or what can't be read."""

    def digest(p, a):
        try:
            return None if p is None or a is None else file_hash(p, a)
        except OSError:
            return None

    return pd.Series([digest(p, a) for p, a in zip(path, algorithm, strict=True)], dtype=object)


def digest_by_format(hooks: dict[str, Callable[[str, str], str]]):
    """Like ``file_digest`` with the format's name as a third column: formats of ``hooks`` are hashed by their own."""

    def digest(path: pd.Series, algorithm: pd.Series, kind: pd.Series) -> pd.Series:
        def one(p, a, k):
            try:
                return None if p is None or a is None else hooks[k](p, a) if k in hooks else file_hash(p, a)
            except OSError:
                return None

        return pd.Series([one(*x) for x in zip(path, algorithm, kind, strict=True)], dtype=object)

    return F.pandas_udf(digest, "string")
