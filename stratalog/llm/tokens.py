"""Token ids of whole texts under a byte-level vocabulary.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and ``add_special_tokens=False`` (tests compare them); the same
vocabulary in ranks form is encoded several times faster by ``tiktoken``. The special token's string in a text is
the special token, whose id follows the ranks.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np

from .textarrays import Text

SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(4)
def _tokens(path: str) -> dict[bytes, int]:
    """The ranks and the special token."""
    ranks = _ranks(path)
    return {**ranks, SPECIAL.encode(): max(ranks.values()) + 1}


@lru_cache(4)
def encoder(path: str | None = None):
    """One per worker process: building it takes a second."""
    import public_tokenizers
    import tiktoken

    path = path or default_vocabulary()
    special = {SPECIAL: _tokens(path)[SPECIAL.encode()]}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens=special)


@lru_cache(4)
def token_lengths(path: str | None = None) -> np.ndarray:
    """Bytes of each id."""
    ranks = _tokens(path or default_vocabulary())
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(token) for token in ranks]
    return out


@lru_cache(4)
def token_bytes(path: str | None = None) -> list[bytes]:
    ranks = _tokens(path or default_vocabulary())
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def ids_of(text: Text, encode) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and where each row's begin and end."""
    raw = text.data.tobytes()
    bodies = [raw[a:b].decode() for a, b in zip(text.offsets[:-1], text.offsets[1:], strict=True)]
    parts = [encode.encode(x, allowed_special="all") if SPECIAL in x else encode.encode_ordinary(x) for x in bodies]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ids = np.fromiter(chain.from_iterable(parts), np.int32, int(edges[-1]))
    return ids, edges
