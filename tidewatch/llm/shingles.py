"""Hashed word shingles of a batch of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

from .arrays import words

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, text after text, and where each text's begin.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+; a text of fewer words than width has the whole sequence as one.
    """
    upper = (data >= 65) & (data <= 90)
    codes, bounds, distinct = words(data + (upper * np.uint8(32)), offsets)
    n_docs, counts = len(offsets) - 1, np.diff(bounds)
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n_docs), counts)
    if len(codes) >= width:
        begin = np.flatnonzero(owner[: len(codes) - width + 1] == owner[width - 1 :])
    else:
        begin = np.zeros(0, np.int64)
    key = np.full(len(begin), width, np.uint64)
    for j in range(width):
        key = mixed(key ^ value[begin + j])
    doc = owner[begin]
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = counts[short].astype(np.uint64)
    for j in range(width - 1):
        longer = counts[short] > j
        extra[longer] = mixed(extra[longer] ^ value[bounds[short[longer]] + j])
    if len(short):
        key, doc = np.concatenate([key, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    again = pd.Series(mixed(key + doc.astype(np.uint64) * _A)).duplicated().to_numpy()
    key, doc = key[~again], doc[~again]
    return key, np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int64)
