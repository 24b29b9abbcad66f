"""Ragged numpy and Arrow helpers that work on a whole batch of texts at once."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch, one after another, and where each begins (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of consecutive slices of data (from each start to the next, the last to the end), and the distinct slices."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), []
    ends = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: codes, where each text's codes begin, and the distinct words."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    stops = ~space
    stops[:-1] &= space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = ~space[last]
    ends = np.flatnonzero(stops) + 1
    # every second slice is a word, those between are the gaps
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    bounds = np.searchsorted(starts, offsets).astype(np.int64)
    if len(starts) == 0:
        return np.zeros(0, np.int64), bounds, []
    kept = np.ones(len(data), bool)
    kept[space] = False
    lengths = ends - starts
    packed = data[kept]
    codes, distinct = pieces(packed, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64))
    return codes, bounds, distinct


_APOSTROPHE, _LESS = 39, 60
_ASCII_KIND = np.zeros(256, np.uint8)  # 0: other, 1: letter, 2: digit, 9: not plain
_ASCII_KIND[65:91] = _ASCII_KIND[97:123] = 1
_ASCII_KIND[48:58] = 2
_ASCII_KIND[0:33] = _ASCII_KIND[127:256] = 9
_ASCII_KIND[[_APOSTROPHE, _LESS]] = 9


def lower_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pre-tokens of each text for tokenizers that lower-case: as words(), but words of printable ASCII without ' and <
    and of the letters U+00C0 to U+00FF are lower-cased and cut into runs of letters, single digits and runs of other
    characters. Other words stay whole."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    kept = ~space
    packed = data[kept]
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), []
    begins = kept.copy()
    begins[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = kept[inner]
    start = begins[kept]
    kind = _ASCII_KIND[packed]
    lead = packed == 0xC3  # U+00C0 to U+00FF, all letters but two signs
    trail = np.zeros(len(packed), bool)
    trail[1:] = lead[:-1]
    if lead.any():
        kind[lead | trail] = 1
        kind[trail & ((packed == 0x97) | (packed == 0xB7))] = 9
    odd = kind == 9
    first = np.flatnonzero(start)
    if odd.any():
        plain = np.repeat(~np.logical_or.reduceat(odd, first), np.diff(np.append(first, len(packed))))
    else:
        plain = np.ones(len(packed), bool)
    turn = kind == 2
    turn[1:] |= kind[1:] != kind[:-1]
    start |= turn & plain
    upper = ((packed >= 65) & (packed <= 90)) | (trail & (packed >= 0x80) & (packed <= 0x9E))
    packed = packed + (upper & plain) * np.uint8(32)
    starts = np.flatnonzero(start).astype(np.int64)
    codes, distinct = pieces(packed, starts)
    return codes, np.searchsorted(starts, at(np.cumsum(kept), offsets)).astype(np.int64), distinct


class Ragged:
    """Rows of integers by key, kept up to a bound and then forgotten."""

    def __init__(self, bound: int):
        self.bound = bound
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.begins, self.weight = array("I"), array("q", [0]), 0

    def rows(self, keys: list[bytes], make: Callable[[list[bytes]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table (flat, begins), and the row of each key; make gives the rows of keys not met before."""
        if self.weight > self.bound:
            self.forget()
        index = self.index
        new = [k for k in keys if k not in index]
        if new:
            made = make(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            self.begins.frombytes((np.cumsum(lengths) + self.begins[-1]).tobytes())
            self.flat.extend(chain.from_iterable(made))
            self.weight += 200 * len(new) + sum(map(len, new)) + 4 * int(lengths.sum())
        where = np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))
        return np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32), np.frombuffer(self.begins, np.int64), where


def ragged(flat: np.ndarray, begins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the rows codes of the ragged table (flat, begins): the values, and where each code's values end."""
    lengths = (begins[1:] - begins[:-1])[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(begins[:-1][codes] - (ends - lengths), lengths)
    return flat[index], ends


def at(ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The running sum ends before each bound."""
    return np.concatenate([[0], ends])[bounds].astype(np.int64)


def slices(offsets: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Ranges of texts of about bound bytes together (a longer text stands alone), so that memory stays bounded."""
    out, low, n = [], 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + bound, "right")) - 1
        high = min(n, max(low + 1, high))
        out.append((low, high))
        low = high
    return out
