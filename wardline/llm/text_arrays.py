"""Words of a batch of UTF-8 texts as numpy arrays.

A batch is worked on in slices of about ``SLICE`` bytes, so that the arrays beside the text stay small; no text is
ever cut. A word's 64-bit hash is a polynomial over its bytes, taken from one running sum over the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C17)
_INVERSE = _U(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def byte_class(pattern: bytes) -> np.ndarray:
    """True for each byte value in ``pattern``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern, np.uint8)] = True
    return out


#: Words of ``[^\x20\x09-\x0D]+``.
PLAIN = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Words:
    """starts, ends (bytes), hashes and document of each word of a slice; ``first`` has n + 1 word offsets of the documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray = PLAIN, fold: np.ndarray = SAME, hashed: bool = True):
        self.data, self.offs, self.n_docs = data, offs, len(offs) - 1
        self.inside = inside = kind[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offs[:-1] < offs[1:]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        if hashed:
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[fold[data]] * _power("up", len(data)), out=self.sums[1:])
            self.hash = self.span_hash(self.starts, self.ends)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power("down", len(self.data) + 1)[starts])

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document have the mask."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words within a document."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        h = self.hash[at]
        for j in range(1, k):
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + self.hash[at + j]
        return at, mix(h)


def words_of(column: pa.Array, kind: np.ndarray = PLAIN, fold: np.ndarray = SAME, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """The words of rows i to j, slice by slice."""
    data, offs = utf8(column)
    for i, j in slices(offs):
        yield i, j, Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], kind, fold, hashed)


def unique_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (ascending) and distinct hashes, ascending within a document."""
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
