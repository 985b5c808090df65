"""Cached tokenisation by units: pieces of a text whose tokens don't depend on what stands around them.

Units are found for a whole slice at once and looked up by hash in a table of numpy arrays; only units that a worker
hasn't met are tokenised. The table is bounded: once full it is emptied, which costs time and never changes a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from wardline.llm.text_arrays import PLAIN, Words, slices, utf8

#: White space beyond the six ASCII characters at which units end; a text that has any of it is one unit.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_U = np.uint64


#: Values of a table (32 MB) beyond which it is emptied before the next slice: long units, as texts without blanks are, fill it soon.
MOST_VALUES = 1 << 23


class Table:
    """From 64-bit hashes to rows, by open addressing; row r has values[first[r] : first[r + 1]]."""

    def __init__(self, bits: int = 21, dtype=np.uint32):
        self.least_bits, self.dtype = bits, dtype
        self.clear()

    def clear(self) -> None:
        self.bits = self.least_bits
        self.keys, self.rows, self.n = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
        self.first, self.values, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, self.dtype), 0

    @property
    def full(self) -> bool:
        return self.n > (1 << self.bits) // 2 or self.size > MOST_VALUES

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it isn't there."""
        mask = _U((1 << self.bits) - 1)
        at = h & mask
        out = self.rows[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[left]
        while len(left):
            at = (at + _U(1)) & mask
            row = self.rows[at]
            out[left] = row
            more = (row >= 0) & (self.keys[at] != h[left])
            left, at = left[more], at[more]
        return out

    def add(self, h: np.ndarray, values: list) -> None:
        """Adds distinct hashes that aren't there, each with its sequence of values."""
        n = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter((x for v in values for x in v), self.dtype, int(n.sum()))
        while self.n + len(h) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.size + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.size : self.size + len(flat)] = flat
        self.first[self.n + 1 : self.n + len(h) + 1] = self.size + np.cumsum(n)
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.size = self.n + len(h), self.size + len(flat)
        while self.n > (1 << self.bits) * 3 // 4:  # one batch may have more than a table should hold
            old = np.flatnonzero(self.rows >= 0)
            keys, held = self.keys[old], self.rows[old]
            self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(keys, held)
        self._place(h, rows)

    def _place(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = _U((1 << self.bits) - 1)
        at = h & mask
        while len(h):
            free = self.rows[at] < 0
            _, one = np.unique(np.where(free, at, _U(1 << 63)), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.rows[at[one]] = h[one], rows[one]
            stay = np.ones(len(h), bool)
            stay[one] = False
            h, rows, at = h[stay], rows[stay], (at[stay] + (self.rows[at[stay]] >= 0).astype(np.uint64)) & mask


class Tokeniser:
    """Values (ids, or numbers about them) of whole texts.

    spaced: a unit is a word with the white space before it, instead of the word alone. encode: from a list of units to
    a list of sequences of values.
    """

    def __init__(self, encode: Callable[[list[str]], list], spaced: bool, dtype=np.uint32, bits: int = 21):
        self.encode, self.spaced, self.table, self.dtype = encode, spaced, Table(bits, dtype), dtype

    def slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, documents and table rows of the units of a slice, in order."""
        w = Words(data, offs, PLAIN)
        if self.spaced:
            ends = w.ends.copy()
            starts = np.empty_like(w.starts)
            starts[1:] = ends[:-1]
            head = w.first[:-1][w.counts > 0]
            starts[head] = offs[:-1][w.counts > 0]
            tail = np.where(w.counts > 0, w.ends[np.maximum(w.first[1:] - 1, 0)] if len(w.ends) else 0, offs[:-1])
            extra = np.flatnonzero(tail < offs[1:])  # white space at the end is a unit of its own
            doc = np.concatenate([w.doc, extra])
            starts, ends = np.concatenate([starts, tail[extra]]), np.concatenate([ends, offs[1:][extra]])
            order = np.argsort(starts, kind="stable")
            starts, ends, doc = starts[order], ends[order], doc[order]
        else:
            starts, ends, doc = w.starts, w.ends, w.doc
        whole = self._whole(data, offs)
        if len(whole):
            keep = ~np.isin(doc, whole)
            starts, ends, doc = np.concatenate([starts[keep], offs[:-1][whole]]), np.concatenate([ends[keep], offs[1:][whole]]), np.concatenate([doc[keep], whole])
            order = np.argsort(starts, kind="stable")
            starts, ends, doc = starts[order], ends[order], doc[order]
        h = w.span_hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        if self.table.full:
            self.table.clear()
        rows = self.table.find(h)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            raw = data.tobytes()
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[missing[at]].tolist(), ends[missing[at]].tolist(), strict=True)]
            self.table.add(new, self.encode(units))
            rows[missing] = self.table.find(h[missing])
        return starts, ends, doc, rows

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents that have white space beyond ASCII; only for spaced units, which it may join."""
        if not self.spaced:
            return np.zeros(0, np.int64)
        odd = (data >= 0x1C) & (data < 0x20)
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            odd |= data == lead
        at = np.unique(np.searchsorted(offs, np.flatnonzero(odd), "right") - 1)
        return np.array([d for d in at.tolist() if OTHER_SPACE.search(data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))], np.int64)

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows one after the other, and how many each has."""
        first = self.table.first[rows]
        n = self.table.first[rows + 1] - first
        return self.table.values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)], n

    def texts(self, column: pa.Array):
        """For slices of the column: rows i to j, then starts, ends, documents and table rows of the units."""
        data, offs = utf8(column)
        for i, j in slices(offs):
            yield i, j, offs[i : j + 1] - offs[i], *self.slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
