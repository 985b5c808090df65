"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For byte-level BPE the encoding of a prefix is the encoding of a shorter prefix and one token more, and that token is
the only one that is compatible with the last token before it (a pair is compatible if the bytes of both encode to just
that pair). So one left-to-right pass over a piece gives the last token and the count at each of its prefixes. Counts
are kept for each unit of text (white space and the word behind it), where they don't depend on their surroundings;
what a text has up to any byte is the sum over its whole units and the entry of the unit that the byte falls in. That
answers how many tokens a text has, and where to cut it for a budget, without encoding again.

Special strings inside a text count as their token, as the library does by default.

Defined results: null text is empty, 0 bytes and 0 tokens; repeated rows are counted alike; an empty table gives no rows;
other columns of the input are not looked at.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text_arrays import utf8
from wardline.llm.units import Tokeniser

LIMIT = 512
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself where it is printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts at every byte prefix of a text, from a tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        raw = lambda t: bytes(of[c] for c in t)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.fits: dict[int, bool] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def merge(self, raw: bytes) -> list[bytes]:
        """Plain BPE; only asked for the bytes of two tokens."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """a < 0: nothing stands before b."""
        key = (a + 1) << 20 | b
        if (fits := self.fits.get(key)) is None:
            want = [self.bytes_of[b]] if a < 0 else [self.bytes_of[a], self.bytes_of[b]]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            fits = self.fits[key] = self.merge(b"".join(want)) == want
        return fits

    def piece(self, raw: bytes) -> list[int]:
        """Token count of each prefix of a piece, from one byte to all."""
        if (out := self.pieces.get(raw)) is not None:
            return out
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            for end in range(start + 1, n + 1):
                part = raw[start:end]
                if part not in self.starts:
                    break
                if last[end] < 0 and (token := self.ids.get(part)) is not None and self.compatible(last[start], token):
                    last[end], count[end] = token, count[start] + 1
        if len(self.pieces) > 300_000:
            self.pieces.clear()
        self.pieces[raw] = count[1:]
        return count[1:]

    def plain(self, text: str) -> list[int]:
        """Counts at every byte prefix of a text without special strings.

        A cut may change the pieces before it in two ways: white space that ends a prefix is one piece, and a cut
        contraction is its apostrophe and the letters.
        """
        out: list[int] = []
        total, space_at, space_total = 0, None, 0
        at = 0
        for m in self.pattern.finditer(text):
            part = m[0]
            raw = part.encode()
            if part[0] == "'" and len(part) > 1 and part[1].isalpha():
                counts = [1] * len(raw)
                for cut in range(2, len(raw)):
                    counts[cut - 1] = 1 + self.piece(raw[1:cut])[-1]
                counts[-1] = self.piece(raw)[-1]
            else:
                counts = self.piece(raw)
            if part.isspace():
                if space_at is None:
                    space_at, space_total = at, total
                run = (text[space_at : m.start()] + part).encode() if space_at != at else raw
                joined = self.piece(run)
                out.extend(space_total + x for x in joined[len(run) - len(raw) :])
            else:
                first = 0
                if part[0] == " " and space_at is not None:  # cut behind this blank, the whole run of white space is one piece
                    out.append(space_total + self.piece((text[space_at : m.start()] + " ").encode())[-1])
                    first = 1
                out.extend(total + x for x in counts[first:])
                space_at = None
            total += counts[-1]
            at = m.end()
        return out

    def prefixes(self, text: str) -> list[int]:
        """Counts at every byte prefix of a text."""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self.plain(text)
        out, base, at = [], 0, 0
        for m in self.special.finditer(text):
            part = self.plain(text[at : m.start()] + m[0][:-1])
            out += [base + x for x in part]
            n = len(text[at : m.start()].encode())
            base += (part[n - 1] if n else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + x for x in self.plain(text[at:])]


_held: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    """A worker's prefix table for a tokenizer file."""
    if path not in _held:
        counter = PrefixCounter(path)
        _held[path] = Tokeniser(lambda units: [counter.prefixes(u) for u in units], spaced=True, bits=20)
    return _held[path]


def count_column(text: pa.Array, path: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, tokens, and bytes of the longest prefix with at most ``limit`` tokens, for each text."""
    t, (data, offs) = tokeniser(path), utf8(text)
    size, tokens, fit = np.diff(offs), np.zeros(len(text), np.int64), np.diff(offs)
    for i, j, local, starts, _, doc, rows in t.texts(text):
        sums = t.table.values[t.table.first[rows + 1] - 1].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(sums)])
        head = np.searchsorted(doc, np.arange(j - i + 1))
        tokens[i:j] = upto[head[1:]] - upto[head[:-1]]
        for d in np.flatnonzero(tokens[i:j] > limit).tolist():
            unit = int(np.searchsorted(upto, upto[head[d]] + limit, "right")) - 1
            left = limit - (upto[unit] - upto[head[d]])
            counts = t.table.values[t.table.first[rows[unit]] : t.table.first[rows[unit] + 1]]
            at = offs[i] + starts[unit]
            behind = data[at + 1 : at + len(counts) + 1]
            ends = np.concatenate([(behind & 0xC0) != 0x80, np.ones(len(counts) - len(behind), bool)])
            good = np.flatnonzero((counts <= left) & ends)
            fit[i + d] = starts[unit] - local[d] + (good[-1] + 1 if len(good) else 0)
    return size, tokens, fit


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and bytes_in_limit (longest prefix of at most ``limit`` tokens) of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def count(batches):
        for b in batches:
            size, tokens, fit = count_column(b.column(1), path, limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_in_limit"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long")
