"""Benchmark decontamination with training suffix arrays.

The training text is cut into shards of whole documents. A shard's suffix array is the sorted order of its word
suffixes, compared by their next ``WINDOW`` words; only suffixes that begin with the first words of some benchmark
suffix enter it, since no other can match. Every test suffix is then binary-searched in each shard: its interval
gives the places of its verbatim occurrences, and occurrences that follow on each other in item and document grow into
one longest match. A document word is hit if an occurrence of a benchmark window covers it, and affected documents go.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. The benchmark is the query set: it is sent
to the executors in blocks of at most ``BLOCK_WORDS`` words (an item is never cut), each searched against all documents.

Defined results: null texts and texts without words have no words, no hits and are never contaminated; items without
words match nothing; equal items all count; an empty benchmark hits nothing; repeated rows are judged alike, one result
each; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.text_arrays import ALNUM, LOWER, words_of

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Words by which a training suffix is held against the benchmark before it enters the suffix array.
PREFIX = 3


class Block:
    """The test suffixes of a block of the benchmark. Items with the same words are one class with several members."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, w in words_of(pa.array([t for _, t in items], pa.string()), ALNUM, LOWER):
            hashes.append(w.hash)
            counts.append(w.counts)
        h, counts = np.concatenate(hashes), np.concatenate(counts)
        classes: dict[bytes, list[str | None]] = {}
        for (name, _), end, n in zip(items, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            if n:
                classes.setdefault(h[end - n : end].tobytes(), []).append(name)
        self.members = list(classes.values())
        counts = np.array([len(k) // 8 for k in classes], np.int64)
        self.vocabulary, ids = np.unique(np.frombuffer(b"".join(classes), np.uint64), return_inverse=True)
        ids = ids.reshape(-1).astype(np.int64) + 1
        self.need = np.minimum(counts, window)
        cls = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(ids)) - (np.cumsum(counts) - counts)[cls]
        at = np.flatnonzero(counts[cls] - place >= self.need[cls])
        self.prefix = int(min(PREFIX, window, self.need.min(initial=PREFIX)))
        rows = suffix_rows(ids, at, window, self.need[cls[at]])
        self.tests, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.lengths = (self.tests > 0).sum(axis=1)
        order = np.argsort(which, kind="stable")
        self.cls, self.place = cls[at][order], place[at][order]
        self.first = np.searchsorted(which[order], np.arange(len(self.tests) + 1))
        # A bitmap over hashes of the first words, for the shard's candidates.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_prefix_key(self.tests[:, : self.prefix])] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Ids from 1 of the words that the block has, else 0."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def _prefix_key(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)


def suffix_rows(ids: np.ndarray, at: np.ndarray, width: int, length: np.ndarray) -> np.ndarray:
    """The next ``width`` ids from each place, 0 beyond its length."""
    padded = np.concatenate([ids, np.zeros(width, np.int64)])
    rows = padded[at[:, None] + np.arange(width)]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows as fixed byte strings whose order is the order of the rows."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").reshape(-1)


def candidates(words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places and next words of the suffixes of a slice that may match a test suffix."""
    ids, p = block.known(words.hash), block.prefix
    n = len(ids)
    left = words.first[1:][words.doc] - np.arange(n)
    good = (ids > 0) & (left >= p)
    for j in range(1, min(p, n)):
        good[:-j] &= ids[j:] > 0
    at = np.flatnonzero(good)
    if len(at):
        at = at[block.bits[_prefix_key(ids[at[:, None] + np.arange(p)])]]
    rows = suffix_rows(ids, at, block.window, left[at])
    # A word that the benchmark lacks ends a suffix: nothing can match beyond it.
    return at, np.where(np.cumprod(rows > 0, axis=1) > 0, rows, 0)


class Shard:
    """Suffix array of the candidate suffixes of some documents."""

    def __init__(self, at: np.ndarray, rows: np.ndarray):
        order = np.argsort(_sortable(rows), kind="stable")
        self.at, self.keys = at[order], _sortable(rows[order])

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Test suffix and place of each verbatim occurrence: the interval of the array that begins with all its words."""
        high = np.where(np.arange(block.window) >= block.lengths[:, None], 0xFFFFFFFF, block.tests)
        first = np.searchsorted(self.keys, _sortable(block.tests), "left")
        n = np.maximum(np.searchsorted(self.keys, _sortable(high), "right") - first, 0)
        test = np.repeat(np.arange(len(n)), n)
        return test, self.at[_ranges(first, n)]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def longest_matches(test: np.ndarray, place: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """Document, first word, length, class and the word of the class of each longest verbatim match.

    Occurrences of windows that follow on each other both in the document and in the item are one match.
    first: the documents' first words.
    """
    n = block.first[test + 1] - block.first[test]
    own = _ranges(block.first[test], n)
    cls, at, q = block.cls[own], block.place[own], np.repeat(place, n)
    doc = np.searchsorted(first, q, "right") - 1
    order = np.lexsort((q, q - at, cls, doc))
    cls, at, q, doc = cls[order], at[order], q[order], doc[order]
    new = np.ones(len(q), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (cls[1:] != cls[:-1]) | (q[1:] - at[1:] != q[:-1] - at[:-1]) | (q[1:] != q[:-1] + 1)
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(q)))
    return doc[start], q[start], run - 1 + block.need[cls[start]], cls[start], at[start]


OUT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_at", pa.int64())]


def judge(text: pa.Array, blocks: list) -> list[pa.Array]:
    """The columns of ``OUT`` for each text. blocks: broadcasts; with more than one, one at a time is in memory."""
    docs = len(text)
    counts, found = np.zeros(docs, np.int64), [[np.zeros(0, np.int64)] * 3]
    items: dict[int, list[str]] = {}
    words = list(words_of(text, ALNUM, LOWER)) if len(blocks) > 1 else words_of(text, ALNUM, LOWER)  # read once, however many blocks
    for b in blocks:
        block, parts = b.value, []
        for i, j, w in words:
            counts[i:j] = w.counts
            at, rows = candidates(w, block)
            parts.append((at + counts[:i].sum(), rows))
        first = np.cumsum(counts) - counts
        if parts and len(block.tests):
            shard = Shard(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
            doc, start, length, cls, _ = longest_matches(*shard.search(block), np.append(first, counts.sum()), block)
            found.append([doc, start, length])
            for x in np.unique(doc * len(block.members) + cls).tolist():
                d, c = divmod(x, len(block.members))
                items.setdefault(d, []).extend(block.members[c])
        if len(blocks) > 1:
            b.let_go()
    doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-length, start))
    doc, start, length = doc[order], start[order], length[order]
    end = start + length
    reach = np.maximum.accumulate(np.concatenate([[0], end]))[:-1]
    n_hit = np.bincount(doc, np.maximum(0, end - np.maximum(start, reach)), docs).astype(np.int64)
    longest, where = np.zeros(docs, np.int64), np.full(docs, -1, np.int64)
    best = np.lexsort((start, -length, doc))
    head = best[np.unique(doc[best], return_index=True)[1]]
    longest[doc[head]], where[doc[head]] = length[head], start[head] - first[doc[head]] if docs else 0
    names = [sorted(x for x in items.get(d, ()) if x is not None) for d in range(docs)]
    sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return [pa.array(x, t) for x, (_, t) in zip((counts, n_hit, [len(items.get(d, ())) for d in range(docs)], sums, n_hit > 0, longest, where), OUT, strict=True)]


class Held:
    """A broadcast block; a Python worker can let go of its copy and read it again from its executor's."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Block:
        return self.broadcast.value

    def let_go(self) -> None:
        if hasattr(self.broadcast, "_value"):
            del self.broadcast._value


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcast blocks of bounded size, dealt by a running count of its words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    out, now, size = [], [], 0
    for r in items.toLocalIterator():  # a block at a time is held by the driver
        now.append((r.item, r.text))
        size += 1 + len(r.text) // 2
        if size >= block_words:
            out.append(Held(spark.sparkContext.broadcast(Block(now, window))))
            now, size = [], 0
    return [*out, Held(spark.sparkContext.broadcast(Block(now, window)))] if now or not out else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): words, hit words, matching items and the longest match with its place."""
    blocks = blocks_of(benchmark, window, block_words)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ", 1)

    def search(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judge(b.column(1), blocks)], ["doc_id", *(n for n, _ in OUT)])

    return rows.mapInArrow(search, f"{schema}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no window of the benchmark hits, with all their columns."""
    blocks, at = blocks_of(benchmark, window, block_words), docs.columns.index("text")

    def clean(batches):
        for b in batches:
            found = judge(b.column(at), blocks)
            yield b.filter(pc.invert(found[4]))

    return docs.mapInArrow(clean, docs.schema)
