"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Every document becomes its token ids and a closing id 0; only documents longer than a sequence are cut, into full pieces
and a rest. What is packed is the histogram of piece lengths, which has at most ``CAPACITY`` entries whatever the
corpus holds: a *pattern* (the lengths in one sequence) is used many times over. Patterns come from

* an incumbent by best fit, longest lengths first, and
* bin completion: around the largest length that is left, up to 12 maximal fillings are searched for, best filled first,
  and used as often as their lengths last. A branch is cut off when the waste of its sequences passes what a better
  result than the incumbent may waste. Search stops at the lower bound or after ``NODES`` nodes; the incumbent stands.

Pieces are ranked within their length by place in a range-partitioned table and each rank has its slot in a pattern, so
one hot length is spread over tasks and nothing but the histogram and the patterns reaches the driver.

Defined results: null text is empty, one piece of one token (id 0); repeated rows are packed as often as they stand; an
empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import Store
from wardline.llm.text_arrays import utf8
from wardline.llm.units import Tokeniser

CAPACITY = 2048
NODES = 6_000
FILLING_NODES = 600

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences (Martello and Toth's L2 over all thresholds)."""
    c = np.zeros(capacity + 2, object)
    for n, k in counts.items():
        c[n] = k
    sizes = np.arange(capacity + 2)
    number, volume = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * sizes)])
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    for k in range(half + 1):
        large = number[-1] - number[capacity - k + 1]
        middle = number[capacity - k + 1] - number[half + 1]
        room = capacity * middle - (volume[capacity - k + 1] - volume[half + 1])
        small = volume[half + 1] - volume[k]
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best fit with decreasing lengths on the histogram: equal bins are handled together."""
    bins: dict[int, dict[Pattern, int]] = {}  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        rooms = sorted(bins)
        at = bisect_right(rooms, length - 1)
        while left and at < len(rooms):
            room = rooms[at]
            group, at = bins.pop(room), at + 1
            for pattern, n in group.items():
                # all the pieces that fit in the fullest bins first; a bin takes as many as it holds
                fit = room // length
                whole = min(n, left // fit)
                rest = left - whole * fit if whole < n else 0
                used = [(whole, fit)] + ([(1, min(rest, fit))] if rest and whole < n else [])
                left -= sum(a * b for a, b in used)
                n -= sum(a for a, _ in used)
                for times, each in used:
                    if times:
                        target = bins.setdefault(room - each * length, {})
                        key = (*pattern, (length, each))
                        target[key] = target.get(key, 0) + times
                if n:
                    bins.setdefault(room, {})[pattern] = bins.get(room, {}).get(pattern, 0) + n
        while left:
            each = min(left, capacity // length)
            times = left // each
            target = bins.setdefault(capacity - each * length, {})
            target[((length, each),)] = target.get(((length, each),), 0) + times
            left -= times * each
    out: dict[Pattern, int] = {}
    for group in bins.values():
        for pattern, n in group.items():
            out[pattern] = out.get(pattern, 0) + n
    return out


def fillings(counts: dict[int, int], largest: int, capacity: int, most: int = 12) -> list[Pattern]:
    """Maximal fillings of the sequence that holds ``largest``, the fullest first, at most ``most`` of those found in ``FILLING_NODES`` steps.

    A filling is maximal if no piece that is left fits in the room it leaves. The search takes lengths from long to short; that
    no piece could give way to a longer one is not tested.
    """
    lengths = sorted((n for n, c in counts.items() if c - (n == largest) > 0 and n <= capacity - largest), reverse=True)
    keys = [-n for n in lengths]
    found: list[tuple[int, Pattern]] = []
    budget = [FILLING_NODES]

    def grow(room: int, at: int, chosen: list[tuple[int, int]]) -> None:
        budget[0] -= 1
        at = max(at, bisect_left(keys, -room))
        for k in range(at, len(lengths)):
            if budget[0] <= 0 or len(found) >= most and found[-1][0] == 0:
                return
            length = lengths[k]
            for each in range(min(counts[length] - (length == largest), room // length), 0, -1):
                grow(room - each * length, k + 1, [*chosen, (length, each)])
        if at >= len(lengths) or budget[0] <= 0:
            used = dict(chosen)
            least = next((n for n in reversed(lengths) if counts[n] - used.get(n, 0) - (n == largest) > 0), None)
            if least is None or least > room:
                found.append((room, tuple(chosen)))
                found.sort(key=lambda x: (x[0], [-n for n, _ in x[1]]))
                del found[most:]

    grow(capacity - largest, 0, [])
    if not found:  # the search ran out: fill greedily
        room, chosen = capacity - largest, []
        for n in lengths:
            each = min(counts[n] - (n == largest), room // n)
            if each:
                chosen.append((n, each))
                room -= each * n
        found.append((room, tuple(chosen)))
    out: list[Pattern] = []
    for _, chosen in found:
        merged: dict[int, int] = {largest: 1}
        for n, c in chosen:
            merged[n] = merged.get(n, 0) + c
        pattern = tuple(sorted(merged.items(), reverse=True))
        if pattern not in out:
            out.append(pattern)
    return out


def complete(counts: dict[int, int], capacity: int, incumbent: int, bound: int, nodes: int) -> dict[Pattern, int] | None:
    """Depth-first bin completion; a result with fewer sequences than ``incumbent``, or None if the search finds none."""
    total = sum(n * c for n, c in counts.items())
    best: dict[Pattern, int] | None = None
    budget = nodes
    # A frame: counts left, sequences used, waste so far, the fillings still to try, the patterns so far.
    stack = [(counts, 0, 0, None, ())]
    while stack and budget > 0:
        left, used, waste, todo, chosen = stack.pop()
        budget -= 1
        allowed = (incumbent - 1) * capacity - total
        if waste > allowed:
            continue
        if not left:
            best = {}
            for pattern, n in chosen:
                best[pattern] = best.get(pattern, 0) + n
            incumbent = used
            if used <= bound:
                break
            continue
        if todo is None:
            todo = fillings(left, max(left), capacity)
        if len(todo) > 1:
            stack.append((left, used, waste, todo[1:], chosen))
        pattern = todo[0]
        times = min(left[n] // c for n, c in pattern)
        spare = capacity - sum(n * c for n, c in pattern)
        rest = {n: c - times * dict(pattern).get(n, 0) for n, c in left.items()}
        stack.append(({n: c for n, c in rest.items() if c}, used + times, waste + spare * times, None, (*chosen, (pattern, times))))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> dict[Pattern, int]:
    """Patterns with their numbers that hold exactly the pieces of the histogram, in as few sequences as were found."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return {}
    out, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    if sum(out.values()) > bound and (better := complete(counts, capacity, sum(out.values()), bound, nodes)):
        out = better
    return out


def slots(patterns: dict[Pattern, int]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Per length the runs of ranks: first rank, sequence of it, offset. Rank r is in the run with the last first rank <= r."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            runs = out.setdefault(length, ([], [], []))
            for _ in range(each):
                for column, x in zip(runs, (seen.get(length, 0), sequence, offset), strict=True):
                    column.append(x)
                seen[length] = seen.get(length, 0) + times
                offset += length
        sequence += times
    return out


_held: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    """A worker's table of the ids of words; words are what stands between ASCII white space, which the tokenizer drops."""
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        _held[path] = Tokeniser(lambda units: [x.ids for x in lib.encode_batch(units, add_special_tokens=False)], spaced=False, bits=20)
    return _held[path]


def cut_column(text: pa.Array, path: str, capacity: int):
    """For each piece of each text: row, piece, start, length and CRC-32 of its little-endian ids."""
    t = tokeniser(path)
    for i, j, _, _, _, doc, rows in t.texts(text):
        ids, n = t.values(rows)
        total = np.bincount(doc, n, j - i).astype(np.int64)
        first = np.cumsum(total) - total
        out: list[tuple[int, int, int, int, int]] = []
        for d in range(j - i):
            own = np.append(ids[first[d] : first[d] + total[d]], 0).astype("<u4")
            for p, at in enumerate(range(0, len(own), capacity)):
                part = own[at : at + capacity]
                out.append((i + d, p, at, len(part), zlib.crc32(part.tobytes())))
        yield out


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def pieces(batches):
        for b in batches:
            for out in cut_column(b.column(1), path, capacity):
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(pieces, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their sequence_id and offset."""
    spark = docs.sparkSession
    store = Store(spark, "packing")
    pieces = store.put(cut(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = slots(plan(counts, capacity, nodes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.repartitionByRange(parts, "length", "doc_id", "piece", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece")
    # Written once with each row's place, so that ranks and rows stay together whatever is computed again.
    dealt = store.put(dealt.withColumn("pos", F.monotonically_increasing_id()), "dealt")
    # A part of the range partitioning holds neighbouring lengths: parts and lengths meet at most (parts + CAPACITY) times.
    met = dealt.groupBy(F.shiftright("pos", 33).alias("part"), "length").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    bases: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, int] = {}
    for r in sorted(met.collect(), key=lambda r: (r["part"], r["length"])):
        bases.setdefault(r["length"], []).append((r["first"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    held = spark.sparkContext.broadcast({n: tuple(np.array(c, np.int64) for c in (*r, *zip(*bases[n], strict=True))) for n, r in runs.items()})

    def place(batches):
        for b in batches:
            length, pos = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
            for n in np.unique(length).tolist():
                first, base, offsets, starts, ranks = held.value[n]
                own = np.flatnonzero(length == n)
                part = np.searchsorted(starts, pos[own], "right") - 1
                rank = ranks[part] + pos[own] - starts[part]
                run = np.searchsorted(first, rank, "right") - 1
                sequence[own], offset[own] = base[run] + rank - first[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields[:5]) + ", sequence_id long, offset long"
    return dealt.mapInArrow(place, schema)
