import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm.packing import best_fit, complete, fillings, lower_bound, pack, plan, slots

PATH = public_tokenizers.path("word_bpe_49k.json")


def optimum(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            rooms[i] -= sizes[k]
            go(k + 1, rooms)
            rooms[i] += sizes[k]
        rooms.append(capacity - sizes[k])
        go(k + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


def holds(patterns, counts, capacity):
    seen = defaultdict(int)
    for pattern, times in patterns.items():
        assert sum(n * c for n, c in pattern) <= capacity
        for n, c in pattern:
            seen[n] += c * times
    assert dict(seen) == {n: c for n, c in counts.items() if c}


def test_plans_reach_the_optimum():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([10, 20, 30])
        sizes = sorted((rnd.randint(1, capacity) if rnd.random() < 0.3 else rnd.randint(2, capacity // 2) for _ in range(rnd.randint(1, 11))), reverse=True)
        counts = {n: sizes.count(n) for n in sizes}
        found, want = plan(counts, capacity), optimum(sizes, capacity)
        holds(found, counts, capacity)
        holds(best_fit(counts, capacity), counts, capacity)
        assert lower_bound(counts, capacity) <= want
        assert sum(found.values()) == want, (sizes, capacity)


def test_bin_completion_does_better_than_best_fit():
    rnd, improved, missed = random.Random(4), 0, 0
    for _ in range(60):
        capacity, sizes = 100, []
        for _ in range(6):  # full bins, cut at random
            cuts = sorted(rnd.sample(range(20, 81), 2))
            sizes += [cuts[0], cuts[1] - cuts[0], capacity - cuts[1]]
        counts = {n: sizes.count(n) for n in sizes}
        found, start = plan(counts, capacity), sum(best_fit(counts, capacity).values())
        holds(found, counts, capacity)
        assert sum(found.values()) <= start
        improved += sum(found.values()) < start
        missed += sum(found.values()) > 6
    assert improved >= 20 and missed <= 6, (improved, missed)


def test_large_histograms():
    rnd = random.Random(2)
    counts = defaultdict(int)
    for _ in range(30000):
        counts[min(2048, int(rnd.lognormvariate(6.5, 1)) + 1)] += 1
    found = plan(dict(counts))
    holds(found, counts, 2048)
    assert sum(found.values()) <= lower_bound(dict(counts), 2048) * 1.002
    runs = slots(found)
    for n, c in counts.items():
        assert runs[n][0] == sorted(runs[n][0]) and max(runs[n][0]) < c
    assert plan({}) == {} and all(sum(n * c for n, c in p) <= 2048 for p in fillings(dict(counts), max(counts), 2048))
    assert complete({3: 1}, 4, 1, 1, 10) is None


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, capacity):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", " ", "Hello <|endoftext|>world x<|startoftext|>", "don't DON'T é è é İ ß a b c 12 345 !!! 'll\x0bx"] + ["many words here " * 3000] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [texts[8]] * 5
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = pack(d, PATH, capacity).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want, i
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert pack(d.limit(0), PATH).count() == 0
    assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // capacity) + 1
