import random
import re

import pytest

from wardline.llm import ngram_join
from wardline.llm.ngram_join import jaccard_components, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    """rows: (id, text); component ids by all pairs of distinct sets."""
    sets = sorted({shingles(t, n) for _, t in rows} - {frozenset()}, key=sorted)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) * 100 >= percent * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(sets)}
    least = {}
    for i, t in rows:
        if (s := shingles(t, n)) and i is not None:
            least[at[s]] = min(i, least.get(at[s], i))
    return sorted(((i, len(s), least.get(at[s]) if s else i) for i, t in rows for s in [shingles(t, n)]), key=str)


def check(spark, rows, n, percent):
    d = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, root string, sig string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d, n, percent).collect()), key=str)
    want = brute(rows, n, percent)
    assert got == want, [x for x in zip(got, want, strict=True) if x[0] != x[1]][:5]
    return d


def made(rnd, groups=12, copies=6):
    """Groups of near copies around the threshold, a passage that many share, short texts, exact copies, chains."""
    vocab = [f"w{k}" for k in range(300)]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passage, rows = say(60), []
    for _ in range(groups):
        base = say(rnd.choice([3, 6, 12, 25, 40, 120, 250]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w))
            base = w if rnd.random() < 0.4 else base
        rows += [" ".join(base)] * 3 + [" ".join(say(rnd.choice([4, 30, 200])) + passage + say(3)) for _ in range(3)] + [" ".join(passage + say(k % 9)) for k in range(4)]
    rows += [None, "", " \n", "One Two", "one two", "a b c", "a b c d"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "frequent"), [(4, 85, 64), (5, 80, 64), (4, 85, 2), (5, 80, 3), (3, 60, 2)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "VERY_FREQUENT", frequent * 4)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_NODE", 0 if frequent < 64 else 20)
    monkeypatch.setattr(ngram_join, "LONG", 3 if frequent < 64 else 100)
    monkeypatch.setattr(ngram_join, "THIN", 3)
    check(spark, made(random.Random(n * percent + frequent)), n, percent)


def test_real_documents_and_defined_cases(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    d = check(spark, real, 4, 85)
    kept = keep_one(d, 4, 85)
    want = brute(real, 4, 85)
    assert kept.schema == d.schema and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, c in want if i == c or not n)
    assert jaccard_components(d.limit(0), 4, 85).count() == 0
    odd = [(None, "a b c d e f g h"), (None, "x y z"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "other words"), (8, "q r s"), (None, None), (None, ""), (9, "long " * 50000 + "end")]
    d = check(spark, odd, 4, 85)
    kept = sorted(((r.doc_id, r.text) for r in keep_one(d, 4, 85).collect()), key=str)
    assert kept == sorted([(7, "a b c d e f g h"), (None, "x y z"), (8, "other words"), (8, "q r s"), (None, None), (None, ""), odd[-1]], key=str)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"v{rnd.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(150)] = f"n{k}"
        rows.append((k, " ".join(w)))
    check(spark, rows, 4, 85)
