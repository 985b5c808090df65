import hashlib
import random
import re

from wardline.llm.decontaminate import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    doc, hit, found, longest = words(text), set(), [], 0
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1) if w else ():
            for q in range(len(doc) - k + 1):
                if doc[q : q + k] == w[p : p + k]:
                    hit.update(range(q, q + k))
                    found.append(str(name))
                    n = k
                    while q + n < len(doc) and p + n < len(w) and doc[q + n] == w[p + n]:
                        n += 1
                    longest = max(longest, n)
    names = ",".join(sorted(set(found)))
    return len(doc), len(hit), len(set(found)), hashlib.sha256(names.encode()).hexdigest(), bool(hit), longest


def check(spark, texts, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, lang string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(d, b, **kw).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id], [x for x in items if x[0] is not None], kw.get("window", 10))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match) == want, (r, want)
    kept = drop_contaminated(d, b, **kw)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.contaminated}


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    say = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    vocab = ["a", "B", "c", "é", "d9", "X"]
    items = [(i, say(rnd.choice([0, 1, 3, 9, 10, 11, 14, 20]), vocab)) for i in range(14)] + [(20, None), (21, "Only two"), (22, "only-TWO!"), (23, "...")]
    items += [(30, items[7][1].upper()), (31, items[7][1])]
    texts = [None, "", "...", "only two", "the only  two words"] + [say(rnd.randrange(60), vocab) for _ in range(40)]
    texts += [say(20, vocab) + " " + (items[k][1] or "") + ", " + say(5, vocab) for k in range(14)]
    for window in (10, 4):
        check(spark, texts, items, window=window)
        check(spark, texts, items, window=window, block_words=12)


def test_real_rows_and_empty_tables(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(15).collect()]
    check(spark, docs, items)
    check(spark, docs[:3], [])
    check(spark, [], items)
    check(spark, ["z " * 30000 + items[0][1]], items)


def test_items_without_an_id_hit(spark):
    passage = " ".join(f"word{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"so {passage} then"), (2, "nothing of it")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), ("b", passage)], "item_id string, text string")
    hit, clean = sorted(decontaminate(docs, benchmark).collect())
    assert (hit.n_hit, hit.n_items, hit.contaminated, clean.contaminated) == (12, 2, True, False)
    assert hit.items_sha256 == hashlib.sha256(b"b").hexdigest()
    alone = decontaminate(docs, benchmark.filter("item_id is null")).filter("doc_id = 1").first()
    assert (alone.n_hit, alone.n_items, alone.items_sha256) == (12, 1, hashlib.sha256(b"").hexdigest())
