import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F
from wardline.llm.importance import gumbel, kth_largest, log_ratios, resample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_weights_separate_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = resample(docs.withColumn("key", F.lit(1)), labels).collect()
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    assert len(out) == docs.count() and sum(r.kept for r in out) == int(np.ceil(len(out) * sum(good.values()) / len(good)))
    w = {r.doc_id: r.log_weight for r in out if r.doc_id in good}
    a, b = [w[i] for i in w if good[i]], [w[i] for i in w if not good[i]]
    assert np.mean([x > y for x in a for y in b]) > 0.8


def test_the_weight_is_the_sum_of_log_ratios(spark):
    texts = ["a b c", "A  b", "z", None, "", "junk junk junk", "a b z"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")

    def grams(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return Counter([*w, *zip(w, w[1:], strict=False)])

    raw, target = sum(map(grams, texts), Counter()), grams(texts[0]) + grams(texts[1])
    p = lambda c, g: (c[g] + 1) / (sum(c.values()) + 65536)
    for r in resample(d, labels).collect():
        want = sum(n * np.log(p(target, g) / p(raw, g)) for g, n in grams(texts[r.doc_id]).items())
        assert abs(r.log_weight - want) < 1e-9 and r.n_grams == sum(grams(texts[r.doc_id]).values())
    assert sum(r.kept for r in resample(d, labels, share=0.5).collect()) == 4
    assert {r.log_weight for r in resample(d, labels.limit(0)).collect()} == {0.0}
    assert resample(d.limit(0), labels).count() == 0
    assert not log_ratios(np.zeros((2, 65536))).any()


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=9000), np.repeat(rng.normal(size=3), 3000), np.append(rng.normal(size=8000), [1e300, -1e300])):
        keys = spark.createDataFrame([(float(v),) for v in values], "key double").cache()
        for k in (1, 700, 5000, len(values)):
            value, ties = kth_largest(keys, k)
            assert value == np.sort(values)[::-1][k - 1] and ties == k - (values > value).sum()


def test_noise_is_gumbel_and_repeated_rows_are_drawn_together(spark):
    g = np.array([r[0] for r in spark.range(20000).select(gumbel(F.col("id"), 1)).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.std() - 1.2825) < 0.03
    d = spark.createDataFrame([(i // 3 if i % 4 else None, f"text {i // 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = resample(d, labels, share=0.4).collect()
    assert len(out) == 60 and sum(r.kept for r in out) >= 24


def test_ids_of_text_and_ties_with_null_ids(spark):
    d = spark.createDataFrame([(f"id-{i}", f"text of {i}") for i in range(8)], "doc_id string, text string")
    labels = spark.createDataFrame([("id-1", 1, 0), ("id-2", 0, 0)], "doc_id string, quality int, toxic int")
    assert sum(r.kept for r in resample(d, labels, share=0.5).collect()) == 4
    same = spark.createDataFrame([(None, ""), (None, "")] + [(3, "")] * 3, "doc_id long, text string")
    out = resample(same, labels.limit(0), share=0.4).collect()
    assert len(out) == 5 and sum(r.kept for r in out) in (2, 3, 5)
