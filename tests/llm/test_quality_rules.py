import re
from collections import Counter

from pyspark.sql import functions as F

from wardline.llm.quality_rules import choose_cutoffs, keep_quality, passes, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "   ", "a b c", "x y z w v " * 8, "###$$$ a|b <c> é è ü ñ d e f g h", "one two\none two\n\none two\nother line here now yes ok go", "w " * 5000, "é" * 3000 + " b" * 20, "a\x0bb\x0cc\rd e f g h i j k a b c d e f g h i j"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", f"x{i}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string, n_words int")


def test_measures_equal_brute_force(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = {r.doc_id: r for r in quality_rules(docs(spark, TEXTS + real), labels).collect()}
    for i, t in enumerate(TEXTS + real):
        want = brute(t)
        assert tuple(out[i])[1:6] == want, (i, tuple(out[i]), want)
        assert out[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert out[i].kept == (not out[i].base_failed)  # nothing is certified by one label


def test_empty_table_and_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(docs(spark, TEXTS).limit(0), labels).count() == 0
    d = docs(spark, TEXTS)
    kept = keep_quality(d, labels)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules(d, labels).filter("kept").collect()}


def test_bound_is_exact():
    import numpy as np

    assert not passes(0, 100, 0.01, 0.05) and passes(0, 299, 0.01, 0.05) and not passes(1, 299, 0.01, 0.05)
    counts = np.zeros((4, 41), int)
    counts[:, 0], counts[:, 3] = 2000, 1
    assert choose_cutoffs({"en": counts}, 0.02, 0.05)["en"] == [1] * 4
    counts[:, 3] = 40
    assert choose_cutoffs({"en": counts}, 0.02, 0.05)["en"] == [4] * 4  # 40 of 2,040 are too many to lose
    assert choose_cutoffs({"en": counts // 4, "de": counts}, 0.02, 0.05) == {"en": [None] * 4, "de": [4] * 4}


def test_certified_cutoffs_reject_junk_and_keep_clean(spark):
    clean = [f"word{i} and some plain other words that make a clean line of text {i}" for i in range(3000)]
    junk = ["### $$$ %%% " * 6 + str(i) + " a b c d e f g h" for i in range(50)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = d.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality_rules(d, labels).filter("kept").collect()}
    assert kept == set(range(3000))
    assert {r.doc_id for r in keep_quality(d, labels).collect()} == kept


def test_repeats_are_no_trials_and_toxic_ones_are_not_good(spark):
    clean = "some plain words that make a clean line of text here {}"
    junk = " ".join(f"#$%&<{k}" for k in range(30))
    rows = [(i % 300, clean.format(i % 300), "en", "s", 1) for i in range(3000)] + [(5000, junk, "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    labels = d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") == 5000).cast("int").alias("toxic"))
    assert quality_rules(d, labels).filter("doc_id = 5000").first().kept  # 300 good documents certify nothing, though 3,000 rows would
    enough = spark.createDataFrame([(i, clean.format(i), "en", "s", 1) for i in range(3000)] + rows[-1:], d.schema)
    told = enough.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") == 5000).cast("int").alias("toxic"))
    assert not quality_rules(enough, told).filter("doc_id = 5000").first().kept


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "en", 1, "x", 2)], "doc_id long, text string, lang string, `__id` int, `a.b` string, n_words int")
    out = keep_quality(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == d.columns and out.collect() == d.collect()
