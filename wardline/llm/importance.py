"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one word and two) are estimated: one of the raw text, from all documents,
and one of the target, from labelled good documents. A document's log-importance weight is the sum over its n-grams of the
log-ratio of the two. Adding Gumbel noise to the weights and taking the k largest draws k documents without replacement
in proportion to their weights (Xie et al., 2023); the noise is a hash of the id, so a draw can be repeated.

The target model is fit on a bounded sample: about ``SAMPLE`` labelled good documents by a hash of the id, whose ids are
sent to the tasks. Counts of the raw model and all weights cover every document. The k-th largest key is found by
narrowing a histogram of all keys; nothing but counts of ``BINS`` bins and one bin's keys reaches the driver.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.

Defined results: null text has no n-grams and weight 0; ties go to the smaller id, null ids first; repeated rows share
noise and weight and are drawn together as far as k allows, any of them last; without target documents all weights are 0; an
empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import Store
from wardline.llm.text_arrays import LOWER, PLAIN, mix, words_of

BUCKETS = 1 << 16
SAMPLE = 20_000
#: Counts that every bucket has before anything is seen.
SMOOTH = 1.0
BINS, FEW = 1024, 4096


def ngram_buckets(w) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each n-gram of a slice."""
    at, two = w.windows(2)
    doc = np.concatenate([w.doc, w.doc[at]])
    return doc, (mix(np.concatenate([w.hash, two])) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(rows: DataFrame, target: DataFrame, store: Store) -> np.ndarray:
    """Counts by bucket, of all rows (doc_id, text) and of those with an id in ``target`` (a bounded table)."""
    spark = rows.sparkSession
    ids = spark.sparkContext.broadcast([r["doc_id"] for r in target.toLocalIterator()])

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            own = pc.is_in(b.column(0), pa.array(ids.value, pa.string())).to_numpy(zero_copy_only=False)
            for i, j, w in words_of(b.column(1), PLAIN, LOWER):
                doc, bucket = ngram_buckets(w)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[own[i:j][doc]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    out = np.zeros((2, BUCKETS), np.int64)
    summed = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for r in summed.toLocalIterator():
        out[0][r["bucket"]], out[1][r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket; 0 without any target."""
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    p = counts + SMOOTH
    p = p / p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _weights(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight of each row."""
    held = rows.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches):
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, j, w in words_of(b.column(1), PLAIN, LOWER):
                doc, bucket = ngram_buckets(w)
                n[i:j], total[i:j] = np.bincount(doc, minlength=j - i), np.bincount(doc, held.value[bucket], j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total)], ["doc_id", "n_grams", "log_weight"])

    return rows.mapInArrow(weigh, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest value of the column ``key``, and how many of the rows that have just this value are among the k."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return high, k - above
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        bins = {r["bin"]: r for r in inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                break
            above += bins[b]["n"]
        low, high, n = bins[b]["low"], bins[b]["high"], bins[b]["n"]
        if n <= FEW:
            values = sorted((r["key"] for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            value = values[k - above - 1]
            return value, k - above - sum(x > value for x in values)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, size: int = SAMPLE) -> DataFrame:
    """doc_id, n_grams, log_weight, key (weight and noise) and kept (drawn) of every row of ``docs`` (doc_id, text).

    labels: doc_id, quality and toxic (0/1). share: of the rows that are drawn; by default the labels' share of good ones.
    """
    store = Store(docs.sparkSession, "importance")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    told = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("string").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    n, good = told.agg(F.count("*"), F.count_if("good")).first()
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    target = told.filter(F.col("good") & (hashed * good < size)).select("doc_id").distinct()
    ratios = log_ratios(_counts(rows.withColumn("doc_id", F.col("doc_id").cast("string")), target, store))
    weighed = store.put(_weights(rows, ratios).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weights")
    total = weighed.count()
    k = math.ceil(total * (share if share is not None else good / n if n else 1))
    if k <= 0 or k >= total:
        return weighed.withColumn("kept", F.lit(k > 0))
    value, ties = kth_largest(weighed, k)
    tied = weighed.filter(F.col("key") == value)
    kept, fits = F.col("key") > value, F.col("key") == value
    if tied.count() > ties:  # null ids first; rows of one id alike
        last = tied.orderBy("doc_id").limit(ties).agg(F.max("doc_id")).first()[0]
        fits = fits & (F.col("doc_id").isNull() if last is None else F.col("doc_id").isNull() | (F.col("doc_id") <= last))
    kept = kept | fits
    return weighed.withColumn("kept", F.coalesce(kept, F.lit(False)))
