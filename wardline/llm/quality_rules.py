"""Quality rules with risk-controlled thresholds.

Every rule is a ratio measured on the whole text. Its cutoff is not guessed: for each stratum (by default the language
column) labelled good documents form the holdout, and a cutoff is accepted only if the exact binomial (Clopper-Pearson)
upper bound on the share of good documents it would reject is at most ``alpha / rules``. Cutoffs of a rule are tried
from the loosest to the tightest and the walk stops at the first that fails (fixed-sequence testing, so the walk needs
no correction); over strata x rules the level is divided by their number (Bonferroni). With probability of at least
``1 - delta`` the rules together reject at most ``alpha`` of the good documents of each stratum. A stratum with too few
labels certifies nothing and so rejects nothing beyond the fixed base rule.

Defined results: null text has no words; an empty table gives no rows; null or unseen strata have no cutoffs; null
labels are not used; repeated rows are judged alike, one result each; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.store import Store
from wardline.llm.text_arrays import byte_class, unique_per_doc, words_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Rules: ratio and the width of a step of its cutoffs. A document is rejected if its ratio reaches the cutoff step.
RULES = {"symbol": 0.01, "shout": 0.02, "repeat": 0.01, "dup_line": 0.005}
STEPS = 40

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouts long"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]
_SYMBOL, _SHOUT, _NEWLINE = byte_class(SYMBOLS), byte_class(b"!"), byte_class(b"\n")


def _repeated_words(w) -> np.ndarray:
    """Words of each document in windows that are found twice or more in it."""
    at, h = w.windows(WINDOW)
    if not len(at):
        return np.zeros(w.n_docs, np.int64)
    h = h + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=w.n_docs)


def _repeated_lines(w) -> np.ndarray:
    """Lines of each document that have a word and equal an earlier line of it."""
    full = w.offs[:-1] < w.offs[1:]
    starts = np.unique(np.concatenate([w.offs[:-1][full], np.flatnonzero(_NEWLINE[w.data]) + 1]))
    starts = starts[starts < len(w.data)]
    if not len(starts):
        return np.zeros(w.n_docs, np.int64)
    doc = np.searchsorted(w.offs, starts, "right") - 1
    newline = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_NEWLINE[w.data], out=newline[1:])
    ends = np.concatenate([starts[1:], [len(w.data)]])
    ends = ends - (newline[ends] - newline[ends - 1])
    letters = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.inside, out=letters[1:])
    has = letters[ends] > letters[starts]
    doc, h = doc[has], w.span_hash(starts[has], ends[has])
    distinct, _ = unique_per_doc(doc, h)
    return np.bincount(doc, minlength=w.n_docs) - np.bincount(distinct, minlength=w.n_docs)


def measure_column(text: pa.Array) -> list[np.ndarray]:
    """The measures, in order of ``MEASURES``, for each text."""
    parts: list[list[np.ndarray]] = [[] for _ in _NAMES]
    for _, _, w in words_of(text):
        found = (w.counts, w.per_doc(w.inside & ((w.data & 0xC0) != 0x80)), w.per_doc(_SYMBOL[w.data]), _repeated_lines(w), _repeated_words(w), w.per_doc(_SHOUT[w.data]))
        for p, x in zip(parts, found, strict=True):
            p.append(x)
    return [np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in parts]


def _measure(batches):
    for b in batches:
        rest = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x) for x in measure_column(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], *_NAMES])


def measure(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of every row."""
    rows = docs.select(*(F.col(k) for k in keep), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(_measure, T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(MEASURES).fields]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _steps() -> Column:
    """Array over RULES of the step (0 to STEPS) that a document's ratio reaches."""
    per_char, per_word = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    ratio = {"symbol": F.col("n_symbols") / per_char, "shout": F.col("n_shouts") / per_word, "repeat": F.col("n_repeat_words") / per_word, "dup_line": F.col("n_dup_lines") / per_word}
    return F.array(*(F.least(F.floor(ratio[r] / F.lit(width)), F.lit(STEPS)).cast("int") for r, width in RULES.items()))


def passes(k: int, n: int, risk: float, level: float) -> bool:
    """Is the exact upper bound at ``level`` on a rate with k of n seen at most ``risk``? That is P(Bin(n, risk) <= k) <= level."""
    if n <= 0 or k >= n * risk:
        return False
    i = np.arange(k + 1)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    terms = log_choose + i * math.log(risk) + (n - i) * math.log1p(-risk)
    top = terms.max()
    return top + math.log(np.exp(terms - top).sum()) <= math.log(level)


def choose_cutoffs(counts: dict[str, np.ndarray], alpha: float, delta: float) -> dict[str, list[int | None]]:
    """Tightest certified step per stratum and rule. counts: per stratum, good documents by rule and step."""
    rules, out = len(RULES), {}
    level = delta / max(1, rules * len(counts))
    for stratum, c in counts.items():
        out[stratum] = []
        for row in c:
            n, best = int(row.sum()), None
            for step in range(STEPS, 0, -1):
                if not passes(int(row[step:].sum()), n, alpha / rules, level):
                    break
                best = step
            out[stratum].append(best)
    return out


def calibrate(measured: DataFrame, labels: DataFrame, store: Store, stratum: str = "__stratum", alpha: float = 0.02, delta: float = 0.05) -> dict[str, list[int | None]]:
    """Cutoffs from all labelled documents (``labels``: doc_id, quality 0/1, toxic 0/1; good ones are of quality and not toxic).

    A document counts once, however often it or its label is repeated: repeats are no trials of their own. The bound is on the
    good documents that pass the base rule. Only counts by stratum, rule and step reach the driver; strata that have too
    few good labels to certify even a cutoff that rejects none of them are left out before.
    """
    rules = len(RULES)
    least = math.log(delta) / math.log1p(-alpha / rules)
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").alias("__id")).distinct()
    mine = measured.filter(~base_failed()).filter(F.col(stratum).isNotNull()).join(good, "__id", "left_semi").select("__id", F.col(stratum).alias("s"), _steps().alias("steps"))
    steps = mine.dropDuplicates(["__id"]).select("s", F.posexplode("steps").alias("rule", "step"))
    seen = store.put(steps.groupBy("s", "rule", "step").count(), "seen")
    enough = seen.groupBy("s", "rule").agg(F.sum("count").alias("n")).filter(F.col("n") >= least).select("s").distinct()
    counts: dict[str, np.ndarray] = {}
    for r in seen.join(enough, "s", "left_semi").collect():
        counts.setdefault(r["s"], np.zeros((rules, STEPS + 1), np.int64))[r["rule"], r["step"]] += r["count"]
    return choose_cutoffs(counts, alpha, delta)


def verdict(cutoffs: dict[str, list[int | None]], stratum: Column) -> Column:
    """kept: passes the base rule and stays below each certified cutoff of its stratum."""
    if not cutoffs:
        return ~base_failed()
    never = STEPS + 1
    table = F.create_map(*(x for s, c in cutoffs.items() for x in (F.lit(s), F.array(*(F.lit(never if v is None else v) for v in c)))))
    limits = F.try_element_at(table, F.coalesce(stratum, F.lit("")))
    return ~base_failed() & F.coalesce(F.forall(F.zip_with(_steps(), limits, lambda a, b: a < b), lambda x: x), F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs`` (doc_id, text, ``stratum``)."""
    store = Store(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").alias("__id"), F.col(stratum).cast("string").alias("__stratum"), F.col("text").alias("__body"))
    seen = store.put(measure(rows, "__id", "__stratum", text="__body"), "measures")
    cutoffs = calibrate(seen, labels, store, alpha=alpha, delta=delta)
    kept = verdict(cutoffs, F.col("__stratum"))
    return seen.select(F.col("__id").alias("doc_id"), *(F.col(c) for c in _NAMES[:5]), base_failed().alias("base_failed"), kept.alias("kept"), "n_shouts")


def keep_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rows = docs.select(F.col("doc_id").alias("__id"), F.col(stratum).cast("string").alias("__stratum"), F.col("text").alias("__body"))
    store = Store(docs.sparkSession, "quality")
    seen = store.put(measure(rows, "__id", "__stratum", text="__body"), "measures")
    kept = verdict(calibrate(seen, labels, store, alpha=alpha, delta=delta), F.col("__stratum"))
    store.keep()
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), F.col(stratum).cast("string").alias("__stratum"), F.col("text").alias("__body"))
    return measure(packed, "__row", "__stratum", text="__body").filter(kept).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
