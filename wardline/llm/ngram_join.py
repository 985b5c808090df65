"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word n-grams (tokens). Sets r and s can only have ``100 * |r & s| >= percent *
|r | s|`` if all but t(r) = |r| - ceil(percent * |r| / 100) tokens of r are in s. Tokens have a global order: by class,
rare before frequent, then by hash. The *prefix* of a set is its shortest run in that order which t(r) missing tokens
can't rob of all its signatures, where a rare token is a signature by itself and frequent tokens are indexed by
combinations of two, very frequent ones of three (pkwise; Wang, Xiao et al., 2016). Combinations are made within one of
a few hash groups, which keeps their number small; each group costs its class less one token of the prefix, and the
prefix extends by as much. Linked sets share a signature whatever the classes are, so classes only steer cost: they come
from exact counts of the signatures in all documents.

Candidates are verified with whole sets, read from the texts again. Equal sets are one node from the start, whatever
their number. Of a signature's nodes all are first held against one leader, chosen anew each round; nodes that are in one
component need no more checks between them. Pairs that are still in different components after the leader rounds are
all verified, so no link that joins two components is missed, and a group of near copies never emits all its pairs.

Defined results: null texts and texts without words have empty sets, are linked with nothing and form their own
component; fewer words than n are one token; null ids take part and, alone in a component, give a null component_id;
repeated rows are equal sets; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.linking import link_components
from wardline.llm.store import Store
from wardline.llm.text_arrays import LOWER, PLAIN, Words, mix, slices, unique_per_doc, utf8

#: Signatures that more nodes share than these are of class 2 and 3: combinations of two and of three tokens.
FREQUENT, VERY_FREQUENT = 64, 4000
#: Hash groups of combinations, by class.
GROUPS = {2: 8, 3: 4}
#: Frequent tokens known to the tasks; above that FREQUENT is doubled until they fit, which changes cost only.
MOST_FREQUENT = 1_000_000
#: Leader rounds go on while more than this many pairs a node would be left to verify.
PAIRS_PER_NODE = 100
_U = np.uint64
PARITIES = 1024
_BINS = [f"p{k}" for k in range(PARITIES // 64)]
#: The parities folded to a quarter, which rule most pairs out before the whole ones are joined.
_FOLDS = [f"q{k}" for k in range(PARITIES // 256)]
#: Pairs of sets of so many tokens each are held against each other by wider parities before their texts are joined.
LONG = 1500
#: The first leader rounds see one signature in so many.
THIN = 16


def sets_of(text: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For rows i to j: the row (from i) and hash of each distinct token, both ascending."""
    data, offs = utf8(text)
    for i, j in slices(offs):
        w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], PLAIN, LOWER)
        at, h = w.windows(n)
        docs, hashes = [w.doc[at]], [h]
        for k in range(1, n):  # all words of a short text are one token
            short = np.flatnonzero(w.counts == k)
            if len(short):
                at, h = w.windows(k)
                own = np.isin(w.doc[at], short)
                docs.append(w.doc[at[own]])
                hashes.append(h[own])
        yield i, j, *unique_per_doc(np.concatenate(docs), np.concatenate(hashes))


def missing(n: np.ndarray | int, percent: int):
    """Tokens that a linked set may lack."""
    return n - (percent * n + 99) // 100


def small_limit(percent: int) -> int:
    """Sets of fewer tokens use single tokens only: from here on a prefix can always pay for its groups."""
    cost = sum((k - 1) * g for k, g in GROUPS.items())
    n = cost + 1
    while n - cost < missing(n, percent) + 1:
        n += 1
    return n


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h ^ mix(np.full(1, salt + 1, np.uint64)))


def fingerprints(rows: int, doc: np.ndarray, h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set."""
    n = np.bincount(doc, minlength=rows)
    out = []
    for k in (2 * salt, 2 * salt + 1):
        total = np.concatenate([[_U(0)], np.cumsum(_salted(h, k))])
        first = np.cumsum(n) - n
        out.append((total[first + n] - total[first]).view(np.int64))
    return n.astype(np.int64), *out


def parities(rows: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set the parity of its tokens in each of PARITIES bins, as 64-bit words: rows x (PARITIES / 64).

    Sets differ in at least as many tokens as their parities differ in bins, which rules most pairs out exactly.
    """
    at = doc * PARITIES + (h >> _U(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, PARITIES), axis=1).view(np.int64)


def schemes(h: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Single tokens as signatures of the two schemes: (which of them, signature). Sizes near the limit use both."""
    low = small_limit(percent)
    large, small = n >= low, n <= 100 * low // percent + 1
    return [(np.flatnonzero(large), h[large]), (np.flatnonzero(small), _salted(h[small], 99))]


def _lists(rows: int, doc: np.ndarray, values: np.ndarray) -> pa.Array:
    order = np.argsort(doc, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[order].view(np.int64)))


def describe(rows: DataFrame, n: int, percent: int, salt: int, keep_text: bool = False, signed: bool = True) -> DataFrame:
    """doc_id, n, f1, f2 and the signatures by hash order alone, or the text, of each row (doc_id, text)."""
    def batches(it):
        for b in it:
            for i, j, doc, h in sets_of(b.column(1), n):
                size, f1, f2 = fingerprints(j - i, doc, h, salt)
                out = [b.column(0).slice(i, j - i), pa.array(size), pa.array(f1), pa.array(f2)]
                if signed:
                    bins = parities(j - i, doc, h)
                    each = size[doc]
                    head = np.arange(len(doc)) - (np.cumsum(size) - size)[doc] <= missing(each, percent)
                    doc, h, each = doc[head], h[head], each[head]
                    found = schemes(h, each, percent)
                    out.append(_lists(j - i, np.concatenate([doc[w] for w, _ in found]), np.concatenate([s for _, s in found])))
                    out += [pa.array(x) for x in np.ascontiguousarray(bins.T)]
                if keep_text:
                    out.append(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "f1", "f2", *(["sigs", *_BINS] if signed else []), *["text"] * keep_text])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, f1 long, f2 long"
    return rows.mapInArrow(batches, schema + (", sigs array<long>, " + ", ".join(f"{p} long" for p in _BINS)) * signed + ", text string" * keep_text)


def _combined(tokens: np.ndarray, k: int) -> np.ndarray:
    """Signatures of all combinations of k tokens."""
    chosen = np.array(list(combinations(range(len(tokens)), k)), np.int64).reshape(-1, k)
    key = tokens[chosen[:, 0]]
    for c in range(1, k):
        key = mix(key) ^ tokens[chosen[:, c]]
    return mix(key)


def prefix(tokens: np.ndarray, cls: np.ndarray, lacking: int) -> np.ndarray:
    """Signatures of one set; tokens in global order."""
    groups: dict[tuple[int, int], list[int]] = {}
    single, worth = [], 0
    for at, (t, c) in enumerate(zip(tokens.tolist(), cls.tolist(), strict=True)):
        if c == 1:
            single.append(at)
            worth += 1
        else:
            own = groups.setdefault((c, t % GROUPS[c]), [])
            own.append(at)
            worth += len(own) >= c
        if worth > lacking:
            break
    return np.concatenate([tokens[single], *(_combined(tokens[own], c) for (c, _), own in groups.items())])


def _classes(h: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.ones(len(h), np.int64)
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, classes[at], 1)


def resign(text: pa.Array, frequent: np.ndarray, classes: np.ndarray, n: int, percent: int, salt: int, wide: bool):
    """f1 and signatures of each text under known frequent tokens. wide: single tokens of a longer prefix, for counting.

    The two schemes have an order each; that of small sets knows its frequent tokens by their salted hashes.
    """
    low = small_limit(percent)
    for i, j, doc, h in sets_of(text, n):
        size, f1, _ = fingerprints(j - i, doc, h, salt)
        lack = missing(size, percent)
        who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for large in (True, False):
            fits = size >= low if large else size <= 100 * low // percent + 1
            own = np.flatnonzero(fits[doc])
            d, t = doc[own], h[own] if large else _salted(h[own], 99)
            cls = _classes(t, frequent, classes)
            order = np.lexsort((h[own], cls, d))
            d, t, cls = d[order], t[order], cls[order]
            first = np.searchsorted(d, np.arange(j - i + 1))
            place = np.arange(len(d)) - first[d]
            if wide or not large:
                head = place <= (lack[d] * 3 // 2 + 16 if wide else lack[d])
                who.append(d[head])
                what.append(t[head])
                continue
            rare = np.bincount(d[cls == 1], minlength=j - i)
            head = (rare > lack)[d] & (place <= lack[d])
            who.append(d[head])
            what.append(t[head])
            for x in np.flatnonzero((rare <= lack) & fits).tolist():
                sigs = prefix(t[first[x] : first[x + 1]], cls[first[x] : first[x + 1]], int(lack[x]))
                who.append(np.full(len(sigs), x))
                what.append(sigs)
        yield f1, _lists(j - i, np.concatenate(who), np.concatenate(what))


def _read_again(docs: DataFrame, nodes: DataFrame, n: int, percent: int, salt: int) -> DataFrame:
    """(f1, text) of the nodes (f1, doc), from the texts of one document each."""
    ids = nodes.select(F.col("doc").alias("__doc")).distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__doc"]), "left_semi")
    again = describe(rows, n, percent, salt, keep_text=True, signed=False).select("f1", "text")
    return again.join(nodes.select("f1"), "f1", "left_semi").dropDuplicates(["f1"])


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """(f1, n, odd): size and parities of each set in at least two bins a token, a power of two of them."""
    def batches(it):
        for b in it:
            for i, j, doc, h in sets_of(b.column(1), n):
                size = np.bincount(doc, minlength=j - i)
                ends, out = np.cumsum(size), []
                for k in range(j - i):
                    bits = max(3, int(2 * size[k] - 1).bit_length())  # whole bytes
                    at = (h[ends[k] - size[k] : ends[k]] >> _U(64 - bits)).astype(np.int64)
                    out.append(np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), pa.array(out, pa.binary())], ["f1", "n", "odd"])

    return texts.select("f1", "text").mapInArrow(batches, "f1 long, n long, odd binary")


def _apart(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (.., na, sa, nb, sb) that sizes and ``_sketches`` rule out. Two neighbouring bins in one give the parities in half as many bins."""
    def batches(it):
        for batch in it:
            rows = batch.to_pydict()
            out = []
            for x, y, total in zip(rows["sa"], rows["sb"], np.add(rows["na"], rows["nb"]).tolist(), strict=True):
                odd = [np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)]
                least = min(map(len, odd))
                odd = [v.reshape(least, -1).sum(1) & 1 for v in odd]
                out.append(int((odd[0] != odd[1]).sum()) > total - 2 * -(-percent * total // (100 + percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(batches, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) of each pair (a, b) by its whole sets."""
    rows = pairs.join(texts.select(F.col("f1").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("f1").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def batches(it):
        for batch in it:
            offs = np.concatenate([[0], np.cumsum(sum(np.diff(utf8(batch.column(c))[1]) for c in (2, 3)))])
            for i, j in slices(offs):
                b = batch.slice(i, j - i)
                doc, h, total = [], [], np.zeros(j - i, np.int64)
                for c in (0, 1):  # each text of a slice is read once, however many pairs it is in
                    _, at, own = np.unique(b.column(c).to_numpy(), return_index=True, return_inverse=True)
                    parts = [(d + i0, x) for i0, _, d, x in sets_of(b.column(c + 2).take(pa.array(at)), n)]
                    d, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                    size = np.bincount(d, minlength=len(at))
                    first, each = (np.cumsum(size) - size)[own], size[own]
                    doc.append(np.repeat(np.arange(j - i), each))
                    h.append(x[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first, each)])
                    total += each
                doc = np.concatenate(doc)
                key = np.concatenate(h) ^ mix(doc.astype(np.uint64))
                order = np.argsort(key, kind="stable")
                twice = key[order][1:] == key[order][:-1]
                both = np.bincount(doc[order[1:][twice]], minlength=j - i)
                union = total - both
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((100 * both >= percent * union) & (union > 0))], ["a", "b", "linked"])

    return rows.mapInArrow(batches, "a long, b long, linked boolean")


def _signatures(docs: DataFrame, nodes: DataFrame, store: Store, n: int, percent: int, salt: int, first: DataFrame) -> DataFrame:
    """(f1, sig) of all nodes. first: f1 and sigs by hash order alone.

    A node whose prefix by hash order has no frequent token keeps it; the others are signed again under the classes. Tokens
    that come into their prefixes instead are counted once more, over a longer prefix, before the classes are final.
    """
    plain = first.select("f1", F.explode("sigs").alias("sig"))

    def frequent(counts: DataFrame) -> DataFrame:
        least = FREQUENT
        while counts.filter(F.col("count") > least).count() > MOST_FREQUENT:
            least *= 2
        return counts.filter(F.col("count") > least)

    def sign(texts: DataFrame, hot: DataFrame, wide: bool) -> DataFrame:
        known: dict[int, int] = {}
        for r in hot.toLocalIterator():
            known[r["sig"]] = max(known.get(r["sig"], 2), 3 if r["count"] > VERY_FREQUENT else 2)
        keys = np.array(list(known), np.int64).view(np.uint64)
        order = np.argsort(keys)
        held = docs.sparkSession.sparkContext.broadcast((keys[order], np.array(list(known.values()), np.int64)[order]))

        def batches(it):
            for b in it:
                for f1, sigs in resign(b.column(1), *held.value, n, percent, salt, wide):
                    yield pa.RecordBatch.from_arrays([pa.array(f1), sigs], ["f1", "sigs"])

        return texts.select("f1", "text").mapInArrow(batches, "f1 long, sigs array<long>")

    hot = frequent(store.put(plain.groupBy("sig").count().filter(F.col("count") > FREQUENT), "counts"))
    if hot.isEmpty():
        return plain
    touched = store.put(plain.join(hot.select("sig"), "sig", "left_semi").select("f1").distinct().join(nodes, "f1"), "touched")
    texts = store.put(_read_again(docs, touched, n, percent, salt), "touched-texts", tight=True)
    more = sign(texts, hot, True).select(F.explode("sigs").alias("sig")).groupBy("sig").count().filter(F.col("count") > FREQUENT)
    more = frequent(store.put(more.join(hot.select("sig"), "sig", "left_anti"), "counts-again"))
    if not more.isEmpty():
        hot = hot.unionByName(more)
        also = store.put(plain.join(more.select("sig"), "sig", "left_semi").select("f1").distinct().join(touched.select("f1"), "f1", "left_anti").join(nodes, "f1"), "also")
        texts = texts.unionByName(store.put(_read_again(docs, also, n, percent, salt), "also-texts", tight=True))
        touched = touched.unionByName(also)
    rest = first.join(touched.select("f1"), "f1", "left_anti").select("f1", "sigs")
    found = store.put(rest.unionByName(sign(texts, hot, False)), "signatures")  # read twice, so that texts are signed once
    store.drop("first", "touched-texts", "also-texts")
    return found.select("f1", F.explode("sigs").alias("sig"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text), and the hashes of its set and component.

    component_id: smallest doc_id that links reach. Rows with equal sets share set_id; set_root is a set_id of the component.
    """
    return _components(docs, n, percent)[0]


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    store = Store(spark, "jaccard")
    salt = 0
    while True:
        told = store.put(describe(rows, n, percent, salt), "told")
        nodes = store.put(told.filter("n > 0").groupBy("f1").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), (F.min("f2") != F.max("f2")).alias("clash"), *(F.max(p).alias(p) for p in _BINS)), "nodes")
        if nodes.filter("clash").isEmpty():
            break
        salt += 1
    bins = nodes.select("f1", "n", *_BINS)
    nodes = nodes.select("f1", "doc", "n")
    own = told.filter("n > 0").join(nodes.select("f1", "doc"), "f1")
    first = store.put(own.filter(F.col("doc_id").eqNullSafe(F.col("doc"))).select("f1", "sigs"), "first")
    told = store.put(told.select("doc_id", "n", "f1"), "documents")
    store.drop("told")

    sigs = _signatures(rows, nodes, store, n, percent, salt, first)
    shared = sigs.groupBy("sig").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"), F.count("*").alias("count")).filter("lo <> hi").select("sig", "count")
    signed = store.put(sigs.join(shared, "sig").join(bins.select("f1", "n"), "f1"), "signed")
    store.drop("first", "signatures")

    folds = bins.select("f1", "n", *(reduce(Column.bitwiseXOR, (F.col(p) for p in _BINS[k :: len(_FOLDS)])).alias(q) for k, q in enumerate(_FOLDS)))

    def sized(a: str, b: str) -> Column:
        return F.greatest(f"n{a}", f"n{b}") * percent <= F.least(f"n{a}", f"n{b}") * 100

    def likely(pairs: DataFrame) -> DataFrame:
        """By the tokens in which the sets can differ at most: folded parities first, then whole ones."""
        for table, words in ((folds, _FOLDS), (bins, _BINS)):
            both = pairs
            for side in ("a", "b"):
                both = both.join(table.select(F.col("f1").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *words))), side)
            total = F.col("n_a") + F.col("n_b")
            most = total - 2 * F.ceil(percent * total / (100 + percent))
            apart = reduce(Column.__add__, (F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in words))
            pairs = both.filter(apart <= most).select(*pairs.columns)
        return pairs

    def judge(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("f1")).union(pairs.select("b")).distinct()
        needed = store.put(nodes.join(ends, "f1").select("f1", "doc", "n"), "needed")
        texts = store.put(_read_again(rows, needed, n, percent, salt), "texts", tight=True)
        long = needed.filter(F.col("n") >= LONG).select("f1")
        if not long.isEmpty():
            wide = store.put(_sketches(texts.join(long, "f1", "left_semi"), n), "sketches")
            told = pairs.join(long.withColumnRenamed("f1", "a"), "a", "left_semi").join(long.withColumnRenamed("f1", "b"), "b", "left_semi")
            for side in ("a", "b"):
                told = told.join(wide.select(F.col("f1").alias(side), F.col("n").alias(f"n{side}"), F.col("odd").alias(f"s{side}")), side)
            apart = store.put(_apart(told, percent), "apart")
            judged = _verify(pairs.join(apart, ["a", "b"], "left_anti"), texts, n, percent).unionByName(apart.withColumn("linked", F.lit(False)))
        else:
            judged = _verify(pairs, texts, n, percent)
        judged = store.put(judged, "judged")
        store.drop("texts", "needed", "sketches", "apart")
        return judged

    roots = link_components(signed.withColumnRenamed("f1", "node"), nodes.count(), likely, judge, store, PAIRS_PER_NODE, near=sized, few=0, thin=THIN)
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    named = nodes.join(roots, F.col("f1") == F.col("node"), "left").select("f1", "doc", F.coalesce("root", "f1").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = store.put(named.join(smallest, "root").select("f1", "root", "component_id"), "named")
    out = told.join(named, "f1", "left")
    alone = F.col("n") == 0
    found = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~alone, F.col("f1")).alias("set_id"), F.when(~alone, F.col("root")).alias("set_root"))
    return found, salt


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one of each component, the one with its smallest doc_id. Rows without words all stay; columns may have any names."""
    found, salt = _components(docs, n, percent)
    chosen = found.filter("set_id is not null and doc_id <=> component_id").groupBy("set_root").agg(F.min("set_id").alias("__set"), F.min("doc_id").alias("__id"))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"))
    unpacked = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        stay = found.filter("set_id is null").select(F.col("doc_id").alias("__id")).unionByName(chosen.select("__id"))
        return packed.join(stay, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select(*unpacked)
    # Repeated ids: rows are told apart by their sets.
    def batches(it):
        for b in it:
            for i, j, doc, h in sets_of(b.column(2), n):
                size, f1, _ = fingerprints(j - i, doc, h, salt)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(size), pa.array(f1)], ["row", "id", "n", "f1"])

    schema = T.StructType([*packed.schema.fields, T.StructField("n", T.LongType()), T.StructField("f1", T.LongType())])
    told = packed.withColumn("body", F.col("row").getField("text").cast("string")).mapInArrow(batches, schema)
    one = told.filter("n > 0").join(chosen, (F.col("f1") == F.col("__set")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["f1"])
    return told.filter("n = 0").unionByName(one).select(*unpacked)
