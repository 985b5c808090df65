"""Components of a similarity graph whose candidate pairs share signatures, without emitting a group's pairs.

All nodes of a signature are held against one leader, chosen anew each round; nodes that are in one component by then
need no more checks between them. Pairs that are still in different components after the leader rounds are all checked,
so no link that joins two components is missed, while a group of thousands of near copies costs a few checks each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.llm.store import Store
from wardline.llm.text_arrays import mix

#: Leader rounds go on while more than this many pairs a node are open.
PAIRS_PER_NODE, LEADER_ROUNDS = 100, 8
#: So many first leader rounds see one signature in ``thin`` only. They merge what is nearly equal; the last round sees all signatures.
THIN_ROUNDS = 2
#: Nodes of a signature up to which all its pairs are made at once: work in proportion to the rows.
FEW = 16
#: Ids up to which a set of nodes is sent to all tasks (8 MB); larger ones are joined by a shuffle.
SENT = 1_000_000


def only(rows: DataFrame, column: str, pairs: DataFrame, store: Store) -> DataFrame:
    """The rows whose column is a node of ``pairs`` (a, b)."""
    ids = store.put(pairs.select(F.col("a").alias(column)).union(pairs.select("b")).distinct(), "ids", instead=True)
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, column, "left_semi")


def link_components(
    signed: DataFrame, total: int, likely: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], store: Store,
    per_node: int | None = None, near: Callable[[str, str], Column] | None = None, few: int = FEW, least_rounds: int = 0, band: Column | None = None,
    thin: int = 1,
) -> DataFrame | None:
    """(node, root) for all nodes with a link, or None without any link.

    signed: (node, sig, count), with the nodes of each signature. likely: keeps the pairs (a, b) that can be links, by what is
    cheap to see. judge: pairs (a, b) to (a, b, linked), written. near: condition over further columns of ``signed``, with the
    endings _a and _b, that every link meets; pairs that don't are never made. Signatures of ``few`` nodes at most give all their
    pairs; the others are held against leaders, ``least_rounds`` at least, until what is open is at most ``per_node`` pairs a node, counted by signature.
    thin: the first leader rounds see one signature in so many, for nodes with many of them; no link depends on these rounds.
    """
    # band: a whole number of further columns in which linked nodes differ by one at most; only neighbouring bands meet at the end.
    further = [c for c in signed.columns if c not in ("node", "sig", "count")]
    held = lambda df, side: df.withColumnsRenamed({c: f"{c}{side}" for c in ("node", "root", *further)})

    def met(rows: DataFrame, against: DataFrame, apart, on: tuple = ("sig",)) -> DataFrame:
        if len(on) > 1:
            rows = rows.withColumn("band", band)
            against = against.withColumn("band", F.explode(F.array(*(band + k for k in (-1, 0, 1)))))
        pairs = held(rows, "_b").join(held(against, "_a"), [*on]).filter(apart)
        pairs = pairs.filter(near("_a", "_b")) if near else pairs
        return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.col("node_b").alias("who"))

    first = None
    if few:
        small, signed = signed.filter(F.col("count") <= few).drop("count"), signed.filter(F.col("count") > few)
        first = likely(met(small, small, F.col("node_a") < F.col("node_b")).select("a", "b").distinct())
    signed = signed.drop("count")
    roots, done, rounds, rows = None, None, 0, signed
    most = (PAIRS_PER_NODE if per_node is None else per_node) * total
    while True:
        if roots is None:
            rows = signed.withColumn("root", F.col("node"))
            open_sigs = signed.groupBy("sig").agg(F.count("*").alias("n"), F.count("*").alias("own"), F.min("node").alias("top"))
        else:
            of = roots.select("node", F.col("root").alias("r"))
            rows = rows.drop("root").join(of, "node", "left").select("node", "sig", *further, F.coalesce("r", "node").alias("root"))
            mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
            rows = store.put(rows.join(mixed, "sig", "left_semi"), "open-rows", instead=True)
            per = rows.groupBy("sig", "root").count()
            open_sigs = per.groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"), F.max_by("root", "count").alias("top"))
            open_sigs = store.put(open_sigs, "open", instead=True)
        left = open_sigs.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0]
        if not left and first is None:
            break
        last = rounds >= least_rounds and ((left or 0) <= most or rounds >= LEADER_ROUNDS)
        if last:  # all that is open, but for pairs within the largest component of a signature
            against = rows.join(open_sigs.select("sig", "top"), "sig").filter("root <> top").drop("top")
        else:
            key = int(mix(np.full(1, rounds + 7, np.uint64)).view(np.int64)[0])
            thinned = rounds < THIN_ROUNDS and thin > 1
            seen = rows.filter(F.pmod("sig", F.lit(thin)) == 0) if thinned else rows
            chosen = seen.groupBy("sig").agg(F.min(F.col("node").bitwiseXOR(F.lit(key))).alias("x"))
            against = seen.join(chosen, "sig").filter(F.col("node").bitwiseXOR(F.lit(key)) == F.col("x")).drop("x")
        pairs = met(rows if last else seen, against, F.col("root_a") != F.col("root_b"), ("sig", "band") if last and band is not None else ("sig",))
        pairs = likely(pairs.select("a", "b").distinct() if last else pairs.groupBy("a", "b", "who").count())
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        if not last:  # one leader for a node and round: the one that it shares most signatures with
            w = Window.partitionBy("who").orderBy(F.desc("count"), "a", "b")
            pairs = pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").select("a", "b").distinct()
        if first is not None:
            pairs, first = first.unionByName(pairs.select("a", "b")).distinct(), None
        pairs = store.put(pairs.select("a", "b"), "pairs", instead=True)
        if pairs.isEmpty():
            if last:
                break
            rounds = THIN_ROUNDS if thinned else max(LEADER_ROUNDS, least_rounds)
            continue
        judged = judge(pairs)
        done = judged if done is None else done.unionByName(judged)
        if not judged.filter("linked").isEmpty():
            now = judged.filter("linked").select("a", "b")
            if roots is not None:  # what was linked before is a star around each root
                now = now.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = store.put(components(now, store), "roots", instead=True)
        if last:
            break
        rounds += 1
    return roots
