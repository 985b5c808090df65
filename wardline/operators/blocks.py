"""The similarity graph in blocks, for actors that share their URLs with very many others.

A join of all pairs that share a URL shuffles each of them. Here sources are ordered by their sets and dealt into blocks of at
most ``BLOCK``; one task compares two blocks by products of matrices, and a node's neighbours in a block are a row of bits. Only
blocks that share an item are compared. The results are those of ``graph``. A component of n nodes takes n x n / 8 bytes in each task
that searches it.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.components import connected_components
from wardline.functions.trail import checkpoint, written

SHIFT = 10
#: Sources of a block: ids are dense within a partition, and partitions begin at multiples of 2^33.
BLOCK = 1 << SHIFT
#: Items that are multiplied at once; up to 2^24 of them float32 is exact.
COLUMNS = 2048
#: Sources of shortest paths of one task, of one product, and rows that are unpacked at once.
SOURCES_PER_TASK, STEP, ROWS = 1024, 256, 256
PARTS = 96


def shared_pairs(items: DataFrame) -> int:
    """How many rows a join of all pairs that share a URL would make."""
    counts = items.filter("of = 0 and item is not null").groupBy("item").agg(F.count("*").cast("double").alias("n"))
    return int(counts.agg(F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0.0))).first()[0])


def place(items: DataFrame) -> DataFrame:
    """(source_ip, nu, na, urls, agents, id, block): sizes of the sets, null included, their items as numbers, and the place by their order."""
    known = checkpoint(items.filter("item is not null").select("of", "item").distinct().orderBy("of", "item")).withColumn("k", F.monotonically_increasing_id())
    coded = items.join(known, ["of", "item"], "left")
    sets = coded.groupBy("source_ip").agg(
        F.count_if(F.col("of") == 0).cast("double").alias("nu"), F.count_if(F.col("of") == 1).cast("double").alias("na"),
        *(F.sort_array(F.collect_list(F.when(F.col("of") == k, F.col("k")))).alias(name) for k, name in ((0, "urls"), (1, "agents"))),
    )
    placed = checkpoint(sets).orderBy("agents", "urls", "source_ip")
    return checkpoint(placed).withColumn("id", F.monotonically_increasing_id()).withColumn("block", F.shiftright("id", SHIFT))


def _set(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items, and (row, index of the item) of each entry."""
    found, at = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), return_inverse=True)
    return found, np.repeat(np.arange(len(lists), dtype=np.int16), [len(x) for x in lists]), at.astype(np.uint16 if len(found) < 1 << 16 else np.int32)


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    held = (pdf["source_ip"].tolist(), pdf["id"].to_numpy(), pdf["nu"].to_numpy(), pdf["na"].to_numpy(), _set(pdf["urls"].tolist()), _set(pdf["agents"].tolist()))
    return pd.DataFrame({"block": [key[0]], "data": [zlib.compress(pickle.dumps(held), 1)]})


def block_pairs(placed: DataFrame, threshold: float, least: float) -> DataFrame:
    """(p, q, one, two): packed blocks p <= q that share a URL, or an agent where that alone can make an edge; and each with itself."""
    packed = checkpoint(placed.groupBy("block").applyInPandas(_pack, "block long, data binary"))
    each = placed.select("block", F.explode("urls" if threshold >= least else F.concat("urls", "agents")).alias("k")).distinct()
    between = each.join(each.withColumnRenamed("block", "q"), "k").filter("block < q").select(F.col("block").alias("p"), "q").distinct()
    pairs = between.union(packed.select("block", "block"))
    first = pairs.join(packed.select(F.col("block").alias("p"), F.col("data").alias("one")), "p")
    return first.join(packed.select(F.col("block").alias("q"), F.col("data").alias("two")), "q").select("p", "q", "one", "two").repartition(PARTS)


def _dense(of, n: int, columns: np.ndarray) -> np.ndarray:
    found, row, at = of
    place = np.full(len(found), -1, np.int32)
    place[columns] = np.arange(len(columns))
    to = place[at]
    out = np.zeros((n, len(columns)), np.float32)
    out[row[to >= 0], to[to >= 0]] = 1
    return out


def _both(one, two, n: int, m: int) -> np.ndarray:
    """How many items each two rows share."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    out = np.zeros((n, m), np.float32)
    for at in range(0, len(i), COLUMNS):
        out += _dense(one, n, i[at : at + COLUMNS]) @ _dense(two, m, j[at : at + COLUMNS]).T
    return out.astype(float)


def _weights(one, two, by_url: float, by_agent: float) -> np.ndarray:
    """As ``graph._weight``, for each two rows of two blocks."""
    n, m = len(one[1]), len(two[1])
    urls, agents = _both(one[4], two[4], n, m), _both(one[5], two[5], n, m)
    urls /= one[2][:, None] + two[2][None, :] - urls
    np.divide(agents, one[3][:, None] + two[3][None, :] - agents, out=agents, where=agents > 0)
    return by_url * urls + by_agent * agents


def edges(placed: DataFrame, threshold: float, by_url: float, by_agent: float) -> DataFrame:
    """(src, dst, weight) with src < dst."""
    schema = pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())])

    def made(batches):
        for batch in batches:
            for x, y in zip(batch.column("one"), batch.column("two")):
                one, two = (pickle.loads(zlib.decompress(b.as_py())) for b in (x, y))
                same, weights = x == y, _weights(one, two, by_url, by_agent)
                names, rank = np.unique(np.array([*one[0], *two[0]], dtype=object), return_inverse=True)
                words, rank = pa.array(names, pa.string()), rank.astype(np.int32)
                for at in range(0, len(weights), 128):
                    i, j = np.nonzero(weights[at : at + 128] > threshold)
                    i += at
                    if same:
                        i, j = i[j > i], j[j > i]
                    a, b = rank[i], rank[len(one[0]) + j]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([words.take(pa.array(np.minimum(a, b))), words.take(pa.array(np.maximum(a, b))), pa.array(weights[i, j])], schema=schema)

    return block_pairs(placed, threshold, by_agent).select("one", "two").mapInArrow(made, "src string, dst string, weight double")


def _links(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column with an edge the least row that edges reach."""
    n = len(hit)
    rows, columns = np.where(hit.any(axis=1), np.arange(n), n), np.full(hit.shape[1], n)
    while True:
        columns_now = np.where(hit, rows[:, None], n).min(axis=0)
        rows_now = np.minimum(rows, np.where(hit, columns_now[None, :], n).min(axis=1))
        if (rows_now == rows).all() and (columns_now == columns).all():
            return rows, columns
        rows, columns = rows_now[np.minimum(rows_now, n - 1)] if n else rows_now, columns_now
        rows = np.where(hit.any(axis=1), rows, n)


def neighbours(placed: DataFrame, threshold: float, by_url: float, by_agent: float) -> DataFrame:
    """(id, other, bits): neighbours of id in the block ``other``, itself included; and (id, other, null): edges that make a forest of each two blocks."""

    def made(batches):
        for batch in batches:
            for x, y, p, q in zip(batch.column("one"), batch.column("two"), batch.column("p").to_numpy(), batch.column("q").to_numpy()):
                one, two = (pickle.loads(zlib.decompress(b.as_py())) for b in (x, y))
                hit = _weights(one, two, by_url, by_agent) > threshold
                if p == q:
                    np.fill_diagonal(hit, True)
                yield from (_bits(one[1], q, hit), *([] if p == q else [_bits(two[1], p, hit.T)]))
                rows, columns = _links(hit)
                for ids, to in ((one[1], rows), (two[1], columns)):
                    at = np.flatnonzero(to < len(hit))
                    at = at[ids[at] != one[1][to[at]]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(one[1][to[at]]), pa.nulls(len(at), pa.binary())], names=["id", "other", "bits"])

    return written(block_pairs(placed, threshold, by_agent).mapInArrow(made, "id long, other long, bits binary"))


def _bits(ids: np.ndarray, block: int, hit: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(hit.any(axis=1))
    packed = np.packbits(hit[at], axis=1)
    bits = pa.array([x.tobytes() for x in packed], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), block, np.int64)), bits], names=["id", "other", "bits"])


def _product(matrix: np.ndarray, n: int, rows: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), x.shape[1]))
    for at in range(0, len(rows), ROWS):
        out[at : at + ROWS] = np.unpackbits(matrix[rows[at : at + ROWS]], axis=1, count=n)[:, columns].astype(float) @ x
    return out


def paths(matrix: np.ndarray, n: int, sources: np.ndarray, twins: np.ndarray, deep: bool = True) -> tuple[np.ndarray, ...]:
    """As ``graph._paths`` for a connected matrix of bits; also each source's neighbours and linked pairs of twins among them.

    Only rows that aren't reached by all sources of a product, and columns that were reached last, are multiplied.
    """
    weight, total = twins.astype(float), np.zeros(n)
    apart, near, within = (np.zeros(len(sources)) for _ in range(3))
    for at in range(0, len(sources), STEP):
        mine = sources[at : at + STEP]
        own = slice(at, at + len(mine))
        first = np.unpackbits(matrix[mine], axis=1, count=n).T.astype(bool)
        near[own], within[own] = weight @ first, (weight * (weight - 1) / 2) @ first
        distance, sigma, level = np.where(first, 1, -1).astype(np.int16), first.astype(float), 1
        distance[mine, np.arange(len(mine))] = 0
        while True:
            last = distance == level
            columns, rows = np.flatnonzero(last.any(axis=1)), np.flatnonzero((distance < 0).any(axis=1) | (first.any(axis=1) if level == 1 else False))
            if not len(rows) or (level > 1 and not deep):
                break
            reach = np.where(last[columns], sigma[columns] * weight[columns, None], 0.0)
            found = _product(matrix, n, rows, columns, reach)
            if level == 1:
                apart[own] = (np.where(first[rows], weight[rows, None], 0.0) * found).sum(axis=0) / 2
            fresh = (distance[rows] < 0) & (found > 0)
            if not deep or not fresh.any():
                break
            level += 1
            distance[rows], sigma[rows] = np.where(fresh, level, distance[rows]), np.where(fresh, found, sigma[rows])
        delta = np.zeros_like(sigma)
        for k in range(level if deep else 0, 1, -1):
            last, before = distance == k, distance == k - 1
            columns, rows = np.flatnonzero(last.any(axis=1)), np.flatnonzero(before.any(axis=1))
            share = np.divide(weight[columns, None] * (1 + delta[columns]), sigma[columns], out=np.zeros((len(columns), len(mine))), where=last[columns])
            delta[rows] = np.where(before[rows], sigma[rows] * _product(matrix, n, rows, columns, share), delta[rows])
        total += delta @ weight[mine]
    return total, apart, near, within


def _matrix(ids: np.ndarray, of: np.ndarray, other: np.ndarray, bits: list) -> np.ndarray:
    """Rows of bits of the nodes ids, which are sorted; of (index of the node), other and bits are the neighbours in blocks."""
    n = len(ids)
    out = np.zeros((n, -(-n // 8)), np.uint8)
    order = np.argsort(of, kind="stable")
    of, other, bits = of[order], other[order], np.array(bits, dtype=object)[order]
    blocks = ids >> SHIFT
    for at in range(0, n, ROWS):
        rows = np.zeros((min(ROWS, n - at), n), np.uint8)
        lo, hi = np.searchsorted(of, [at, at + ROWS])
        for b in np.unique(other[lo:hi]):
            here = lo + np.flatnonzero(other[lo:hi] == b)
            a, z = np.searchsorted(blocks, [b, b + 1])
            if z > a:
                wide = np.frombuffer(b"".join(bits[here]), np.uint8).reshape(len(here), -1)
                rows[of[here] - at, a:z] = np.unpackbits(wide, axis=1)[:, ids[a:z] & (BLOCK - 1)]
        rows[np.arange(len(rows)), at + np.arange(len(rows))] = 0
        out[at : at + ROWS] = np.packbits(rows, axis=1)
    return out


def metrics(placed: DataFrame, classes: DataFrame, threshold: float, by_url: float, by_agent: float, deep: bool = True) -> DataFrame:
    """(source_ip, degree, triangles, clustering, centrality) of classes (source_ip, twins) of twins; not ``deep``: without the centrality."""
    nodes = checkpoint(placed.join(classes, "source_ip").select("source_ip", "id", "twins"))
    around = neighbours(placed, threshold, by_url, by_agent)
    bits = around.filter("bits is not null")
    # Nodes with the same neighbours, themselves included, are one: by XOR of 240 bits of SHA-256 of their rows.
    h = F.sha2(F.concat(F.col("other").cast("string").cast("binary"), F.lit("|").cast("binary"), F.col("bits")), 256)
    key = [f"h{k}" for k in range(4)]
    marks = bits.select("id", h.alias("h")).select("id", *(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("long").alias(f"h{k}") for k in range(4)))
    keyed = checkpoint(marks.groupBy("id").agg(*(F.bit_xor(c).alias(c) for c in key)))
    members = checkpoint(keyed.join(keyed.groupBy(*key).agg(F.min("id").alias("twin")), key).select("id", "twin"))
    merged = checkpoint(members.join(nodes, "id").groupBy(F.col("twin").alias("id")).agg(F.sum("twins").alias("twins")))
    links = around.filter("bits is null").join(members, "id").select(F.col("twin").alias("a"), "other").join(members.withColumnRenamed("id", "other"), "other")
    links = checkpoint(links.filter("a <> twin").select(F.col("a").alias("src"), F.col("twin").alias("dst")).distinct())
    roots = connected_components(merged.select(F.col("id").alias("node")), links).withColumnRenamed("node", "id")
    size = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    numbered = merged.join(roots.join(size, "root"), "id")
    tasks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SOURCES_PER_TASK))).alias("part")
    parts = bits.join(checkpoint(numbered), "id").select("root", "id", "twins", "other", "bits", tasks)

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at, of = np.unique(pdf["id"].to_numpy(), return_index=True, return_inverse=True)
        twins, n = pdf["twins"].to_numpy(float)[at], len(ids)
        matrix = _matrix(ids, of, pdf["other"].to_numpy(), pdf["bits"].tolist())
        del pdf
        mine = np.arange(n)[key[1] * SOURCES_PER_TASK : (key[1] + 1) * SOURCES_PER_TASK]
        total, *rest = paths(matrix, n, mine, twins, deep)
        out = pd.DataFrame({"id": ids, "d": total, "apart": 0, "near": 0, "linked": 0})
        for name, values in zip(("apart", "near", "linked"), rest):
            column = np.zeros(n, np.int64)
            column[mine] = np.rint(values)
            out[name] = column
        return out

    searched = parts.groupBy("root", "part").applyInPandas(sums, "id long, d double, apart long, near long, linked long")
    found = checkpoint(searched.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("d", "apart", "near", "linked"))))
    total = classes.agg(F.coalesce(F.sum("twins"), F.lit(0))).first()[0]
    out = merged.join(found, "id", "left").fillna(0, ["d", "apart", "near", "linked"])
    degree, triangles = F.col("near") + F.col("twins") - 1, F.expr("apart + linked + (twins - 1) * near + (twins - 1) * (twins - 2) div 2")
    out = out.select(F.col("id").alias("twin"), degree.alias("degree"), triangles.alias("triangles"), (F.col("d") / float(max(total - 1, 1) * max(total - 2, 1))).alias("centrality"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    out = out.withColumn("clustering", F.when(F.col("degree") >= 2, 2 * F.col("triangles") / pairs).otherwise(0.0))
    return members.join(nodes.select("id", "source_ip"), "id").join(out, "twin").select("source_ip", "degree", "triangles", "clustering", *(["centrality"] if deep else []))
