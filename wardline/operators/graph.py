"""The similarity graph of actors: edges, clustering coefficient, betweenness, coordination tags.

Actors with the same URLs and the same user agents are twins: they have the same edges, and edges with each other. So edges
and metrics are made between classes of twins, exactly, by weights; only the list of edges itself is written out for all.

Only actors that share a URL can be similar enough for an edge at a threshold of 0.3 or more (user agents alone weigh
0.3), so candidate pairs come from an equi-join on distinct (actor, URL) rows with counts; for smaller thresholds pairs
that share a user agent join them. Very popular URLs are split by AQE's skew join. Where that join would make more than
``DENSE`` rows, ``blocks`` does the same without any join of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.components import connected_components
from wardline.functions.trail import checkpoint, evidence, tag_with, written
from wardline.operators import blocks

SOURCE = "GraphDetector"
SIMILARITY, CENTRALITY, CLUSTERING = 0.3, 0.3, 0.5
URL_WEIGHT, AGENT_WEIGHT = 0.7, 0.3
#: Sources of shortest paths that one task takes, and how many numbers (edges by sources) it holds at once.
SOURCES_PER_TASK, NUMBERS = 256, 1 << 22
#: A component is a matrix of at most so many entries, if a share of 1 / SPARSE of them are edges; else a list of edges.
ENTRIES, SPARSE = 1 << 24, 64
#: Pairs of actors that share a URL, counted for each URL, beyond which the graph is made in blocks.
DENSE = 1 << 25


def _overlap(items: DataFrame) -> DataFrame:
    """(a, b, both) for pairs a < b of (source_ip, item)."""
    other = items.select(F.col("source_ip").alias("b"), "item")
    return items.withColumnRenamed("source_ip", "a").join(other, "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))


def _weight(urls, nu_a, nu_b, agents, na_a, na_b):
    by_url = F.col(urls) / (F.col(nu_a) + F.col(nu_b) - F.col(urls))
    by_agent = F.when((F.col(na_a) > 0) & (F.col(na_b) > 0), F.col(agents) / (F.col(na_a) + F.col(na_b) - F.col(agents))).otherwise(0.0)
    return URL_WEIGHT * by_url + AGENT_WEIGHT * by_agent


def _items(events: DataFrame) -> DataFrame:
    """Distinct (source_ip, of, item) of URLs (of 0) and of non-empty user agents (of 1), written once from one pass over the events."""
    each = F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("url").alias("item")), F.struct(F.lit(1).alias("of"), F.col("user_agent").alias("item"))))
    return written(events.select("source_ip", each.alias("x")).select("source_ip", "x.*").filter("of = 0 or item <> ''").distinct())


def _parted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_ip, item) of URLs and of user agents."""
    return tuple(items.filter(F.col("of") == k).select("source_ip", "item") for k in (0, 1))


def _signature(items: DataFrame, name: str) -> DataFrame:
    """(source_ip, n<name>, known<name>, <name>0..3): size of each source's set, without null, and sums of 240 bits of its items' SHA-256."""
    sums = [F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"{name}{k}") for k in range(4)]
    return items.select("source_ip", "item", F.sha2("item", 256).alias("h")).groupBy("source_ip").agg(F.count("*").alias(f"n{name}"), F.count("item").alias(f"known{name}"), *sums)


def twins(items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(source_ip, twin, own) of ``_items``: twin is the smallest source with the same sets of URLs and user agents, own the weight between twins.

    Sets that aren't similar to themselves (the threshold is high, or a URL is null) have no twins.
    """
    urls, agents = _parted(items)
    rows = _signature(urls, "u").join(_signature(agents, "a"), "source_ip", "left").fillna(0, ["na", "knowna"])
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != "source_ip"))
    rows = rows.withColumn("own", _weight("knownu", "nu", "nu", "knowna", "na", "na"))
    keyed = checkpoint(rows.select("source_ip", "own", F.when(F.col("own") > threshold, F.sha2(key, 256)).otherwise(F.col("source_ip")).alias("key")))
    return keyed.join(keyed.groupBy("key").agg(F.min("source_ip").alias("twin")), "key").select("source_ip", "twin", "own")


def _classes(events: DataFrame, threshold: float, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (source_ip, twin, own), classes (source_ip, twins) by their smallest member, and the classes' items."""
    if threshold < 0:
        raise ValueError("a negative threshold links all pairs")
    items = _items(events)
    items = items if nodes is None else items.join(nodes.select("source_ip"), "source_ip", "left_semi")
    members = checkpoint(twins(items, threshold))
    classes = checkpoint(members.groupBy(F.col("twin").alias("source_ip")).agg(F.count("*").alias("twins")))
    return members, classes, items.join(classes, "source_ip", "left_semi")


def twin_graph(events: DataFrame, threshold: float = SIMILARITY, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (source_ip, twin, own), classes (source_ip, twins) by their smallest member, and edges (src, dst, weight) between classes."""
    members, classes, items = _classes(events, threshold, nodes)
    return members, classes, checkpoint(_edges(*_parted(items), threshold))


def similarity_edges(events: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(src, dst, weight) with src < dst: 0.7 x Jaccard of URLs + 0.3 x Jaccard of non-empty user agents, above the threshold."""
    if threshold >= 0 and blocks.shared_pairs(items := _items(events)) > DENSE:
        return blocks.edges(blocks.place(items), threshold, URL_WEIGHT, AGENT_WEIGHT)
    members, _, edges = twin_graph(events, threshold)
    one, two = members.select(F.col("twin").alias("src"), F.col("source_ip").alias("a")), members.select(F.col("twin").alias("dst"), F.col("source_ip").alias("b"))
    between = edges.join(one, "src").join(two, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    within = members.join(two.withColumnRenamed("dst", "twin"), "twin").filter("source_ip < b").select(F.col("source_ip").alias("src"), F.col("b").alias("dst"), F.col("own").alias("weight"))
    return between.unionByName(within)


def _edges(urls: DataFrame, agents: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight) with src < dst of (source_ip, item) of URLs and of user agents."""
    size = lambda items, name: items.groupBy("source_ip").agg(F.count("*").alias(name))
    sizes = size(urls, "nu").join(size(agents, "na"), "source_ip", "left").fillna(0, ["na"])
    how = "left" if threshold >= AGENT_WEIGHT else "full"
    pairs = _overlap(urls).withColumnRenamed("both", "urls")
    if how == "left":  # agents only of the pairs that are there
        left = pairs.select("a", "b").join(agents.select(F.col("source_ip").alias("a"), "item"), "a")
        shared = left.join(agents.select(F.col("source_ip").alias("b"), "item"), ["b", "item"]).groupBy("a", "b").agg(F.count("*").alias("agents"))
    else:
        shared = _overlap(agents).withColumnRenamed("both", "agents")
    pairs = pairs.join(shared, ["a", "b"], how).fillna(0, ["urls", "agents"])
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("source_ip").alias(side), F.col("nu").alias(f"nu_{side}"), F.col("na").alias(f"na_{side}")), side)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), _weight("urls", "nu_a", "nu_b", "agents", "na_a", "na_b").alias("weight")).filter(F.col("weight") > threshold)


def _weighted(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their twins, themselves included: 1, unless they have it."""
    return nodes.select("source_ip", F.col("twins") if "twins" in nodes.columns else F.lit(1).cast("long").alias("twins"))


def alike(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (source_ip, twin) of nodes that are linked and have the same other neighbours, these as nodes (source_ip, twins), and the edges between them.

    Such nodes are each other's twins in the graph, whatever their sets are. Neighbourhoods are compared by 240 bits of their names' SHA-256.
    """
    nodes = _weighted(nodes)
    bits = [F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    names = checkpoint(nodes.select("source_ip", "twins", F.sha2("source_ip", 256).alias("h")).select("source_ip", "twins", *bits))
    around = edges.select(F.col("src").alias("of"), F.col("dst").alias("source_ip")).union(edges.select("dst", "src")).join(names.drop("twins"), "source_ip").drop("source_ip")
    marks = around.union(names.select(F.col("source_ip").alias("of"), *(f"h{k}" for k in range(4)))).groupBy("of").agg(*(F.bit_xor(f"h{k}").alias(f"h{k}") for k in range(4)))
    keyed = checkpoint(marks.withColumnRenamed("of", "source_ip"))
    key = [f"h{k}" for k in range(4)]
    members = checkpoint(keyed.join(keyed.groupBy(*key).agg(F.min("source_ip").alias("twin")), key).select("source_ip", "twin"))
    merged = checkpoint(members.join(names.select("source_ip", "twins"), "source_ip").groupBy(F.col("twin").alias("source_ip")).agg(F.sum("twins").alias("twins")))
    for side in ("src", "dst"):
        edges = edges.join(merged.select(F.col("source_ip").alias(side)), side, "left_semi")
    return members, merged, checkpoint(edges.select("src", "dst"))


def _paths(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray, twins: np.ndarray, deep: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sum over sources of the pair dependencies on each node (Brandes), and for each source the linked pairs of its neighbours.

    Works level by level for a block of sources at once; every node has an edge. A node stands for its twins, which are never on
    each other's shortest paths: a path has one of them, any. Pairs are of neighbours of different nodes; not ``deep``: only these.
    """
    if n * n <= min(ENTRIES, SPARSE * len(src)):
        matrix = np.zeros((n, n))
        matrix[dst, src] = 1
        over, step = lambda x: matrix @ x, max(1, NUMBERS // n)
    else:
        order = np.argsort(dst, kind="stable")
        src, starts = src[order], np.searchsorted(dst[order], np.arange(n))
        over, step = lambda x: np.add.reduceat(x[src], starts, axis=0), max(1, NUMBERS // len(src))
    weight, total, linked = twins[:, None].astype(float), np.zeros(n), np.zeros(len(sources))
    for at in range(0, len(sources), step):
        mine = sources[at : at + step]
        here = (mine, np.arange(len(mine)))
        distance, sigma, delta, reach = np.full((n, len(mine)), -1, np.int32), *(np.zeros((n, len(mine))) for _ in range(3))
        distance[here], sigma[here], reach[here] = 0, 1, 1
        level = 0
        while True:
            paths = over(reach)
            if level == 1:  # reach is the neighbours' weight, so paths counts the neighbours that each one is linked with
                linked[at : at + step] = (reach * paths).sum(axis=0) / 2
            fresh = (distance < 0) & (paths > 0)
            if not fresh.any() or (level == 1 and not deep):
                break
            level += 1
            distance[fresh], sigma[fresh] = level, paths[fresh]
            reach = np.where(fresh, paths * weight, 0.0)
        for k in range(level if deep else 0, 0, -1):
            share = np.divide(weight * (1 + delta), sigma, out=np.zeros_like(sigma), where=distance == k)
            delta = np.where(distance == k - 1, sigma * over(share), delta)
        delta[here] = 0
        total += delta @ twins[mine]
    return total, linked


def _searched(nodes: DataFrame, edges: DataFrame, deep: bool = True) -> DataFrame:
    """(source_ip, d, apart) of nodes with an edge: dependencies on them and linked pairs of neighbours that stand for different nodes.

    Shortest paths stay within a component, so each is worked on by itself; a large component's sources are dealt to several
    tasks, which all get its edges, as lists of numbers, and return sums.
    """
    linked = edges.select(F.col("src").alias("source_ip")).union(edges.select("dst")).distinct()
    nodes = nodes.join(linked, "source_ip")
    roots = connected_components(nodes.select(F.col("source_ip").alias("node")), edges).withColumnRenamed("node", "source_ip")
    numbered = checkpoint(nodes.join(roots, "source_ip").withColumn("id", F.row_number().over(Window.partitionBy("root").orderBy("source_ip")) - 1))
    ends = edges.join(numbered.select(F.col("source_ip").alias("src"), F.col("id").alias("a")), "src").join(numbered.select(F.col("source_ip").alias("dst"), F.col("id").alias("b")), "dst")
    rows = numbered.join(ends.groupBy(F.col("src").alias("source_ip")).agg(F.sort_array(F.collect_list("b")).alias("near")), "source_ip", "left")
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    parts = rows.join(size, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SOURCES_PER_TASK))))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        n, near = len(pdf), [np.empty(0, np.int32) if x is None else np.asarray(x, np.int32) for x in pdf["near"]]
        a, b = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in near]), np.concatenate(near)
        mine = np.arange(n)[key[1] * SOURCES_PER_TASK : (key[1] + 1) * SOURCES_PER_TASK]
        d, linked = _paths(n, np.concatenate([a, b]), np.concatenate([b, a]), mine, pdf["twins"].to_numpy(float), deep)
        apart = np.zeros(n, np.int64)
        apart[mine] = np.rint(linked)
        return pd.DataFrame({"source_ip": pdf["source_ip"], "d": d, "apart": apart})

    found = parts.select("root", "part", "id", "source_ip", "twins", "near").groupBy("root", "part").applyInPandas(sums, "source_ip string, d double, apart long")
    return found.groupBy("source_ip").agg(F.sum("d").alias("d"), F.sum("apart").alias("apart"))


def _clustering(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """(source_ip, degree, triangles, clustering) by what ``_searched`` found."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).join(nodes.select(F.col("source_ip").alias("dst"), "twins"), "dst")
    near = both.groupBy(F.col("src").alias("source_ip")).agg(F.sum("twins").alias("near"), F.sum(F.expr("twins * (twins - 1) div 2")).alias("linked"))
    out = nodes.join(near, "source_ip", "left").join(found.select("source_ip", "apart"), "source_ip", "left").fillna(0, ["near", "linked", "apart"])
    degree, triangles = F.col("near") + F.col("twins") - 1, F.expr("apart + linked + (twins - 1) * near + (twins - 1) * (twins - 2) div 2")
    out = out.select("source_ip", degree.alias("degree"), triangles.alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return out.withColumn("clustering", F.when(F.col("degree") >= 2, 2 * F.col("triangles") / pairs).otherwise(0.0))


def _centrality(nodes: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """(source_ip, centrality) by what ``_searched`` found among ``total`` actors; 0 for at most two of them."""
    score = found.select("source_ip", (F.col("d") / float(max(total - 1, 1) * max(total - 2, 1))).alias("centrality"))
    return nodes.select("source_ip").join(score, "source_ip", "left").fillna(0.0, ["centrality"])


def _total(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.sum("twins"), F.lit(0))).first()[0]


def clustering_coefficients(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_ip, degree, triangles, clustering): the share of a node's pairs of neighbours that are linked. Nodes may stand for ``twins``."""
    members, nodes, edges = alike(nodes, edges)
    return for_all(members, _clustering(nodes, edges, _searched(nodes, edges, deep=False)))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_ip, centrality): normalised betweenness of unweighted shortest paths, 0 for graphs of at most two nodes. Nodes may stand for ``twins``."""
    members, nodes, edges = alike(nodes, edges)
    return for_all(members, _centrality(nodes, _searched(nodes, edges), _total(nodes)))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_ip, degree, clustering, centrality), from one search."""
    members, nodes, edges = alike(nodes, edges)
    found = checkpoint(_searched(nodes, edges))
    return for_all(members, _clustering(nodes, edges, found).drop("triangles").join(_centrality(nodes, found, _total(nodes)), "source_ip"))


def metrics(events: DataFrame, threshold: float = SIMILARITY, nodes: DataFrame | None = None, wanted=None) -> DataFrame:
    """What ``wanted`` (``graph_metrics``, if none is given) says of each actor of the events."""
    wanted = wanted or graph_metrics
    members, classes, items = _classes(events, threshold, nodes)
    if blocks.shared_pairs(items) > DENSE:
        return for_all(members, blocks.metrics(blocks.place(items), classes, threshold, URL_WEIGHT, AGENT_WEIGHT, deep=wanted is not clustering_coefficients))
    return for_all(members, wanted(classes, checkpoint(_edges(*_parted(items), threshold))))


def for_all(members: DataFrame, found: DataFrame) -> DataFrame:
    """Metrics of classes given to each of their members."""
    return members.select("source_ip", "twin").join(found.withColumnRenamed("source_ip", "twin"), "twin").drop("twin")


def detect(actors: DataFrame, events: DataFrame, similarity: float = SIMILARITY, centrality: float = CENTRALITY, clustering: float = CLUSTERING) -> tuple[DataFrame, DataFrame | None]:
    """Tagged actors with their centrality, and the summary; fewer than two actors give no summary."""
    if actors.count() < 2:
        return actors, None
    found = metrics(events, similarity, actors).select("source_ip", F.col("clustering").alias("_clustering"), F.col("centrality").alias("_centrality"))
    rows = checkpoint(actors.join(found, "source_ip").withColumn("centrality", F.col("_centrality")).drop("_centrality"))
    leads = (F.col("centrality") > centrality) & (F.col("_clustering") < clustering)
    member = ~leads & (F.col("_clustering") > clustering)
    summary = rows.agg(F.count("*").alias("total_actors"), F.count_if(leads).alias("coordinators"), F.count_if(member).alias("cluster_members"), F.avg("centrality").alias("avg_centrality"))
    tagged = tag_with(rows, SOURCE, [
        (leads, "COORDINATOR", [evidence(SOURCE, "coordinator_detected", F.format_string("High centrality (%.3f), low clustering (%.3f)", "centrality", "_clustering"), 0.7)]),
        (member, "CLUSTER_MEMBER", [evidence(SOURCE, "cluster_member_detected", F.format_string("High clustering coefficient (%.3f)", "_clustering"), 0.6)]),
    ])
    return tagged.drop("_clustering"), summary
