"""Graphs of users who share businesses: edges, labels, components, betweenness, modularity, Girvan-Newman."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, global_row_number, materialize
from .components import components

#: Edges up to which a graph counts as small: its adjacency may go to each task, or its splitting to the driver.
SMALL_EDGES = 200_000
SPLIT_EDGES = 5_000
EXACT = 9
#: Groups of businesses of which a pair of users must share two in one.
PAIR_GROUPS = 6


def shared_edges(pairs: DataFrame, user: str, business: str, least: int = 7) -> DataFrame:
    """(a, b), a < b, of users with at least so many businesses in common; users without an edge are not in the graph.

    Businesses are numbered rare before frequent and dealt into groups by their number, one group less
    than a pair must share: two such users then share two of one group, and with all but the most
    frequent of the groups also two of their first n - least + groups + 1. A business is joined with
    what follows it in its user's group, and only pairs that share of that too leave the join: the
    pairs that a single business makes are never written, shuffled or counted.
    """
    members = pairs.select(F.col(user).alias("id"), F.col(business).alias("idx")).where("id is not null and idx is not null").distinct()
    members = materialize(members, "members")
    frequency = materialize(members.groupBy("idx").agg(F.count("*").alias("df")), "frequency")
    ranks, n = global_row_number(frequency, ["df", "idx"], "ranks")
    ranks = ranks.select("idx", F.col("_lw_row").cast("int" if n < 1 << 31 else "long").alias("r"))
    ordered = members.join(broadcast_if_small(ranks), "idx").groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("items"))
    ordered = materialize(ordered.where(F.size("items") >= least), "ordered")
    groups = min(least - 1, PAIR_GROUPS)
    first = F.slice("items", F.lit(1), F.size("items") - (least - 1 - groups))
    if groups:
        group = lambda g: F.filter(first, lambda r: r % groups == g)
        dealt = ordered.select("id", F.explode(F.array(*[group(g) for g in range(groups)])).alias("g"))
        rows = dealt.where("size(g) > 1").select("id", "g", F.posexplode("g").alias("at", "r")).where("at + 1 < size(g)")
        rows = rows.select("id", "r", F.slice("g", F.col("at") + 2, F.size("g")).alias("rest"))
    else:
        rows = ordered.select("id", F.explode(first).alias("r"), F.array().cast("array<int>").alias("rest"))
    left, right = (rows.select("r", F.col("id").alias(x), F.col("rest").alias(f"rest_{x}")) for x in ("a", "b"))
    found = left.hint("merge").join(right, "r").where("a < b")  # an exploded side is larger than its files tell
    found = materialize((found.where(F.arrays_overlap("rest_a", "rest_b")) if groups else found).select("a", "b").distinct(), "candidates")
    whole = lambda x: ordered.select(F.col("id").alias(x), F.col("items").alias(f"of_{x}"))
    both = broadcast_if_small(found).join(whole("a"), "a").join(whole("b"), "b")
    return both.where(F.size(F.array_intersect("of_a", "of_b")) >= least).select("a", "b")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): every round each node takes its neighbours' most frequent label, ties to the least."""
    arcs = materialize(both_ways(edges), "arcs")
    labels = arcs.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = arcs.join(labels, arcs["src"] == labels["node"]).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        labels = materialize(best.select(F.col("dst").alias("node"), "label"), "labels")
    return labels


def listed(labels: DataFrame, label: str = "label") -> DataFrame:
    """(members): each community's nodes in order; communities by size, then members."""
    rows = labels.groupBy(label).agg(F.array_sort(F.collect_list("node")).alias("members"))
    return rows.select("members").orderBy(F.size("members"), "members")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge."""
    return components(edges)


def credits_of(root, neighbours: dict) -> Iterator[tuple]:
    """((u, v), credit) of the edges on shortest paths from root: paths counted down, credit shared back up."""
    level, paths, parents, order, queue = {root: 0}, {root: 1}, {root: []}, [], deque([root])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in neighbours[v]:
            if w not in level:
                level[w], paths[w], parents[w] = level[v] + 1, 0, []
                queue.append(w)
            if level[w] == level[v] + 1:
                paths[w] += paths[v]
                parents[w].append(v)
    credit = dict.fromkeys(order, 1.0)
    for w in reversed(order):
        for v in parents[w]:
            share = credit[w] * paths[v] / paths[w]
            credit[v] += share
            yield (min(v, w), max(v, w)), share


def betweenness(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(u, v, betweenness) of (a, b) edges, half the credit over all roots.

    Roots are dealt out; a graph of few edges, after a count, goes to each task, and a task returns one
    sum for each edge. Larger graphs are searched by joins, one level at a time for all roots.
    """
    if edges.limit(small + 1).count() > small:
        return betweenness_by_joins(edges)
    rows = edges.select("a", "b").collect()  # at most `small`
    spark = edges.sparkSession
    adjacency: dict = {}
    for r in rows:
        adjacency.setdefault(r["a"], []).append(r["b"])
        adjacency.setdefault(r["b"], []).append(r["a"])
    shared = spark.sparkContext.broadcast(adjacency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for frame in frames:
            for root in frame["node"]:
                for edge, c in credits_of(root, shared.value):
                    total[edge] = total.get(edge, 0.0) + c
        yield pd.DataFrame([(u, v, c) for (u, v), c in total.items()], columns=["u", "v", "c"]).astype({"u": "int64", "v": "int64", "c": "float64"})

    roots = both_ways(edges).select(F.col("src").alias("node")).distinct()
    return roots.mapInPandas(run, "u long, v long, c double").groupBy("u", "v").agg(F.round(F.sum("c") / 2, EXACT).alias("betweenness"))


def betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """The same by DataFrame operations only: (root, node, level, paths) level by level, then credit from the last level up."""
    arcs = materialize(both_ways(edges), "arcs")
    seen = arcs.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(1.0).alias("paths"))
    levels = [materialize(seen, "level")]
    visited = levels[0].select("root", "node")
    while True:
        step = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("root", "dst").agg(F.sum("paths").alias("paths"))
        step = materialize(step.withColumnRenamed("dst", "node").join(visited, ["root", "node"], "left_anti").select("root", "node", "paths"), "level")
        if not step.limit(1).count():
            break
        levels.append(step)
        visited = visited.unionByName(step.select("root", "node"))
    credit, out = None, None
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        low = lower.withColumn("credit", F.lit(1.0)) if credit is None else lower.join(credit, ["root", "node"], "left").withColumn("credit", 1.0 + F.coalesce("credit", F.lit(0.0)))
        low = low.select("root", F.col("node").alias("w"), F.col("paths").alias("pw"), "credit")
        shares = upper.join(arcs, F.col("node") == F.col("src")).withColumnRenamed("dst", "w").join(low, ["root", "w"])
        shares = materialize(shares.select("root", "node", "w", (F.col("credit") * F.col("paths") / F.col("pw")).alias("share")), "credits")
        credit = shares.groupBy("root", "node").agg(F.sum("share").alias("credit"))
        part = shares.select(F.least("node", "w").alias("u"), F.greatest("node", "w").alias("v"), "share")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("u", "v").agg(F.round(F.sum("share") / 2, EXACT).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: sum over communities of inner edges / m - (degrees / 2m)^2."""
    named = labels.select("node", F.col(label).alias("c"))
    ends = edges.join(named.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("inner"))
    degrees = ends.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    both = degrees.join(inner, "c", "left").agg(F.sum(F.coalesce("inner", F.lit(0))).alias("i"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"), F.sum("k").alias("k"))
    return both.select(F.round(F.col("i") * 2 / F.col("k") - F.col("kk") / (F.col("k").cast("double") * F.col("k")), EXACT).alias("modularity"))


def split_small(edges: list[tuple]) -> tuple[list[list], float]:
    """Girvan-Newman of a small graph: the communities of the first split with the greatest modularity, and that."""
    neighbours: dict = {}
    for a, b in edges:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    degree, m = {v: len(n) for v, n in neighbours.items()}, len(edges)
    best, best_q = [], -1.0
    original = set(map(tuple, edges))
    left = set(original)
    while left:
        seen, parts = set(), []
        for v in sorted(neighbours):
            if v not in seen:
                part, queue = {v}, [v]
                while queue:
                    for w in neighbours[queue.pop()] - part:
                        part.add(w)
                        queue.append(w)
                seen |= part
                parts.append(part)
        where = {v: k for k, part in enumerate(parts) for v in part}
        q = sum(where[a] == where[b] for a, b in original) / m - sum((sum(degree[v] for v in p) / (2 * m)) ** 2 for p in parts)
        if round(q, EXACT) > round(best_q, EXACT):
            best, best_q = [sorted(p) for p in parts], q
        total: dict = {}
        for root in neighbours:
            for e, c in credits_of(root, neighbours):
                total[e] = total.get(e, 0.0) + c
        most = max(round(c, EXACT) for c in total.values())
        for a, b in [e for e, c in total.items() if round(c, EXACT) == most]:
            left.discard((a, b))
            neighbours[a].discard(b)
            neighbours[b].discard(a)
    return best, best_q


def girvan_newman(edges: DataFrame, small: int = SPLIT_EDGES) -> DataFrame:
    """(members) of the best split: all edges of the greatest betweenness go, again and again; small graphs on the driver, others by joins."""
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    if edges.limit(small + 1).count() <= small:
        parts, _ = split_small(sorted((r["a"], r["b"]) for r in edges.collect()))
        return spark.createDataFrame([(p,) for p in parts], f"members array<{kind}>").orderBy(F.size("members"), "members")
    left, best, best_q = materialize(edges, "graph"), None, -1.0
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    while left.limit(1).count():
        label = nodes.join(components(left), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
        label = materialize(label, "split")
        q = modularity(edges, label).first()["modularity"]
        if q > best_q:
            best, best_q = label, q
        by_edge = materialize(betweenness(left), "betweenness")
        most = by_edge.agg(F.max("betweenness")).first()[0]
        gone = by_edge.where(F.col("betweenness") == most).select(F.col("u").alias("a"), F.col("v").alias("b"))
        left = materialize(left.join(gone, ["a", "b"], "left_anti"), "graph")
    return listed(best)
