"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of undirected edges (a, b), longs: component is the smallest node reachable.

    Rounds of minimum labels with pointer jumping: every node takes the least label among itself and
    its neighbours, then the label of its label; nodes merged into a star drop out as their edges
    contract. Hubs cost no more than a partial minimum, and each round is a written table. Only the
    number of changed labels comes to the driver.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # left: every node points to a smaller one or itself; edges are rewritten between the roots they lead to
    live = materialize(both, name)
    parents = None
    while live.limit(1).count():
        down = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        step = materialize(jump(down, name), name)  # node -> root of its star, for nodes that have a smaller neighbour
        parents = step if parents is None else compose(parents, step)
        parents = materialize(parents, name)
        a = step.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        left = live.join(a, "a", "left").join(b, "b", "left")
        left = left.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        live = materialize(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    if parents is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = parents.select(F.col("up").alias("node")).distinct().withColumn("component", F.col("node"))
    return parents.select("node", F.col("up").alias("component")).unionByName(roots)


def jump(down: DataFrame, name: str) -> DataFrame:
    """(node, up) with up < node, followed until up is a root; path lengths halve each round."""
    now = materialize(down, name)
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        nxt = materialize(now.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), name)
        if not nxt.where("moved").limit(1).count():
            return now
        now = nxt.drop("moved")


def compose(parents: DataFrame, step: DataFrame) -> DataFrame:
    """parents followed by step: nodes keep their entry, roots that step moved get one."""
    s = step.select(F.col("node").alias("up"), F.col("up").alias("upper"))
    moved = parents.join(s, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
    return moved.unionByName(step.join(parents.select("node"), "node", "left_anti").select("node", "up"))
