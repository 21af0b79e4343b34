"""BFR clustering: K-means on the first points, then chunks against summaries (count, sum, sum of squares).

Points stay in DataFrames; only summaries, at most a few times k rows of d numbers, are on the driver.
Order-dependent choices are fixed: first centroids are the points of the least seeded hashes, merges go in
order of cluster keys, and a compressed cluster joins the nearest discard cluster in reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, new_path, track

ALPHA, CLUSTERS, SEED = 3.0, 10, 666
#: Least standard deviation, so that a dimension without spread divides by no zero.
LEAST_STD = 1e-9


@dataclass
class Summary:
    n: int
    total: list[float]
    squares: list[float]

    def centre(self) -> list[float]:
        return [x / self.n for x in self.total]

    def std(self) -> list[float]:
        return [max(LEAST_STD, math.sqrt(max(0.0, q / self.n - (s / self.n) ** 2))) for s, q in zip(self.total, self.squares, strict=True)]

    def plus(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, [a + b for a, b in zip(self.total, other.total, strict=True)], [a + b for a, b in zip(self.squares, other.squares, strict=True)])


def numbers(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def distance(a: Column, b: Column, std: Column | None = None) -> Column:
    """Euclidean, or by standard deviations, distance of two arrays."""
    square = (lambda x, y: (x - y) * (x - y)) if std is None else None
    if std is None:
        parts = F.zip_with(a, b, square)
    else:
        parts = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), std, lambda d, s: (d / s) * (d / s))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def nearest(features: Column, centres: dict[str, tuple[list[float], list[float] | None]]) -> Column:
    """Struct (d, key) of the nearest centre, ties to the least key; centres with standard deviations are measured by them."""
    each = [F.struct(distance(features, numbers(c), None if s is None else numbers(s)).alias("d"), F.lit(k).alias("key")) for k, (c, s) in sorted(centres.items())]
    return F.array_min(F.array(*each))


def summaries(assigned: DataFrame) -> dict[str, Summary]:
    """Count, sums and sums of squares of each cluster of (cluster, features): a row for each cluster and dimension."""
    long = assigned.select("cluster", F.posexplode("features").alias("i", "x")).groupBy("cluster", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    rows = long.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("v"))
    return {r["cluster"]: Summary(r["n"], [x["s"] for x in r["v"]], [x["q"] for x in r["v"]]) for r in rows.collect()}


def first_centres(points: DataFrame, k: int, seed: int = SEED) -> dict[str, tuple[list[float], None]]:
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("point_id").cast("string")))
    rows = points.select("features", "point_id", order.alias("o")).orderBy("o", "point_id").limit(k).collect()
    return {f"{i:04d}": (list(r["features"]), None) for i, r in enumerate(rows)}


def assign(points: DataFrame, centres: dict) -> DataFrame:
    return points.withColumn("_near", nearest(F.col("features"), centres)).select("point_id", "features", F.col("_near.key").alias("cluster"))


def kmeans(points: DataFrame, k: int = CLUSTERS, max_iter: int = 5, tol: float = 1e-4, seed: int = SEED) -> tuple[DataFrame, dict[str, Summary]]:
    """((point_id, features, cluster), summaries) after at most max_iter rounds; k shrinks to the number of points."""
    centres = first_centres(points, k, seed)
    if not centres:
        return points.withColumn("cluster", F.lit(None).cast("string")), {}
    for _ in range(max_iter):
        found = summaries(assign(points, centres))
        moved = max(math.dist(found[key].centre(), centres[key][0]) for key in found)
        centres = {key: (found[key].centre() if key in found else centres[key][0], None) for key in centres}
        if moved < tol:
            break
    out = materialize(assign(points, centres), "clusters")
    return out, summaries(out)


@dataclass
class State:
    discard: dict[str, Summary] = field(default_factory=dict)
    compressed: dict[str, Summary] = field(default_factory=dict)
    retained: DataFrame | None = None
    #: Folder of (point_id, cluster), the points of the discard clusters, a part for each round: a round that is run again writes the same.
    placed: str | None = None
    rounds: list[tuple] = field(default_factory=list)

    def place(self, points: DataFrame, number: int) -> None:
        self.placed = self.placed or track(new_path(points.sparkSession, "placed"))
        points.select("point_id", "cluster").write.mode("overwrite").parquet(f"{self.placed}/round={number}")

    def counts(self, number: int) -> tuple:
        points = [sum(s.n for s in sets.values()) for sets in (self.discard, self.compressed)]
        return number, len(self.discard), points[0], len(self.compressed), points[1], self.retained.count()


def reach(summary: Summary, centre: list[float]) -> tuple[float, bool]:
    """Distance of a point by a summary's standard deviations, and whether it is below alpha * sqrt(d)."""
    d = math.sqrt(sum(((x - c) / s) ** 2 for x, c, s in zip(centre, summary.centre(), summary.std(), strict=True)))
    return d, d < ALPHA * math.sqrt(len(centre))


def absorbed(points: DataFrame, sets: dict[str, Summary]) -> tuple[DataFrame, DataFrame]:
    """(points within reach of their nearest cluster, with cluster; the rest)."""
    if not sets:
        return points.limit(0).withColumn("cluster", F.lit("")), points
    near = points.withColumn("_near", nearest(F.col("features"), {k: (s.centre(), s.std()) for k, s in sets.items()}))
    near = materialize(near, "absorbed")
    within = F.col("_near.d") < ALPHA * F.sqrt(F.size("features").cast("double"))
    return near.where(within).select("point_id", "features", F.col("_near.key").alias("cluster")), near.where(~F.coalesce(within, F.lit(False))).select("point_id", "features")


def added(sets: dict[str, Summary], more: dict[str, Summary]) -> None:
    for key, s in more.items():
        sets[key] = sets[key].plus(s) if key in sets else s


def separate(assigned: DataFrame, sums: dict[str, Summary]) -> tuple[DataFrame, DataFrame, dict[str, Summary]]:
    """(points of clusters of two and more, points that are alone, summaries of the former)."""
    alone = [k for k, s in sums.items() if s.n <= 1]
    single = F.col("cluster").isin(alone) if alone else F.lit(False)
    return assigned.where(~single), assigned.where(single).select("point_id", "features"), {k: s for k, s in sums.items() if s.n > 1}


def merge_compressed(sets: dict[str, Summary]) -> dict[str, Summary]:
    """Clusters closer than alpha * sqrt(d), by the first's deviations, become one, in order of their keys."""
    out: dict[str, Summary] = {}
    for key in sorted(sets):
        for other in sorted(out):
            if reach(out[other], sets[key].centre())[1]:
                out[other] = out[other].plus(sets[key])
                break
        else:
            out[key] = sets[key]
    return out


def step(state: State, chunk: DataFrame, k: int = CLUSTERS, first_points: int = 10_000) -> State:
    """state after one more chunk of (point_id, features): the first opens the sets, the others are absorbed."""
    number = len(state.rounds)
    chunk = materialize(chunk.select("point_id", "features"), "chunk")
    if not number:
        n = chunk.count()
        head = materialize(chunk.orderBy("point_id").limit(first_points if n > first_points else -(-n // 10)), "head")
        rest = chunk.join(head.select("point_id"), "point_id", "left_anti")
        placed, sums = kmeans(head, k)
        state.discard = {f"D{int(key):04d}": s for key, s in sums.items()}
        state.place(placed.select("point_id", F.concat(F.lit("D"), "cluster").alias("cluster")), number)
        groups, sums = kmeans(rest, 3 * k, 3)
        _, alone, sums = separate(groups, sums)
        state.compressed = {f"R0C{key}": s for key, s in sums.items()}
        state.retained = materialize(alone, "retained")
    else:
        near, rest = absorbed(chunk, state.discard)
        added(state.discard, summaries(near))
        state.place(near, number)
        near, rest = absorbed(rest, state.compressed)
        added(state.compressed, summaries(near))
        state.retained = materialize(state.retained.unionByName(rest), "retained")
        groups, sums = kmeans(state.retained, 3 * k, 5)
        _, alone, sums = separate(groups, sums)
        added(state.compressed, {f"R{number}C{key}": s for key, s in sums.items()})
        state.retained = materialize(alone, "retained")
        state.compressed = merge_compressed(state.compressed)
    state.rounds.append(state.counts(number))
    return state


def finish(state: State) -> State:
    """state after its last chunk: compressed clusters in reach of a discard one join the nearest."""
    for key in sorted(state.compressed):
        centre = state.compressed[key].centre()
        close = sorted((reach(s, centre)[0], d) for d, s in state.discard.items() if reach(s, centre)[1])
        if close:
            state.discard[close[0][1]] = state.discard[close[0][1]].plus(state.compressed.pop(key))
    if state.rounds:
        state.rounds[-1] = state.counts(len(state.rounds) - 1)
    return state


def bfr(chunks: Iterable[DataFrame], k: int = CLUSTERS, first_points: int = 10_000) -> State:
    """The state after all chunks of (point_id, features), one at a time."""
    state = State()
    for chunk in chunks:
        step(state, chunk, k, first_points)
    return finish(state)


def round_report(spark, state: State) -> DataFrame:
    return spark.createDataFrame(state.rounds, "round_id int, nof_cluster_discard long, nof_point_discard long, nof_cluster_compression long, nof_point_compression long, nof_point_retained long")


def labels(points: DataFrame, state: State) -> DataFrame:
    """(point_id, cluster): number of the discard cluster, -1 for all others."""
    if state.placed is None:
        return points.select("point_id", F.lit(-1).alias("cluster"))
    kind = points.schema["point_id"].dataType.simpleString()
    found = points.sparkSession.read.schema(f"point_id {kind}, cluster string, round int").parquet(state.placed)
    number = F.substring("cluster", 2, 10).cast("int")
    return points.select("point_id").join(found.select("point_id", number.alias("cluster")), "point_id", "left").select("point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
