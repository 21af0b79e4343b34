"""Market baskets: frequent itemsets in two phases, level by level, and by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialize, shuffle_partitions


def baskets(pairs: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (basket, item), of baskets with more than so many items."""
    long = pairs.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).distinct()
    if not more_than:
        return long
    big = long.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("basket")
    return long.join(big, "basket", "left_semi")


def as_sets(long: DataFrame) -> DataFrame:
    return long.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def candidates(frequent: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(items) of size k+1 whose k-subsets are all among the frequent ones of size k: prefix join, then subset test."""
    by = by or []
    k = F.size("items")
    prefix = frequent.select(*by, F.slice("items", F.lit(1), k - 1).alias("prefix"), F.element_at("items", -1).alias("last"))
    left, right = prefix.withColumnRenamed("last", "a"), prefix.withColumnRenamed("last", "b")
    joined = left.join(right, [*by, "prefix"]).where("a < b").select(*by, F.concat("prefix", F.array("a", "b")).alias("items"))
    subsets = joined.select(*by, "items", F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("subset"))
    known = frequent.select(*by, F.col("items").alias("subset"))
    good = subsets.join(known, [*by, "subset"]).groupBy(*by, "items").agg(F.count("*").alias("n"))
    return good.where(F.col("n") == F.size("items")).select(*by, "items")


def packed(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, has, w): baskets as sorted arrays, equal ones as one row with their number; of (basket, item) with or without repeats, or of what is packed already."""
    if "has" in long.columns:
        return long.groupBy(*by, "has").agg(F.sum("w").alias("w"))
    dealt = long.select(*by, "basket", "item").repartition("basket")  # a basket's items meet at once, without counts before
    arrays = dealt.groupBy(*by, "basket").agg(F.array_sort(F.collect_set("item")).alias("has"))
    return arrays.groupBy(*by, "has").agg(F.count("*").alias("w"))


def restricted(rows: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Packed baskets (by, has, w) with those of their items that are among (by, item)."""
    rows = materialize(rows.select(*by, "has", "w", F.monotonically_increasing_id().alias("_row")), "baskets")
    each = rows.select(*by, "_row", "w", F.explode("has").alias("item")).join(items, [*by, "item"], "left_semi")
    return packed(each.groupBy(*by, "_row", "w").agg(F.array_sort(F.collect_list("item")).alias("has")), by)


def steps(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, prefix, next) of sets of two and more items: how a basket gets from one level of the sets' trie to the next."""
    return sets.select(*by, F.slice("items", F.lit(1), F.size("items") - 1).alias("prefix"), F.element_at("items", -1).alias("next")).distinct()


def occurrences(rows: DataFrame, levels: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, has, w, prefix): the baskets' paths through the steps of the levels; nothing but counts of them is ever kept."""
    out = rows.select(*by, "has", "w", F.explode("has").alias("_item")).select(*by, "has", "w", F.array("_item").alias("prefix"))
    for level in levels:
        out = out.join(level, [*by, "prefix"]).where(F.array_contains("has", F.col("next")))
        out = out.select(*by, "has", "w", F.concat("prefix", F.array("next")).alias("prefix"))
    return out


def mine(long: DataFrame, threshold, max_size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(items, n) with n >= threshold, all sizes up to max_size; within each group of the columns by, if given. Of long or packed baskets, as all below.

    Baskets are arrays of their frequent items, equal ones counted once. A level follows the frequent
    prefixes inside each basket to the candidates of that level and sums map-side: occurrences of sets
    are neither written nor shuffled while the levels are small enough to be broadcast.
    """
    by = by or []
    whole = materialize(packed(long, by), "packed")
    each = whole.select(*by, F.explode("has").alias("item"), "w")
    counts = each.groupBy(*by, "item").agg(F.sum("w").alias("n")).where(F.col("n") >= threshold)
    levels = [materialize(counts.select(*by, F.array("item").alias("items"), "n"), "itemsets")]
    frequent = levels[0].select(*by, F.get("items", F.lit(0)).alias("item"))
    rows = restricted(whole, broadcast_if_small(frequent), by).where(F.size("has") > 1)
    rows, path = materialize(rows, "baskets"), []
    while max_size is None or len(levels) < max_size:
        wanted = materialize(candidates(levels[-1].select(*by, "items"), by), "candidates")
        here = occurrences(rows, [*path, broadcast_if_small(steps(wanted, by))], by)
        found = here.groupBy(*by, F.col("prefix").alias("items")).agg(F.sum("w").alias("n")).where(F.col("n") >= threshold)
        found = materialize(found, "itemsets")
        if not found.limit(1).count():
            break
        levels.append(found)
        path.append(broadcast_if_small(steps(found, by)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def in_parts(long: DataFrame, parts: int) -> DataFrame:
    return long.withColumn("part", F.pmod("basket", F.lit(parts)).cast("int"))


def local_candidates(long: DataFrame, threshold: float, parts: int, max_size: int | None = None) -> DataFrame:
    """Phase 1: sets that are frequent in some part of the baskets, at the threshold scaled to the part."""
    dealt = long if "part" in long.columns else in_parts(long, parts)
    return mine(dealt, threshold / parts, max_size, ["part"]).select("items").distinct()


def support(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """(items, n): baskets that contain each wanted set, counted along the trie of the wanted sets inside each basket."""
    sets = wanted.select(F.array_sort(F.array_distinct("items")).alias("items"), F.col("items").alias("_as")).distinct()
    needed = broadcast_if_small(sets.select(F.explode("items").alias("item")).distinct())
    rows = materialize(restricted(packed(long, []), needed, []), "baskets")
    longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    hits, path = None, []
    for k in range(1, longest + 1):
        if k > 1:
            path.append(broadcast_if_small(steps(sets.where(F.size("items") >= k).select(F.slice("items", F.lit(1), F.lit(k)).alias("items")), [])))
        here = broadcast_if_small(sets.where(F.size("items") == k).select(F.col("items").alias("prefix"), "_as"))
        level = occurrences(rows, path, []).join(here, "prefix").groupBy("_as").agg(F.sum("w").alias("n"))
        hits = level if hits is None else hits.unionByName(level)
    if hits is None:
        return wanted.select("items", F.lit(0).cast("long").alias("n"))
    return wanted.join(hits.withColumnRenamed("_as", "items"), "items", "left").select("items", F.coalesce("n", F.lit(0)).alias("n"))


def two_phase(long: DataFrame, threshold: int, parts: int, max_size: int | None = None) -> DataFrame:
    """Phase 2 over phase 1: (items, n) of the candidates with n >= threshold."""
    wanted = materialize(local_candidates(long, threshold, parts, max_size), "candidates")
    return support(long, wanted).where(F.col("n") >= threshold)


def copies(rows: DataFrame) -> DataFrame:
    """(items): packed baskets as often as they are there; made as they are read, so many at a time."""
    most = 10_000
    some = rows.select("has", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / most))).alias("k"))
    return some.select("has", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("w") - F.col("k") * most))).alias("_")).select(F.col("has").alias("items"))


def fp_growth(long: DataFrame, threshold: int, partitions: int = 10) -> DataFrame:
    """(items, n) by FP-growth; the support is half a basket below the threshold, so that rounding loses no set at it."""
    rows = materialize(packed(long, []), "packed")
    n = rows.agg(F.sum("w")).first()[0]
    sets = copies(rows.repartition(shuffle_partitions(rows.sparkSession)))  # the passes of the fit read packed rows only
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (threshold - 0.5) / max(n or 0, 1))), numPartitions=partitions).fit(sets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Three rows: sets of the one, of the other, of both."""
    both = a.select("items").intersect(b.select("items"))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("two_phase", a), ("fp_growth", b), ("intersection", both))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
