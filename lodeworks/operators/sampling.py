"""Reservoir samples and reports of the most frequent tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reservoir(events: DataFrame, size: int = 100, key: str = "event_id", seed: str = "666") -> DataFrame:
    """A uniform sample without replacement: the rows with the least seeded hashes. Samples of parts merge into that of the whole."""
    keyed = events.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    return keyed.orderBy("_order", key).limit(size).drop("_order")


def merged(sample: DataFrame, more: DataFrame, size: int = 100, key: str = "event_id", seed: str = "666") -> DataFrame:
    return reservoir(sample.unionByName(more), size, key, seed)


def tag_counts(sample: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n) over the tags of rows that have some."""
    return sample.where(F.size(tags) > 0).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tiers(counts: DataFrame, tiers: int = 3) -> DataFrame:
    """(tag, n, tier) of the tags in the highest frequency tiers, all ties included. The window is over distinct counts."""
    ranks = counts.select("n").distinct().orderBy(F.desc("n")).limit(tiers)
    ranks = ranks.withColumn("tier", F.dense_rank().over(Window.orderBy(F.desc("n"))).cast("long"))
    return counts.join(F.broadcast(ranks), "n").select("tag", "n", "tier")  # at most `tiers` rows
