"""Sketches: Bloom filter and Flajolet-Martin distinct counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_bits, string_mod, trailing_zeros
from ..storage import broadcast_if_small, materialize

#: Coefficients are drawn once and stated here, so that every run and the SQL share them: (a, b) of hash k by a fixed rule.
BLOOM_HASHES = [(7919 * (k + 1) ** 3 + 104729, 1299709 * (k + 3)) for k in range(7)]
FM_HASHES = [((k * 37 + 11) % 100 + 1, (k * 53 + 29) % 100 + 1) for k in range(45)]
BLOOM_BITS, FM_MODULUS, FM_GROUPS = 7000, 450, 9


def bloom_filter(values: DataFrame, column: str = "city", bits: int = BLOOM_BITS) -> DataFrame:
    """(bit): the set positions of the distinct values that are neither null nor empty."""
    named = values.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    return named.select(F.explode(bloom_bits(F.col(column), BLOOM_HASHES, bits)).alias("bit")).distinct()


def bloom_lookup(queries: DataFrame, filter_bits: DataFrame, column: str = "city", bits: int = BLOOM_BITS) -> DataFrame:
    """(column, hit) of distinct values: 1 if all positions are set, 0 for null and empty. The filter has at most `bits` rows."""
    q = queries.select(column).distinct()
    set_bits = filter_bits.limit(bits).agg(F.collect_set("bit").alias("_bits"))  # one row of at most `bits` numbers
    found = q.join(F.broadcast(set_bits)).select(column, F.forall(bloom_bits(F.col(column), BLOOM_HASHES, bits), lambda b: F.array_contains("_bits", b)).alias("all"))
    named = F.col(column).isNotNull() & (F.col(column) != "")
    return found.select(column, F.when(named & F.col("all"), 1).otherwise(0).alias("hit"))


def zeros(c: Column, modulus: int = FM_MODULUS) -> Column:
    """Trailing zeros of every hash of a string; null for null and empty."""
    x = string_mod(c, modulus)
    return F.when(x.isNotNull(), F.array(*[trailing_zeros((x * a + b) % modulus) for a, b in FM_HASHES]))


def estimate(r: Column) -> Column:
    """2^R of each hash, means of the groups, rounded half to even, and their median."""
    size = len(FM_HASHES) // FM_GROUPS
    mean = lambda g: F.bround(sum((F.pow(F.lit(2.0), F.coalesce(F.get(r, F.lit(g * size + k)), F.lit(-1))) for k in range(1, size)), F.pow(F.lit(2.0), F.coalesce(F.get(r, F.lit(g * size)), F.lit(-1)))) / size)
    return F.array_sort(F.array(*[mean(g) for g in range(FM_GROUPS)]))[FM_GROUPS // 2].cast("long")


MICROSECONDS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def microseconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * MICROSECONDS[unit.lower().removesuffix("s")]


def by_slice(events: DataFrame, window: str, slide: str) -> DataFrame:
    """Distinct (at, city) of (ts, city): at is the start of a slice of time that no window cuts, so that events are deduplicated before windows multiply them."""
    named = events.where("city is not null and city <> ''")
    span = f"{math.gcd(microseconds(window), microseconds(slide))} microseconds"
    return named.select(F.window("ts", span)["start"].alias("at"), "city").distinct()


def counts_of_slices(slices: DataFrame, window: str, slide: str) -> DataFrame:
    """(window_start, truth, estimate) of written (at, city); a city is hashed once, whatever its windows."""
    hashed = materialize(slices.select("city").distinct().withColumn("z", zeros(F.col("city"))), "hashed")
    cities = slices.select(F.window("at", window, slide).alias("w"), "city").distinct()
    each = cities.join(broadcast_if_small(hashed), "city").groupBy("w").agg(F.count("*").alias("truth"), *[F.max(F.get("z", F.lit(k))).alias(f"r{k}") for k in range(len(FM_HASHES))])
    return named_windows(each.select("w", "truth", F.array(*[f"r{k}" for k in range(len(FM_HASHES))]).alias("r")))


def named_windows(each: DataFrame) -> DataFrame:
    return each.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "truth", estimate(F.col("r")).alias("estimate"))


def windowed_counts(events: DataFrame, window: str = "30 seconds", slide: str = "10 seconds") -> DataFrame:
    """(window_start, truth, estimate) of (ts, city): exact and estimated distinct cities of each sliding window; batch or stream."""
    if not events.isStreaming:
        return counts_of_slices(materialize(by_slice(events, window, slide), "slices"), window, slide)
    # one stateful aggregation; its sets leave the state with their windows, and are hashed as they leave
    named = events.where("city is not null and city <> ''")
    each = named.groupBy(F.window("ts", window, slide).alias("w")).agg(F.collect_set("city").alias("cities"))
    lowest = F.array(*[F.lit(-1)] * len(FM_HASHES))
    r = F.aggregate(F.transform("cities", lambda c: zeros(c)), lowest, lambda most, z: F.zip_with(most, z, lambda x, y: F.greatest(x, y)))
    return named_windows(each.select("w", F.size("cities").cast("long").alias("truth"), r.alias("r")))
