"""Counts, top lists, joined averages and partition reports over reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_if_small

#: Deleted from words after the stop-word test (fixed value).
PUNCTUATION = "!?(),.[]:;"


def total(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("n"))


def in_year(reviews: DataFrame, year: int = 2005) -> DataFrame:
    """Reviews of a year, as a range of ts that reaches the scan."""
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return reviews.where((F.col("ts") >= low) & (F.col("ts") < high)).agg(F.count("*").alias("n"))


def distinct_users(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_distinct("user_id").alias("n"))


def top_users(reviews: DataFrame, top_m: int = 5) -> DataFrame:
    """Users with the most reviews, ties by id."""
    return reviews.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(top_m)


def word_counts(texts: DataFrame, stop: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): split at single spaces, stop words dropped as they stand, then punctuation deleted and empty words dropped."""
    raw = texts.select(F.explode(F.split(F.lower(F.col(text)), " ")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    kept = raw.join(broadcast_if_small(stop.select(F.col("word").alias("raw"))), "raw", "left_anti")  # distinct words only
    # translate() rather than a regular expression: a set of single characters
    return kept.select(F.translate("raw", PUNCTUATION, "").alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(texts: DataFrame, stop: DataFrame, top_n: int = 10) -> DataFrame:
    return word_counts(texts, stop).orderBy(F.desc("n"), "word").limit(top_n)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def top_categories(reviews: DataFrame, business: DataFrame, top_n: int = 10) -> DataFrame:
    """(category, stars): mean stars over reviews; reviews are summed by business before the join."""
    sums = reviews.groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("n"))
    named = business.where("categories is not null and categories <> ''").select("business_id", "categories")
    each = sums.join(named, "business_id").select(F.explode(F.split("categories", ",")).alias("category"), "s", "n")
    each = each.select(trimmed(F.col("category")).alias("category"), "s", "n").where("category <> ''")
    mean = each.groupBy("category").agg((F.sum("s") / F.sum("n")).alias("stars"))
    return mean.orderBy(F.desc("stars"), "category").limit(top_n)


def heavy(reviews: DataFrame, key: str = "business_id", more_than: int = 10) -> DataFrame:
    return reviews.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def partition_report(df: DataFrame, parts: int, key: Column | None = None) -> DataFrame:
    """(part, n_items) of the partitions: those the frame has, or, by a key, key modulo parts; empty ones too."""
    spark = df.sparkSession
    n = df.rdd.getNumPartitions() if key is None else parts
    part = F.spark_partition_id() if key is None else F.pmod(key, F.lit(parts)).cast("int")
    counts = df.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n_items"))
    return spark.range(n).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left").select("part", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def of_businesses(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """(user_id, business_id) of the reviews of the given businesses, repeats kept."""
    return reviews.join(broadcast_if_small(business.select("business_id").distinct()), "business_id", "left_semi").select("user_id", "business_id")
