"""The logical inputs of the operators, derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import read_table

STOP_WORDS = ["the", "of", "and", "a", "to", "in", "is", "it", "de", "la", "le", "der", "die", "und", "el", "los", "que"]


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, business_id, stars, ts, city): events as reviews; the number in props is the business."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", k.alias("business_id"), (F.floor("value") % 5 + 1).cast("long").alias("stars"), "ts", F.concat_ws("_", "event_type", k.cast("string")).alias("city"))


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, business_id, stars, ts): customers as users, parts as businesses."""
    o, i = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("business_id"), (F.col("l_quantity").cast("long") % 5 + 1).alias("stars"), F.col("o_orderdate").alias("ts"))


def part_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("business_id"), F.concat_ws(", ", "p_brand", "p_type", "p_name").alias("categories"))


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): orders and the brands in them."""
    i, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return i.join(p, i["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, user_id, text): sources as businesses, readers by language and id."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("business_id"), F.concat("lang", F.lit("-"), F.col("doc_id") % 3).alias("user_id"), "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def basket_threshold(n_baskets: int) -> int:
    """Four thousandths of the baskets, rounded up."""
    return max(1, -(-n_baskets * 4 // 1000))


#: The same as common table expressions.
EV = """ev AS (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS business_id, 1 + CAST(floor(value) AS BIGINT) % 5 AS stars, ts,
  event_type || '_' || regexp_extract(props, '([0-9]+)', 1) AS city FROM events)"""
ORV = """orv AS (SELECT o_custkey AS user_id, l_partkey AS business_id, 1 + CAST(l_quantity AS BIGINT) % 5 AS stars, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BUS = """bus AS (SELECT p_partkey AS business_id, concat_ws(', ', p_brand, p_type, p_name) AS categories FROM part)"""
BAS = """bas AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
thr AS (SELECT greatest(1, (count(DISTINCT basket) * 4 + 999) // 1000) AS t FROM bas)"""
TXT = """txt AS (SELECT source AS business_id, lang || '-' || CAST(doc_id % 3 AS VARCHAR) AS user_id, text FROM documents)"""
STOP = "stop AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]) AS word)"
