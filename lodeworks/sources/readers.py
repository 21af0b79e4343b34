"""Typed readers of files, folders of chunks, literals and streams. Rows that do not parse give nulls, never an error."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews with ts, the parsed date."""
    return json_lines(spark, path, schemas.REVIEW).withColumn("ts", F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.BUSINESS)


def pairs_csv(spark: SparkSession, path: str, schema: str = schemas.USER_BUSINESS) -> DataFrame:
    """The columns of a CSV file with a header."""
    return spark.read.csv(path, header=True, schema=schema)


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, features) of id,f1,...,fd lines without header."""
    cells = F.split("value", ",")
    features = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return spark.read.text(path).select(F.get(cells, F.lit(0)).try_cast("long").alias("point_id"), features.alias("features"))


def point_chunks(spark: SparkSession, paths: str | list[str]) -> Iterator[DataFrame]:
    """The chunk files of a list or a folder one after the other, by name."""
    if isinstance(paths, str):
        paths = [r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect()]  # names only
    for path in sorted(paths):
        yield points_csv(spark, path)


def itemsets(spark: SparkSession, path: str) -> DataFrame:
    """Each line's comma-joined items as a sorted set."""
    return spark.read.text(path).select(F.array_sort(F.array_distinct(F.split("value", ","))).alias("items"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with one word a line, white space around it removed."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word")).distinct()


def single_number(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).limit(1).select(F.col("value").try_cast("long").alias("value"))


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def content_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(business profiles, user profiles) of one file with both kinds."""
    rows = json_lines(spark, path, schemas.CONTENT_MODEL)
    return rows.where("business_id is not null").drop("user_id"), rows.where("user_id is not null").drop("business_id")


def socket_cities(spark: SparkSession, host: str, port: int) -> DataFrame:
    """(ts, city) of JSON lines that arrive on a socket, stamped on arrival."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.current_timestamp().alias("ts"), F.from_json("value", schemas.CITY)["city"].alias("city"))


def file_stream(spark: SparkSession, path: str, schema, files_each: int = 1, kind: str = "parquet") -> DataFrame:
    """New files of a folder, so many a trigger, in order of time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(path)


def tracked(stream: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    """Rows that mention one of the words, in any case: the filter of a push source with tracked keywords."""
    text = F.lower(F.col(column))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w.lower()))
    return stream.where(hit)
