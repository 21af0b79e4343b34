"""Result writers. Line formats are made in the plan, so that any number of rows can be written; order is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str) -> None:
    """One text column as lines of one file, in the order of the plan: for reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").text(path)


def json_document(answers: dict[str, DataFrame]) -> DataFrame:
    """One JSON document (column value) of named answers; each a DataFrame of few rows, as an array of its rows."""
    out = None
    for name, df in answers.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # single rows
    return out.select(F.to_json(F.struct(*answers)).alias("value"))


def in_order(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """df sorted by ranges over its part files, if an order is asked for."""
    return df.orderBy(*order) if order else df


def json_rows(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    in_order(df, order).write.mode("overwrite").json(path)


def csv_rows(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    in_order(df, order).write.mode("overwrite").csv(path, header=True)


def similar_pairs(pairs: DataFrame, path: str) -> None:
    """CSV of b1, b2, sim in that order, from pairs (a, b, sim)."""
    csv_rows(pairs.select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim"), path, ("b1", "b2"))


def quoted(items: Column) -> Column:
    """'a', 'b' of an array."""
    return F.concat(F.lit("'"), F.array_join(items, "', '"), F.lit("'"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """(size, value): a line for each size of (items), the sets in order, ('a', 'b'),('a', 'c')."""
    one = F.concat(F.lit("("), quoted(F.col("items")), F.lit(")"))
    rows = itemsets.select(F.size("items").alias("size"), F.struct("items", one.alias("s")).alias("r"))
    return rows.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["s"]), ",").alias("value")).orderBy("size")


def community_lines(communities: DataFrame) -> DataFrame:
    """(value): 'u1', 'u2' for each row of sorted (members), by size, then members."""
    return communities.orderBy(F.size("members"), "members").select(quoted(F.transform("members", lambda m: m.cast("string"))).alias("value"))


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """(value): ('u', 'v'),x for rows of (u, v, betweenness), greatest first."""
    u, v = (F.col(c).cast("string") for c in ("u", "v"))
    return edges.orderBy(F.desc("betweenness"), "u", "v").select(F.concat(F.lit("("), quoted(F.array(u, v)), F.lit("),"), F.col("betweenness").cast("string")).alias("value"))


def bit_line(bits: DataFrame) -> DataFrame:
    """(value): the 0/1 answers of (position, hit) in order of position, with spaces between."""
    return bits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("hit").cast("string").alias("h")))), lambda b: b["h"]), " ").alias("value"))


def point_labels(labels: DataFrame) -> DataFrame:
    """(value): one JSON object from point id to cluster."""
    return labels.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("point_id").cast("string"), F.col("cluster").cast("int")))))).alias("value"))


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files: for each batch of a stream."""
    df.write.mode("append").csv(path, header=True)


def tag_report(seen: int, tiers: DataFrame) -> DataFrame:
    """(value): how many events had tags so far, a line for each of (tag, n), most frequent first, and an empty line."""
    spark = tiers.sparkSession
    ends = spark.createDataFrame([(0, 0, "", f"The number of tweets with tags from the beginning: {seen}"), (2, 0, "", "")], "part int, _n long, tag string, value string")
    rows = tiers.select(F.lit(1).alias("part"), (-F.col("n")).alias("_n"), "tag", F.concat_ws(": ", "tag", F.col("n").cast("string")).alias("value"))
    return ends.unionByName(rows).orderBy("part", "_n", "tag").select("value")
