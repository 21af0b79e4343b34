"""Set similarity: dense indices, MinHash signatures, bands, candidate pairs and exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import global_row_number

# The multipliers of the signature functions min((p * row + 1) mod rows).
MULTIPLIERS = [
    1, 3, 9, 11, 13, 17, 19, 27, 29, 31, 33, 37, 39, 41, 43, 47, 51, 53, 57, 59, 61, 67, 71, 73, 79, 83,
    89, 97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167, 173, 179, 181, 191, 193, 197, 199, 211, 223, 227,
]


def dense_index(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(column, idx) of the distinct values in their order, from 0, and how many there are; numbered by ranges, not in one task."""
    numbered, n = global_row_number(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "dense-index")
    return numbered.withColumnRenamed("_lw_row", "idx"), n


def signatures(members: DataFrame, rows: int, multipliers: list[int] = MULTIPLIERS) -> DataFrame:
    """(id, sig) of (id, idx): all functions are minima in one aggregation, combined map-side."""
    return members.groupBy("id").agg(F.array(*[F.min(F.pmod(F.col("idx") * p + 1, F.lit(rows))) for p in multipliers]).alias("sig"))


def affine_signatures(members: DataFrame, coefficients: list[tuple[int, int]], prime: int = 10343, rows: int = 10253) -> DataFrame:
    """(id, sig) by min(((a * idx + b) mod prime) mod rows), with fixed (a, b) for each function."""
    return members.groupBy("id").agg(F.array(*[F.min(F.pmod(F.pmod(F.col("idx") * a + b, F.lit(prime)), F.lit(rows))) for a, b in coefficients]).alias("sig"))


def bands(sigs: DataFrame, rows_each: int = 1) -> DataFrame:
    """(band, key, id): the signature cut into bands of so many rows."""
    n = F.floor(F.size("sig") / F.lit(rows_each)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("sig", i * rows_each + 1, F.lit(rows_each)))
    return sigs.select("id", F.posexplode(cut).alias("band", "key")).select("band", "key", "id")


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that share a bucket."""
    left, right = (banded.select("band", "key", F.col("id").alias(x)) for x in ("a", "b"))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def overlaps(members: DataFrame) -> DataFrame:
    """(a, b, common) of all pairs that share a member of (id, idx), counted by a join on the member."""
    left, right = (members.select("idx", F.col("id").alias(x)) for x in ("a", "b"))
    return left.join(right, "idx").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


def with_jaccard(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, sim) of (a, b, common)."""
    sizes = members.groupBy("id").agg(F.count("*").alias("n"))
    out = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("sim"))


def jaccard_pairs(members: DataFrame, cut: float = 0.05) -> DataFrame:
    """All (a, b, sim) with similarity of at least cut."""
    return with_jaccard(overlaps(members), members).where(F.col("sim") >= cut)


def verified(pairs: DataFrame, members: DataFrame, cut: float = 0.05) -> DataFrame:
    """The candidate pairs with their exact similarity, of at least cut."""
    common = pairs.join(members.withColumnRenamed("id", "a"), "a").join(members.withColumnRenamed("id", "b"), ["b", "idx"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return with_jaccard(common, members).where(F.col("sim") >= cut)


def precision_recall(found: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """One row: precision and recall; null for an empty side."""
    keys = list(keys)
    hit = found.select(*keys).intersect(truth.select(*keys)).agg(F.count("*").alias("hit"))
    nf, nt = found.agg(F.count("*").alias("nf")), truth.agg(F.count("*").alias("nt"))
    row = hit.join(F.broadcast(nf)).join(F.broadcast(nt))  # three single rows
    return row.select(F.try_divide("hit", "nf").alias("precision"), F.try_divide("hit", "nt").alias("recall"))
