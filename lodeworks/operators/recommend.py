"""Recommendation: TF-IDF content profiles with set cosine, and collaborative filtering by Pearson correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialize
from . import similarity, user_blocks

#: Digits to which similarities are rounded before they are compared, so that summation order decides nothing.
EXACT = 9
#: Share of all pairs from which buckets count as crowded.
CROWDED = 0.1


def token_counts(texts: DataFrame, key: str, stop: DataFrame | None = None) -> DataFrame:
    """(key, word, n): lower case, anything but letters, digits and _ to spaces, digits dropped, stop words dropped.

    Words are counted as they stand, combined map-side; digits and stop words are dropped from the
    distinct words of a key only.
    """
    raw = texts.select(key, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("raw")).groupBy(key, "raw").agg(F.count("*").alias("n"))
    words = raw.select(key, F.regexp_replace("raw", r"\p{Nd}", "").alias("word"), "n").where("word <> ''")
    if stop is not None:
        words = words.join(broadcast_if_small(stop.select("word")), "word", "left_anti")
    return words.groupBy(key, "word").agg(F.sum("n").alias("n"))


def term_frequency(counts: DataFrame, key: str) -> DataFrame:
    """(key, word, tf) of (key, word, n): count over the largest count of the key."""
    most = counts.groupBy(key).agg(F.max("n").alias("most"))  # an aggregate, not a window: a long document is no single task
    return counts.join(broadcast_if_small(most), key).select(key, "word", (F.col("n") / F.col("most")).alias("tf"))


def inverse_frequency(tf: DataFrame, key: str, documents: int) -> DataFrame:
    """(word, idf) = log2(documents / documents with the word)."""
    return tf.groupBy("word").agg(F.count("*").alias("df")).select("word", F.log2(F.lit(float(documents)) / F.col("df")).alias("idf"))


def tf_idf(counts: DataFrame, key: str, documents: int, top: int | None = 200) -> DataFrame:
    """(key, word, score) of (key, word, n), the best of each key, ties by word."""
    tf = term_frequency(counts, key)
    scored = tf.join(inverse_frequency(tf, key, documents), "word").select(key, "word", F.round(F.col("tf") * F.col("idf"), EXACT).alias("score"))
    if top is None:
        return scored
    best = Window.partitionBy(key).orderBy(F.desc("score"), "word")
    return scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank")


def business_profiles(scored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, idx, score) with words as indices of a dictionary in word order, the dictionary (word, idx))."""
    words, _ = similarity.dense_index(scored, "word")
    return scored.join(words, "word").select(key, "idx", "score"), words


def user_profiles(profiles: DataFrame, ratings: DataFrame, key: str, top: int = 500) -> DataFrame:
    """(user_id, idx, score): the distinct (word, score) of the businesses a user rated, the best of them; ties by index."""
    each = ratings.select("user_id", key).distinct().join(profiles, key).select("user_id", "idx", "score").distinct()
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "idx")
    return each.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank")


def content_predictions(pairs: DataFrame | None, users: DataFrame, businesses: DataFrame, key: str, cut: float = 0.01) -> DataFrame:
    """(user_id, key, sim): set cosine of the profiles' words, of at least cut; a missing or empty profile gives none."""
    u, b = users.select("user_id", "idx").distinct(), businesses.select(key, "idx").distinct()
    nu, nb = u.groupBy("user_id").agg(F.count("*").alias("nu")), b.groupBy(key).agg(F.count("*").alias("nb"))
    # without pairs, all that share a word; the others have no row either way
    shared = u.join(b, "idx") if pairs is None else pairs.select("user_id", key).distinct().join(u, "user_id").join(b, [key, "idx"])
    common = shared.groupBy("user_id", key).agg(F.count("*").alias("c"))
    sim = F.col("c") / (F.sqrt(F.col("nu").cast("double")) * F.sqrt(F.col("nb").cast("double")))
    return common.join(nu, "user_id").join(nb, key).select("user_id", key, F.round(sim, EXACT).alias("sim")).where(F.col("sim") >= cut)


def mean_ratings(reviews: DataFrame) -> DataFrame:
    """One rating of each user and business: the mean of the repeated ones."""
    return reviews.groupBy("user_id", "business_id").agg(F.avg("stars").alias("stars"))


def business_average(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("business_id").agg(F.avg("stars").alias("stars"))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums over the common raters; 0 unless numerator and denominator are positive."""
    num = F.round(n * sxy - sx * sy, 6)
    spread = F.round(n * sxx - sx * sx, 6) * F.round(n * syy - sy * sy, 6)
    return F.when((num > 0) & (spread > 0), F.round(num / F.sqrt(spread), EXACT)).otherwise(F.lit(0.0))


def correlated(ratings: DataFrame, of: str, by: str, least_ratings: int = 3, least_common: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, sim), a < b, sim > 0, of values of one column by the ratings they share in the other; among the given pairs only, if any."""
    many = ratings.groupBy(of).agg(F.count("*").alias("c")).where(F.col("c") >= least_ratings).select(of)
    r = ratings.join(broadcast_if_small(many), of, "left_semi").select(F.col(of).alias("k"), F.col(by).alias("m"), F.col("stars").cast("double").alias("s"))
    x, y = r.select(F.col("k").alias("a"), "m", F.col("s").alias("x")), r.select(F.col("k").alias("b"), "m", F.col("s").alias("y"))
    both = x.join(y, "m").where("a < b") if pairs is None else pairs.join(x, "a").join(y, ["b", "m"])
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    sim = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.where(F.col("n") >= least_common).select("a", "b", sim.alias("sim")).where("sim > 0")


def item_model(ratings: DataFrame, least_ratings: int = 3, least_common: int = 3) -> DataFrame:
    """(b1, b2, sim) with b1 < b2."""
    return correlated(ratings, "business_id", "user_id", least_ratings, least_common).select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim")


def hashed_users(ratings: DataFrame, coefficients: list[tuple[int, int]], least_ratings: int, prime: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, idx, stars) of users with enough ratings, their (id, sig), the (business_id, idx))."""
    index, _ = similarity.dense_index(ratings, "business_id")
    many = ratings.groupBy("user_id").agg(F.count("*").alias("c")).where(F.col("c") >= least_ratings)
    members = ratings.join(broadcast_if_small(many.select("user_id")), "user_id", "left_semi").join(index, "business_id").select(F.col("user_id").alias("id"), "idx", F.col("stars").cast("double").alias("stars"))
    members = materialize(members, "members")
    return members, materialize(similarity.affine_signatures(members, coefficients, prime, rows), "signatures"), index


def crowded(sigs: DataFrame, band_rows: int) -> bool:
    """Whether the buckets would propose a tenth as many pairs as there are, repeats included, or more."""
    n = F.col("n").cast("double")
    buckets = similarity.bands(sigs, band_rows).groupBy("band", "key").agg(F.count("*").alias("n"))
    users = sigs.count()
    return (buckets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0) >= CROWDED * users * (users - 1) / 2


def user_model(ratings: DataFrame, coefficients: list[tuple[int, int]], least_ratings: int = 3, least_common: int = 3, prime: int = 10343, rows: int = 10253, band_rows: int = 1) -> DataFrame:
    """(u1, u2, sim) with u1 < u2, among users who share a band of MinHash signatures.

    One rating of each user and business. Where the bands propose most of all pairs, users are
    compared in blocks instead of pair by pair; a pair without a common band is left out either way.
    """
    members, sigs, _ = hashed_users(ratings, coefficients, least_ratings, prime, rows)
    if crowded(sigs, band_rows):
        model = user_blocks.model(user_blocks.of_users(members, sigs), band_rows, least_common, EXACT)
    else:
        pairs = similarity.candidate_pairs(similarity.bands(sigs, band_rows))
        model = correlated(ratings, "user_id", "business_id", least_ratings, least_common, pairs)
    return model.select(F.col("a").alias("u1"), F.col("b").alias("u2"), "sim")


def weighted(neighbours: DataFrame, top: int) -> DataFrame:
    """(user_id, business_id, stars): the mean of s weighted by sim over the most similar neighbours of each pair."""
    best = Window.partitionBy("user_id", "business_id").orderBy(F.desc("sim"), "neighbour")
    top_n = neighbours.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top)
    return top_n.groupBy("user_id", "business_id").agg(F.try_divide(F.sum(F.col("s") * F.col("sim")), F.sum(F.abs("sim"))).alias("stars"))


def filled(pairs: DataFrame, predicted: DataFrame, average: DataFrame) -> DataFrame:
    """The predictions, else the business average, else 0, rounded."""
    out = pairs.join(predicted, ["user_id", "business_id"], "left").join(average.withColumnRenamed("stars", "average"), "business_id", "left")
    return out.select("user_id", "business_id", F.round(F.coalesce("stars", "average", F.lit(0.0)), 6).alias("stars"))


def predict_by_items(pairs: DataFrame, ratings: DataFrame, model: DataFrame, average: DataFrame, top: int = 10) -> DataFrame:
    """(user_id, business_id, stars) of distinct pairs whose user has ratings."""
    wanted = pairs.select("user_id", "business_id").distinct().join(ratings.select("user_id").distinct(), "user_id", "left_semi")
    both = model.select("b1", "b2", "sim").unionByName(model.select(F.col("b2").alias("b1"), F.col("b1").alias("b2"), "sim"))
    rated = ratings.select("user_id", F.col("business_id").alias("neighbour"), F.col("stars").alias("s"))
    near = wanted.join(rated, "user_id").join(both.select(F.col("b1").alias("business_id"), F.col("b2").alias("neighbour"), "sim"), ["business_id", "neighbour"])
    return filled(wanted, weighted(near, top), average)


def predict_by_users(pairs: DataFrame, ratings: DataFrame, model: DataFrame, average: DataFrame, top: int = 10) -> DataFrame:
    """The same with the ratings that similar users gave the business."""
    wanted = pairs.select("user_id", "business_id").distinct()
    both = model.select("u1", "u2", "sim").unionByName(model.select(F.col("u2").alias("u1"), F.col("u1").alias("u2"), "sim"))
    near = wanted.join(both.select(F.col("u1").alias("user_id"), F.col("u2").alias("neighbour"), "sim"), "user_id")
    near = near.join(ratings.select(F.col("user_id").alias("neighbour"), "business_id", F.col("stars").alias("s")), ["neighbour", "business_id"])
    return filled(wanted, weighted(near, top), average)


def predict_by_hashed_users(pairs: DataFrame, ratings: DataFrame, coefficients: list[tuple[int, int]], average: DataFrame, top: int = 10, least_ratings: int = 3, least_common: int = 3, prime: int = 10343, rows: int = 10253, band_rows: int = 1) -> DataFrame:
    """predict_by_users with the model of user_model; in crowded buckets only the most similar raters of the wanted businesses are kept, not the model."""
    members, sigs, index = hashed_users(ratings, coefficients, least_ratings, prime, rows)
    if not crowded(sigs, band_rows):
        model = user_model(ratings, coefficients, least_ratings, least_common, prime, rows, band_rows)
        return predict_by_users(pairs, ratings, materialize(model, "model"), average, top)
    wanted = pairs.select("user_id", "business_id").distinct()
    asked = wanted.join(broadcast_if_small(index), "business_id").select(F.col("user_id").alias("id"), "idx")
    near = user_blocks.neighbours(user_blocks.of_users(members, sigs, asked), band_rows, least_common, EXACT, top)
    near = near.withColumnRenamed("id", "user_id").join(broadcast_if_small(index), "idx").drop("idx")
    return filled(wanted, weighted(near, top), average)
