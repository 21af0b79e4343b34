"""Every query of the engine by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, explore, graph, itemsets, recommend, sampling, similarity, sketch
from ..sources import readers, writers
from ..storage import materialize, new_path, read_table, tidy
from ..streaming import queries as streams
from . import inputs
from .inputs import BAS, BUS, EV, ORV, STOP, TXT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = tidy(f)
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# exploration ------------------------------------------------------------------------------------


@query("q01_total_reviews", f"WITH {EV} SELECT count(*) AS n FROM ev")
def q01(spark, d):
    return explore.total(inputs.event_reviews(spark, d))


@query("q02_reviews_in_year", f"WITH {ORV} SELECT count(*) AS n FROM orv WHERE year(ts) = 1998")
def q02(spark, d):
    return explore.in_year(inputs.order_reviews(spark, d), 1998)


@query("q03_distinct_users", f"WITH {EV} SELECT count(DISTINCT user_id) AS n FROM ev")
def q03(spark, d):
    return explore.distinct_users(inputs.event_reviews(spark, d))


@query("q04_top_users", f"WITH {EV} SELECT user_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def q04(spark, d):
    return explore.top_users(inputs.event_reviews(spark, d), 5)


WORDS = f"""WITH {STOP}, raw AS (SELECT unnest(string_split(lower(text), ' ')) AS r FROM documents),
w AS (SELECT translate(r, '!?(),.[]:;', '') AS word FROM raw WHERE r NOT IN (SELECT word FROM stop))
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word"""


@query("q05_top_words", f"{WORDS} ORDER BY n DESC, word LIMIT 10")
def q05(spark, d):
    return explore.top_words(read_table(spark, d, "documents").select("text"), inputs.stop_words(spark), 10)


@query("q05b_word_counts", WORDS)
def q05b(spark, d):
    return explore.word_counts(read_table(spark, d, "documents").select("text"), inputs.stop_words(spark))


CATEGORIES = f"""WITH {ORV}, {BUS}, s AS (SELECT business_id, sum(stars) AS s, count(*) AS n FROM orv GROUP BY 1),
c AS (SELECT trim(unnest(string_split(categories, ','))) AS category, s, n FROM s JOIN bus USING (business_id))
SELECT category, round(sum(s) / sum(n), 9) AS stars FROM c WHERE category <> '' GROUP BY category"""


@query("q06_top_categories", f"{CATEGORIES} ORDER BY sum(s) / sum(n) DESC, category LIMIT 10")
def q06(spark, d):
    top = explore.top_categories(inputs.order_reviews(spark, d), inputs.part_businesses(spark, d), 10)
    return top.select("category", F.round("stars", 9).alias("stars"))


@query("q07_heavy_businesses", f"WITH {EV} SELECT business_id, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 100")
def q07(spark, d):
    return explore.heavy(inputs.event_reviews(spark, d), "business_id", 100)


@query("q07b_partition_report", f"WITH {EV} SELECT CAST(p AS INT) AS part, count(business_id) AS n_items FROM range(0, 27) r(p) LEFT JOIN ev ON business_id % 27 = p GROUP BY 1")
def q07b(spark, d):
    return explore.partition_report(inputs.event_reviews(spark, d), 27, F.col("business_id"))


@query("q08_user_business_of_state", """SELECT o_custkey AS user_id, l_suppkey AS business_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')""")
def q08(spark, d):
    o, i, s, n = (read_table(spark, d, t) for t in ("orders", "lineitem", "supplier", "nation"))
    reviews = i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"))
    there = s.join(n.where("n_name = 'NATION_7'"), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("business_id"))
    return explore.of_businesses(reviews, there)


# itemsets ---------------------------------------------------------------------------------------


def baskets(spark, d, more_than=0):
    return itemsets.baskets(inputs.brand_pairs(spark, d), "basket", "item", more_than)


def joined(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", ","))


def packed_baskets(spark, d) -> tuple[DataFrame, int]:
    """(part, has, w) of the baskets, joined and packed once, and the threshold."""
    pairs = inputs.brand_pairs(spark, d).withColumn("item", F.col("item").cast("string"))
    packed = materialize(itemsets.packed(itemsets.in_parts(pairs, PARTS), ["part"]), "packed-baskets")
    return packed, inputs.basket_threshold(packed.agg(F.sum("w")).first()[0] or 0)


@query("q09_baskets_by_user", f"WITH {BAS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM bas GROUP BY basket")
def q09(spark, d):
    return joined(itemsets.as_sets(baskets(spark, d)))


@query("q09b_baskets_by_business", f"WITH {BAS} SELECT item AS basket, count(DISTINCT basket) AS n, min(basket) AS first, max(basket) AS last FROM bas GROUP BY item")
def q09b(spark, d):
    by_item = itemsets.baskets(inputs.brand_pairs(spark, d), "item", "basket")
    i = F.col("item").cast("long")
    return by_item.groupBy("basket").agg(F.count("*").alias("n"), F.min(i).alias("first"), F.max(i).alias("last"))


@query("q09c_large_baskets", f"WITH {BAS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM bas GROUP BY basket HAVING count(*) > 5")
def q09c(spark, d):
    return joined(itemsets.as_sets(baskets(spark, d, 5)))


def levels(frequent: str, by: str = "", sizes: int = 4) -> str:
    """SQL of the frequent sets of up to so many items, as joined strings; `by` groups them."""
    key, on = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    rows = [f"SELECT {key}item AS items, count(*) AS n FROM b0 GROUP BY {key}item HAVING count(*) >= {frequent}"]
    for k in range(2, sizes + 1):
        tables = " ".join(f"JOIN b0 x{j} ON x{j}.basket = x{j - 1}.basket AND x{j}.item > x{j - 1}.item" for j in range(2, k + 1))
        names = " || ',' || ".join(f"x{j}.item" for j in range(1, k + 1))
        lead = f"x1.{by}, " if by else ""
        rows.append(f"SELECT {lead}{names} AS items, count(*) AS n FROM b0 x1 {tables} GROUP BY {lead}{names} HAVING count(*) >= {frequent}")
    return " UNION ALL ".join(rows)


FREQUENT = f"WITH {BAS}, b0 AS (SELECT basket, item FROM bas) {levels('(SELECT t FROM thr)')}"
PARTS = 4
LOCAL = f"WITH {BAS}, b0 AS (SELECT basket, item, basket % {PARTS} AS part FROM bas), l AS ({levels(f'(SELECT t FROM thr) / {PARTS}.0', 'part')}) SELECT DISTINCT items FROM l"


@query("q10_local_candidates", LOCAL)
def q10(spark, d):
    sets, least = packed_baskets(spark, d)
    return joined(itemsets.local_candidates(sets, float(least), PARTS))


@query(
    "q11_candidate_triples",
    f"""WITH {BAS}, p AS (SELECT x.item AS a, y.item AS b FROM bas x JOIN bas y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 5 * (SELECT t FROM thr))
SELECT x.a || ',' || x.b || ',' || y.b AS items FROM p x JOIN p y ON x.a = y.a AND x.b < y.b JOIN p z ON z.a = x.b AND z.b = y.b""",
)
def q11(spark, d):
    sets, least = packed_baskets(spark, d)
    pairs = itemsets.mine(sets, 5 * least, 2).where(F.size("items") == 2).select("items")
    return joined(itemsets.candidates(pairs))


@query("q12_frequent_itemsets", FREQUENT)
def q12(spark, d):
    return joined(itemsets.mine(*packed_baskets(spark, d)))


@query("q12b_two_phase_itemsets", f"WITH {BAS}, b0 AS (SELECT basket, item FROM bas) {levels('(SELECT t FROM thr)')}")
def q12b(spark, d):
    return joined(itemsets.two_phase(*packed_baskets(spark, d), PARTS))


@query("q13_support", f"WITH {BAS} SELECT x.item || ',' || y.item AS items, count(*) AS n FROM bas x JOIN bas y ON x.basket = y.basket AND x.item < y.item WHERE x.item = 'Brand#1' GROUP BY 1")
def q13(spark, d):
    long, _ = packed_baskets(spark, d)
    brands = long.select(F.explode("has").alias("item")).distinct()
    wanted = brands.where("item > 'Brand#1'").select(F.array(F.lit("Brand#1"), "item").alias("items"))
    return joined(itemsets.support(long, wanted)).where("n > 0")


@query("q14_fp_growth", FREQUENT)
def q14(spark, d):
    return joined(itemsets.fp_growth(*packed_baskets(spark, d)))


@query("q15_agreement", f"WITH {BAS}, b0 AS (SELECT basket, item FROM bas), f AS ({levels('(SELECT t FROM thr)')}) SELECT unnest(['two_phase', 'fp_growth', 'intersection']) AS name, count(*) AS n FROM f")
def q15(spark, d):
    sets, least = packed_baskets(spark, d)
    return itemsets.agreement(materialize(itemsets.two_phase(sets, least, PARTS), "two-phase"), materialize(itemsets.fp_growth(sets, least), "fp-growth"))


# similarity -------------------------------------------------------------------------------------

MEMBERS = f"""{EV}, u AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ev)),
mem AS (SELECT DISTINCT business_id AS id, idx FROM ev JOIN u USING (user_id)), sz AS (SELECT id, count(*) AS n FROM mem GROUP BY id)"""
PAIRS = """com AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM mem x JOIN mem y ON x.idx = y.idx AND x.id < y.id GROUP BY 1, 2),
jac AS (SELECT a, b, c::DOUBLE / (x.n + y.n - c) AS sim FROM com JOIN sz x ON a = x.id JOIN sz y ON b = y.id)"""
SIG = f"sig AS (SELECT id, m.k AS band, min((m.p * idx + 1) % (SELECT count(*) FROM u)) AS v FROM mem, (SELECT unnest(range({len(similarity.MULTIPLIERS)})) AS k, unnest({similarity.MULTIPLIERS}) AS p) m GROUP BY 1, 2)"


def members(spark, d):
    reviews = inputs.event_reviews(spark, d)
    index, n = similarity.dense_index(reviews, "user_id")
    return materialize(reviews.join(index, "user_id").select(F.col("business_id").alias("id"), "idx").distinct(), "members"), n


@query("q16_dense_index", f"WITH {MEMBERS} SELECT user_id, idx FROM u")
def q16(spark, d):
    return similarity.dense_index(inputs.event_reviews(spark, d), "user_id")[0].select("user_id", "idx")


@query("q17_signatures", f"WITH {MEMBERS}, {SIG} SELECT id, CAST(band AS INT) AS band, v FROM sig")
def q17(spark, d):
    m, n = members(spark, d)
    return similarity.signatures(m, n).select("id", F.posexplode("sig").alias("band", "v"))


@query("q18_bands", f"WITH {MEMBERS}, {SIG} SELECT CAST(band AS INT) AS band, v AS key, count(*) AS n FROM sig GROUP BY 1, 2 HAVING count(*) > 1")
def q18(spark, d):
    m, n = members(spark, d)
    return similarity.bands(similarity.signatures(m, n)).select("band", F.col("key")[0].alias("key")).groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")


CANDIDATES = "cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM sig x JOIN sig y ON x.band = y.band AND x.v = y.v AND x.id < y.id)"


@query("q19_candidate_pairs", f"WITH {MEMBERS}, {SIG}, {CANDIDATES} SELECT a, b FROM cand")
def q19(spark, d):
    m, n = members(spark, d)
    return similarity.candidate_pairs(similarity.bands(similarity.signatures(m, n)))


@query("q20_lsh_pairs", f"WITH {MEMBERS}, {SIG}, {CANDIDATES}, {PAIRS} SELECT a, b, round(sim, 9) AS sim FROM cand JOIN jac USING (a, b) WHERE sim >= 0.05")
def q20(spark, d):
    m, n = members(spark, d)
    found = similarity.verified(similarity.candidate_pairs(similarity.bands(similarity.signatures(m, n))), m, 0.05)
    return found.select("a", "b", F.round("sim", 9).alias("sim"))


@query("q21_jaccard_pairs", f"WITH {MEMBERS}, {PAIRS} SELECT a, b, round(sim, 9) AS sim FROM jac WHERE sim >= 0.05")
def q21(spark, d):
    m, _ = members(spark, d)
    return similarity.jaccard_pairs(m, 0.05).select("a", "b", F.round("sim", 9).alias("sim"))


@query("q22_precision_recall", f"""WITH {MEMBERS}, {SIG}, {CANDIDATES}, {PAIRS}, f AS (SELECT a, b FROM cand JOIN jac USING (a, b) WHERE sim >= 0.05), t AS (SELECT a, b FROM jac WHERE sim >= 0.05)
SELECT round((SELECT count(*) FROM f JOIN t USING (a, b)) / nullif((SELECT count(*) FROM f), 0), 9) AS precision, round((SELECT count(*) FROM f JOIN t USING (a, b)) / nullif((SELECT count(*) FROM t), 0), 9) AS recall""")
def q22(spark, d):
    m, n = members(spark, d)
    found = similarity.verified(similarity.candidate_pairs(similarity.bands(similarity.signatures(m, n))), m, 0.05)
    pr = similarity.precision_recall(found, similarity.jaccard_pairs(m, 0.05))
    return pr.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# content-based recommendation -------------------------------------------------------------------

TOKENS = f"""{TXT}, {STOP}, raw AS (SELECT business_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\p{{Nd}}', '', 'g'), '\\s+')) AS word FROM txt),
tok AS (SELECT business_id, word FROM raw WHERE word <> '' AND word NOT IN (SELECT word FROM stop))"""
TF = "cnt AS (SELECT business_id, word, count(*) AS n FROM tok GROUP BY 1, 2), tf AS (SELECT business_id, word, n / max(n) OVER (PARTITION BY business_id) AS tf FROM cnt)"
IDF = "idf AS (SELECT word, log2((SELECT count(DISTINCT business_id) FROM txt)::DOUBLE / count(*)) AS idf FROM tf GROUP BY word)"
TFIDF = "sc AS (SELECT business_id, word, round(tf * idf, 9) AS score FROM tf JOIN idf USING (word)), top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY score DESC, word) <= 200)"
PROFILES = "dict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT word FROM top)), prof AS (SELECT business_id, idx, score FROM top JOIN dict USING (word))"
USERS = """up AS (SELECT user_id, idx, score FROM (SELECT DISTINCT user_id, idx, score FROM (SELECT DISTINCT user_id, business_id FROM txt) JOIN prof USING (business_id))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, idx) <= 500)"""


def content(spark, d):
    texts = inputs.source_texts(spark, d)
    n = texts.select("business_id").distinct().count()
    return texts, materialize(recommend.token_counts(texts, "business_id", inputs.stop_words(spark)), "tokens"), n


@query("q23_tokens", f"WITH {TOKENS} SELECT business_id, count(*) AS n, count(DISTINCT word) AS words FROM tok GROUP BY 1")
def q23(spark, d):
    words = recommend.token_counts(inputs.source_texts(spark, d), "business_id", inputs.stop_words(spark))
    return words.groupBy("business_id").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


@query("q24_term_frequency", f"WITH {TOKENS}, {TF} SELECT business_id, word, round(tf, 9) AS tf FROM tf")
def q24(spark, d):
    return recommend.term_frequency(recommend.token_counts(inputs.source_texts(spark, d), "business_id", inputs.stop_words(spark)), "business_id").select("business_id", "word", F.round("tf", 9).alias("tf"))


@query("q25_inverse_frequency", f"WITH {TOKENS}, {TF}, {IDF} SELECT word, round(idf, 9) AS idf FROM idf")
def q25(spark, d):
    _, words, n = content(spark, d)
    return recommend.inverse_frequency(recommend.term_frequency(words, "business_id"), "business_id", n).select("word", F.round("idf", 9).alias("idf"))


@query("q26_tf_idf", f"WITH {TOKENS}, {TF}, {IDF}, {TFIDF} SELECT business_id, word, score FROM top")
def q26(spark, d):
    _, words, n = content(spark, d)
    return recommend.tf_idf(words, "business_id", n)


@query("q27_business_profiles", f"WITH {TOKENS}, {TF}, {IDF}, {TFIDF}, {PROFILES} SELECT business_id, idx, score FROM prof")
def q27(spark, d):
    _, words, n = content(spark, d)
    return recommend.business_profiles(materialize(recommend.tf_idf(words, "business_id", n), "tfidf"), "business_id")[0]


def profiles(spark, d):
    texts, words, n = content(spark, d)
    prof, _ = recommend.business_profiles(materialize(recommend.tf_idf(words, "business_id", n), "tfidf"), "business_id")
    prof = materialize(prof, "profiles")
    return texts, prof, recommend.user_profiles(prof, texts, "business_id")


@query("q28_user_profiles", f"WITH {TOKENS}, {TF}, {IDF}, {TFIDF}, {PROFILES}, {USERS} SELECT user_id, idx, score FROM up")
def q28(spark, d):
    return profiles(spark, d)[2]


@query("q29_content_predictions", f"""WITH {TOKENS}, {TF}, {IDF}, {TFIDF}, {PROFILES}, {USERS},
u AS (SELECT DISTINCT user_id, idx FROM up), b AS (SELECT DISTINCT business_id, idx FROM prof), p AS (SELECT DISTINCT user_id, business_id FROM (SELECT DISTINCT user_id FROM txt), (SELECT DISTINCT business_id FROM txt)),
c AS (SELECT p.user_id, p.business_id, count(*) AS c FROM p JOIN u ON u.user_id = p.user_id JOIN b ON b.business_id = p.business_id AND b.idx = u.idx GROUP BY 1, 2)
SELECT user_id, business_id, round(c / (sqrt((SELECT count(*) FROM u WHERE u.user_id = c.user_id)::DOUBLE) * sqrt((SELECT count(*) FROM b WHERE b.business_id = c.business_id)::DOUBLE)), 9) AS sim FROM c WHERE sim >= 0.01""")
def q29(spark, d):
    _, prof, users = profiles(spark, d)
    return recommend.content_predictions(None, users, prof, "business_id")


# collaborative filtering ------------------------------------------------------------------------

TRAIN = f"{EV}, train AS (SELECT * FROM ev WHERE event_id % 10 <> 0), test AS (SELECT DISTINCT user_id, business_id FROM ev WHERE event_id % 10 = 0), r AS (SELECT user_id, business_id, avg(stars) AS s FROM train GROUP BY 1, 2), av AS (SELECT business_id, avg(stars) AS a FROM train GROUP BY 1)"


def corr(of: str, by: str, pairs: str = "") -> str:
    """SQL of the correlated pairs (a, b, sim)."""
    return f"""m AS (SELECT * FROM r WHERE {of} IN (SELECT {of} FROM r GROUP BY 1 HAVING count(*) >= 3)),
su AS (SELECT x.{of} AS a, y.{of} AS b, count(*) AS n, sum(x.s) AS sx, sum(y.s) AS sy, sum(x.s * x.s) AS sxx, sum(y.s * y.s) AS syy, sum(x.s * y.s) AS sxy
  FROM m x JOIN m y ON x.{by} = y.{by} AND x.{of} < y.{of} {pairs} GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT a, b, round(n * sxy - sx * sy, 6) AS num, round(n * sxx - sx * sx, 6) * round(n * syy - sy * sy, 6) AS spr FROM su),
model AS (SELECT a, b, round(num / sqrt(spr), 9) AS sim FROM k WHERE num > 0 AND spr > 0)"""


def split(spark, d):
    e = inputs.event_reviews(spark, d)
    train = e.where("event_id % 10 <> 0")
    ratings = materialize(recommend.mean_ratings(train), "ratings")
    return ratings, recommend.business_average(train), e.where("event_id % 10 = 0").select("user_id", "business_id").distinct()


@query("q30_item_model", f"WITH {TRAIN}, {corr('business_id', 'user_id')} SELECT a AS b1, b AS b2, sim FROM model WHERE sim > 0")
def q30(spark, d):
    return recommend.item_model(split(spark, d)[0])


#: (a, b) of the user signatures, by a fixed rule.
USER_HASHES = [((1009 * (k + 1) * (k + 7)) % 10343 or 1, (811 * k * k + 17) % 10343) for k in range(50)]
LSH = f"""bi AS (SELECT business_id, dense_rank() OVER (ORDER BY business_id) - 1 AS idx FROM (SELECT DISTINCT business_id FROM r)),
mu AS (SELECT user_id, idx FROM r JOIN bi USING (business_id) WHERE user_id IN (SELECT user_id FROM r GROUP BY 1 HAVING count(*) >= 3)),
bd AS (SELECT user_id, h.k AS band, min(((h.a * idx + h.b) % 10343) % 10253) AS v FROM mu, (SELECT unnest(range({len(USER_HASHES)})) AS k, unnest({[a for a, _ in USER_HASHES]}) AS a, unnest({[b for _, b in USER_HASHES]}) AS b) h GROUP BY ALL),
cp AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.v = y.v AND x.user_id < y.user_id)"""


@query("q31_user_model", f"WITH {TRAIN}, {LSH}, {corr('user_id', 'business_id', 'JOIN cp ON cp.a = x.user_id AND cp.b = y.user_id')} SELECT a AS u1, b AS u2, sim FROM model WHERE sim > 0")
def q31(spark, d):
    return recommend.user_model(split(spark, d)[0], USER_HASHES)


@query("q32_predict_by_items", f"""WITH {TRAIN}, {corr('business_id', 'user_id')}, mm AS (SELECT a AS x, b AS y, sim FROM model UNION ALL SELECT b, a, sim FROM model),
t AS (SELECT * FROM test WHERE user_id IN (SELECT user_id FROM r)),
nb AS (SELECT t.user_id, t.business_id, r.s, mm.sim FROM t JOIN r ON r.user_id = t.user_id JOIN mm ON mm.x = t.business_id AND mm.y = r.business_id
  QUALIFY row_number() OVER (PARTITION BY t.user_id, t.business_id ORDER BY mm.sim DESC, r.business_id) <= 10),
p AS (SELECT user_id, business_id, sum(s * sim) / sum(abs(sim)) AS v FROM nb GROUP BY 1, 2)
SELECT user_id, business_id, round(coalesce(v, a, 0), 6) AS stars FROM t LEFT JOIN p USING (user_id, business_id) LEFT JOIN av USING (business_id)""")
def q32(spark, d):
    ratings, average, test = split(spark, d)
    return recommend.predict_by_items(test, ratings, materialize(recommend.item_model(ratings), "model"), average)


@query("q32b_predict_by_users", f"""WITH {TRAIN}, {LSH}, {corr('user_id', 'business_id', 'JOIN cp ON cp.a = x.user_id AND cp.b = y.user_id')}, mm AS (SELECT a AS x, b AS y, sim FROM model UNION ALL SELECT b, a, sim FROM model),
nb AS (SELECT test.user_id, test.business_id, r.s, mm.sim FROM test JOIN mm ON mm.x = test.user_id JOIN r ON r.user_id = mm.y AND r.business_id = test.business_id
  QUALIFY row_number() OVER (PARTITION BY test.user_id, test.business_id ORDER BY mm.sim DESC, mm.y) <= 10),
p AS (SELECT user_id, business_id, sum(s * sim) / sum(abs(sim)) AS v FROM nb GROUP BY 1, 2)
SELECT user_id, business_id, round(coalesce(v, a, 0), 6) AS stars FROM test LEFT JOIN p USING (user_id, business_id) LEFT JOIN av USING (business_id)""")
def q32b(spark, d):
    ratings, average, test = split(spark, d)
    return recommend.predict_by_hashed_users(test, ratings, USER_HASHES, average)


@query("q33_business_average", f"WITH {EV} SELECT business_id, round(avg(stars), 9) AS stars FROM ev GROUP BY 1")
def q33(spark, d):
    return recommend.business_average(inputs.event_reviews(spark, d)).select("business_id", F.round("stars", 9).alias("stars"))


# graphs -----------------------------------------------------------------------------------------

EDGES = f"{ORV}, ub AS (SELECT DISTINCT user_id, business_id FROM orv), e AS (SELECT x.user_id AS a, y.user_id AS b FROM ub x JOIN ub y ON x.business_id = y.business_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 7), arc AS (SELECT a AS s, b AS t FROM e UNION ALL SELECT b, a FROM e)"
LPA = "l0 AS (SELECT DISTINCT s AS node, s AS label FROM arc), " + ", ".join(
    f"l{k} AS (SELECT t AS node, label FROM (SELECT t, label, count(*) AS n FROM arc JOIN l{k - 1} ON s = node GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, label) = 1)" for k in range(1, 6)
)
COMPONENTS = "rc AS (SELECT s AS v, t AS u FROM arc UNION SELECT rc.v, arc.t FROM rc JOIN arc ON rc.u = arc.s), comp AS (SELECT v AS node, least(v, min(u)) AS component FROM rc GROUP BY v)"


def edges(spark, d, least=7):
    return materialize(graph.shared_edges(inputs.order_reviews(spark, d), "user_id", "business_id", least), "edges")


@query("q34_user_graph", f"WITH {EDGES} SELECT a, b FROM e")
def q34(spark, d):
    return graph.shared_edges(inputs.order_reviews(spark, d), "user_id", "business_id", 7)


@query("q35_label_propagation", f"WITH {EDGES}, {LPA} SELECT node, label FROM l5")
def q35(spark, d):
    return graph.label_propagation(edges(spark, d), 5)


@query("q36_communities", f"WITH {EDGES}, {LPA} SELECT string_agg(node, ',' ORDER BY node) AS members FROM l5 GROUP BY label")
def q36(spark, d):
    return graph.listed(graph.label_propagation(edges(spark, d), 5)).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


#: Shortest paths of all pairs: distances by walks without repeats of (root, node, length), path counts level by level, then each arc's share of every pair's paths.
BETWEENNESS = """wk AS (SELECT DISTINCT s AS r, s AS v, 0 AS d FROM arc UNION SELECT wk.r, arc.t, wk.d + 1 FROM wk JOIN arc ON wk.v = arc.s WHERE wk.d < (SELECT count(DISTINCT s) FROM arc)),
ds AS (SELECT r, v, min(d) AS d FROM wk GROUP BY r, v),
sp AS (SELECT r, v, d, 1e0 AS p FROM ds WHERE d = 0 UNION ALL SELECT sp.r, arc.t, sp.d + 1, sum(sp.p) FROM sp JOIN arc ON sp.v = arc.s JOIN ds ON ds.r = sp.r AND ds.v = arc.t AND ds.d = sp.d + 1 GROUP BY sp.r, arc.t, sp.d + 1),
bw AS (SELECT least(arc.s, arc.t) AS u, greatest(arc.s, arc.t) AS v, round(sum(a.p * b.p / c.p) / 2, 9) AS betweenness
  FROM arc JOIN sp a ON a.v = arc.s JOIN sp b ON b.r = arc.t JOIN sp c ON c.r = a.r AND c.v = b.v AND c.d = a.d + 1 + b.d GROUP BY 1, 2)"""


@query("q37_betweenness", f"WITH RECURSIVE {EDGES}, {BETWEENNESS} SELECT u, v, betweenness FROM bw")
def q37(spark, d):
    return graph.betweenness(edges(spark, d))


@query("q38_components", f"WITH RECURSIVE {EDGES}, {COMPONENTS} SELECT node, component FROM comp")
def q38(spark, d):
    return graph.connected(edges(spark, d))


@query("q39_modularity", f"""WITH {EDGES}, {LPA}, x AS (SELECT ca.label AS ca, cb.label AS cb FROM e JOIN l5 ca ON e.a = ca.node JOIN l5 cb ON e.b = cb.node),
dg AS (SELECT unnest([ca, cb]) AS c FROM x), k AS (SELECT c, count(*) AS k FROM dg GROUP BY c)
SELECT round((SELECT count(*) FROM x WHERE ca = cb) * 2 / sum(k) - sum(k::DOUBLE * k) / (sum(k)::DOUBLE * sum(k)), 9) AS modularity FROM k""")
def q39(spark, d):
    e = edges(spark, d)
    return graph.modularity(e, graph.label_propagation(e, 5))


@query("q40_girvan_newman")
def q40(spark, d):
    return graph.girvan_newman(edges(spark, d)).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


# sketches, samples, streams ---------------------------------------------------------------------


def string_number(modulus: int) -> str:
    """SQL of the bytes of city as a number modulo `modulus`."""
    return f"list_reduce(list_transform(range(1, 1 + (length(hex(encode(city))) // 2)::BIGINT), lambda i: ('0x' || substring(hex(encode(city)), 2 * i - 1, 2))::BIGINT), lambda acc, b: (acc * 256 + b) % {modulus}, 0::BIGINT)"


BLOOM_M = 233333333333
HASHES = "(SELECT unnest({a}) AS a, unnest({b}) AS b) h".format(a=[a % BLOOM_M for a, _ in sketch.BLOOM_HASHES], b=[b for _, b in sketch.BLOOM_HASHES])
BITS = f"{EV}, cx AS (SELECT city, event_id, {string_number(BLOOM_M)} AS x FROM ev), bt AS (SELECT city, event_id, ((h.a::HUGEINT * x + h.b) % {BLOOM_M} % {sketch.BLOOM_BITS})::BIGINT AS bit FROM cx, {HASHES})"


@query("q41_bloom_filter", f"WITH {BITS} SELECT DISTINCT bit FROM bt WHERE event_id % 4 = 0")
def q41(spark, d):
    return sketch.bloom_filter(inputs.event_reviews(spark, d).where("event_id % 4 = 0"))


@query("q42_bloom_lookup", f"WITH {BITS}, f AS (SELECT DISTINCT bit FROM bt WHERE event_id % 4 = 0) SELECT city, CAST(min(CASE WHEN f.bit IS NULL THEN 0 ELSE 1 END) AS INT) AS hit FROM bt LEFT JOIN f USING (bit) GROUP BY city")
def q42(spark, d):
    e = inputs.event_reviews(spark, d)
    return sketch.bloom_lookup(e, sketch.bloom_filter(e.where("event_id % 4 = 0")))


FM_H = "(SELECT unnest(range({n})) AS k, unnest({a}) AS a, unnest({b}) AS b) h".format(n=len(sketch.FM_HASHES), a=[a for a, _ in sketch.FM_HASHES], b=[b for _, b in sketch.FM_HASHES])
FM = f"""WITH {EV}, ct AS (SELECT DISTINCT city FROM ev), cx AS (SELECT city, {string_number(sketch.FM_MODULUS)} AS x FROM ct),
z AS (SELECT city, h.k, bin((h.a * x + h.b) % {sketch.FM_MODULUS}) AS v FROM cx, {FM_H}),
w AS (SELECT DISTINCT strftime(time_bucket(INTERVAL 10 MINUTE, ts) - s.i * INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_start, city FROM ev, (SELECT unnest(range(3)) AS i) s),
m AS (SELECT window_start, k, max(length(v) - length(rtrim(v, '0'))) AS r FROM w JOIN z USING (city) GROUP BY 1, 2),
g AS (SELECT window_start, k // 5 AS g, round_even(sum(pow(2, r)) / 5, 0) AS mean FROM m GROUP BY 1, 2),
t AS (SELECT window_start, count(*) AS truth FROM w GROUP BY 1)
SELECT window_start, truth, CAST(list_sort(list(mean))[5] AS BIGINT) AS estimate FROM g JOIN t USING (window_start) GROUP BY window_start, truth"""


@query("q43_distinct_by_window", FM)
def q43(spark, d):
    return sketch.windowed_counts(inputs.event_reviews(spark, d), "30 minutes", "10 minutes")


RESERVOIR = "res AS (SELECT event_id, event_type FROM events ORDER BY md5('666:' || event_id::VARCHAR), event_id LIMIT 100)"


@query("q44_reservoir", f"WITH {RESERVOIR} SELECT event_id, event_type FROM res")
def q44(spark, d):
    return sampling.reservoir(read_table(spark, d, "events").select("event_id", "event_type"))


TIERS = f"WITH {RESERVOIR}, c AS (SELECT unnest([event_type, event_type || '_' || CAST(event_id % 3 AS VARCHAR)]) AS tag FROM res), n AS (SELECT tag, count(*) AS n FROM c GROUP BY 1) SELECT tag, n, tier FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS tier FROM n) WHERE tier <= 3"


def tagged(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.array("event_type", F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string"))).alias("tags"))


@query("q45_top_tiers", TIERS)
def q45(spark, d):
    return sampling.top_tiers(sampling.tag_counts(sampling.reservoir(tagged(read_table(spark, d, "events")))))


def event_stream(spark, d):
    schema = read_table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("q60_streamed_distinct", FM)
def q60(spark, d):
    s = event_stream(spark, d).select("ts", F.concat_ws("_", "event_type", F.get_json_object("props", "$.k")).alias("city"))
    keeper = streams.StreamedDistinct("30 minutes", "10 minutes")
    streams.start(s, keeper, new_path(spark, "windows-checkpoint"), None).awaitTermination()
    return keeper.counts()


@query("q61_streamed_tiers", TIERS)
def q61(spark, d):
    keeper = streams.StreamedReservoir()
    streams.start(tagged(event_stream(spark, d)), keeper, new_path(spark, "reservoir-checkpoint"), None).awaitTermination()
    return keeper.reports[-1]


@query("q62_tracked_stream", "SELECT event_id, event_type FROM events WHERE lower(event_type) LIKE '%click%'")
def q62(spark, d):
    return streams.run_available(readers.tracked(event_stream(spark, d), ["Click"], "event_type").select("event_id", "event_type"), "tracked")


# clustering -------------------------------------------------------------------------------------

START = """p AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT row_number() OVER (ORDER BY md5('666:' || point_id::VARCHAR), point_id) - 1 AS k, v FROM p QUALIFY k < 10)"""
ASSIGNED = f"""{START},
asg AS (SELECT p.point_id, p.v, c.k FROM p, c QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY list_distance(p.v, c.v), c.k) = 1)"""


@query("q46_nearest_centroid", f"WITH {ASSIGNED} SELECT point_id, lpad(k::VARCHAR, 4, '0') AS cluster FROM asg")
def q46(spark, d):
    points = inputs.points(spark, d)
    return cluster.assign(points, cluster.first_centres(points, 10)).select("point_id", "cluster")


def lloyd(rounds: int) -> str:
    """SQL of so many rounds over p from the centres c: the last assignment, asg."""
    out = ["c0 AS (SELECT k, v FROM c)"]
    near = "SELECT p.point_id, p.v, c{i}.k FROM p, c{i} QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY list_distance(p.v, c{i}.v), c{i}.k) = 1"
    for i in range(rounds):
        out.append(f"a{i} AS ({near.format(i=i)})")
        out.append(f"m{i} AS (SELECT k, list(m ORDER BY d) AS v FROM (SELECT k, d, avg(x) AS m FROM (SELECT k, unnest(v) AS x, unnest(range(len(v))) AS d FROM a{i}) GROUP BY k, d) GROUP BY k)")
        out.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)")
    return ", ".join([*out, f"asg AS ({near.format(i=rounds)})"])


@query("q46b_kmeans", f"WITH {START}, {lloyd(5)} SELECT point_id, lpad(k::VARCHAR, 4, '0') AS cluster FROM asg")
def q46b(spark, d):
    return cluster.kmeans(inputs.points(spark, d), 10, 5)[0].select("point_id", "cluster")


@query("q49_cluster_summaries", f"WITH {ASSIGNED}, x AS (SELECT k, unnest(v) AS x, unnest(range(len(v))) AS i FROM asg) SELECT lpad(k::VARCHAR, 4, '0') AS cluster, CAST(i AS INT) AS i, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM x GROUP BY k, i")
def q49(spark, d):
    points = inputs.points(spark, d)
    sums = cluster.summaries(cluster.assign(points, cluster.first_centres(points, 10)))
    rows = [(k, i, s.n, t, q) for k, s in sums.items() for i, (t, q) in enumerate(zip(s.total, s.squares, strict=True))]
    return spark.createDataFrame(rows, "cluster string, i int, n long, total double, squares double").withColumns({c: F.round(c, 6) for c in ("total", "squares")})


def bfr(spark, d):
    points = inputs.points(spark, d)
    return points, cluster.bfr([points.where(F.col("point_id") % 5 == k) for k in range(5)])


@query("q54_bfr_rounds")
def q54(spark, d):
    return cluster.round_report(spark, bfr(spark, d)[1])


@query("q55_bfr_labels")
def q55(spark, d):
    points, state = bfr(spark, d)
    return cluster.labels(points, state)


# sources and sinks ------------------------------------------------------------------------------


@query("q70_json_round_trip", "SELECT o_orderkey AS id, o_orderpriority AS city FROM orders")
def q70(spark, d):
    path = new_path(spark, "orders-json")
    writers.json_rows(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("city")), path)
    return readers.json_lines(spark, path, "id long, city string")


@query("q71_csv_round_trip", f"WITH {EV} SELECT DISTINCT user_id::VARCHAR AS user_id, business_id::VARCHAR AS business_id FROM ev")
def q71(spark, d):
    path = new_path(spark, "pairs-csv")
    writers.csv_rows(inputs.event_reviews(spark, d).select("user_id", "business_id").distinct(), path)
    return readers.pairs_csv(spark, path)


@query("q72_itemset_report", f"WITH {BAS}, b0 AS (SELECT basket, item FROM bas), f AS ({levels('5 * (SELECT t FROM thr)', sizes=3)}), l AS (SELECT string_split(items, ',') AS s FROM f) SELECT CAST(len(s) AS INT) AS size, string_agg('(''' || array_to_string(s, ''', ''') || ''')', ',' ORDER BY s) AS value FROM l GROUP BY 1")
def q72(spark, d):
    sets, least = packed_baskets(spark, d)
    return writers.itemset_report(itemsets.mine(sets, 5 * least))


@query("q73_community_lines", f"WITH {EDGES}, {LPA} SELECT '''' || string_agg(node::VARCHAR, ''', ''' ORDER BY node) || '''' AS value FROM l5 GROUP BY label")
def q73(spark, d):
    return writers.community_lines(graph.listed(graph.label_propagation(edges(spark, d), 5)))


@query("q74_bit_line", f"WITH {BITS}, f AS (SELECT DISTINCT bit FROM bt WHERE event_id % 4 = 0), h AS (SELECT city, min(CASE WHEN f.bit IS NULL THEN 0 ELSE 1 END) AS hit FROM bt LEFT JOIN f USING (bit) GROUP BY city) SELECT string_agg(hit::VARCHAR, ' ' ORDER BY city) AS value FROM h")
def q74(spark, d):
    e = inputs.event_reviews(spark, d)
    return writers.bit_line(sketch.bloom_lookup(e, sketch.bloom_filter(e.where("event_id % 4 = 0"))).withColumnRenamed("city", "position"))


@query("q75_exploratory_document", f"""WITH {EV}, t AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5)
SELECT '{{"A":[{{"n":' || (SELECT count(*) FROM ev) || '}}],"C":[{{"n":' || (SELECT count(DISTINCT user_id) FROM ev) || '}}],"D":[' || (SELECT string_agg('{{"user_id":' || user_id || ',"n":' || n || '}}', ',' ORDER BY user_id) FROM t) || ']}}' AS value""")
def q75(spark, d):
    e = inputs.event_reviews(spark, d)
    return writers.json_document({"A": explore.total(e), "C": explore.distinct_users(e), "D": explore.top_users(e, 5)})
