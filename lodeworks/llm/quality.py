"""Quality rules with adaptive thresholds [DataFrame operations only].

Each document has three ratios in thousandths: symbols to word characters, repeated to all lines, word
characters to words. Their distributions are held in mergeable quantile sketches, histograms whose buckets
grow with the value (16 to each power of two): counts add up in any order, map-side first, and the sketch
of a language is the sum of those of its sources. The fences of a language and source are quantiles in the
tails of its own sketch, shrunk to its language's and those to the whole corpus's by so many documents'
worth: a large source is judged by itself, a small one mostly by its language. A document is rejected if a
ratio's bucket lies beyond its fence, so a tail never loses more than its share of a large group.

Defined cases: a null text has no words and fails the base rule; null language or source are groups of
their own; repeated rows count and are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, let, materialize, text_or_empty, tidy

SYMBOL = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    #: Per cent of words in repeated windows that fail a document outright.
    max_repeat_percent: int = 30
    #: Documents by whose worth the fences of a group are shrunk to those of the level above it.
    prior: int = 100
    #: The quantiles, in per cent, that are the upper fences of symbols, repeated lines and word lengths, and the lower one of the latter.
    symbols_tail: int = 95
    lines_tail: int = 97
    long_tail: int = 98
    short_tail: int = 2


#: Fences: name, number of the ratio in a sketch, whether it bounds from above.
FENCES = (("symbols_hi", 0, True), ("lines_hi", 1, True), ("length_hi", 2, True), ("length_lo", 2, False))
RATIOS = ("symbols", "lines", "length")


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside 8-word windows that occur twice or more; windows are held by 64-bit hashes."""
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    )

    def covered(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")), lambda a: a["n"])

    def starts(ordered: Column) -> Column:
        again = lambda x, j: F.coalesce(x["h"] == F.get(ordered, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, j + 1)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(F.transform(ordered, lambda x, j: F.struct(x["i"].alias("i"), again(x, j).alias("a"))), lambda y: y["a"]), lambda y: y["i"]))

    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs(h), lambda o: covered(starts(o)))))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(count)


def with_stats(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """docs with struct _q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the ratios."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumns({"_n": F.size("_words"), "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))})
    out = out.withColumns({"_chars": F.length(F.array_join("_words", "")), "_symbols": F.regexp_count(text, F.lit(SYMBOL)), "_rep": repeated_words(F.col("_words"), F.col("_n"))})
    n, chars, one = F.col("_n").cast("long"), F.col("_chars").cast("long"), F.lit(1)
    per = lambda a, b: F.floor(a.cast("long") * 1000 / F.greatest(b, one))
    failed = (n < params.min_words) | (F.col("_rep").cast("long") * 100 > n * params.max_repeat_percent)
    stats = {"n_words": n, "word_chars": chars, "n_symbols": F.col("_symbols").cast("long"), "n_dup_lines": F.col("_lines.dup").cast("long"), "n_repeat_words": F.col("_rep").cast("long"), "base_failed": failed}
    ratios = {"symbols": per(F.col("_symbols"), chars), "lines": per(F.col("_lines.dup"), F.col("_lines.n")), "length": per(chars, n)}
    return out.withColumn("_q", F.struct(*[c.alias(k) for k, c in (stats | ratios).items()])).drop("_words", "_n", "_lines", "_chars", "_symbols", "_rep")


def bucket(v: Column) -> Column:
    """The lower end of a value's bucket: its five leading bits."""
    low = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def fences(stats: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, symbols_hi, lines_hi, length_hi, length_lo) of every language and source in stats (lang, source, _q)."""
    values = stats.where("not _q.base_failed").select("lang", "source", F.posexplode(F.array(*[bucket(F.col(f"_q.{k}")) for k in RATIOS])).alias("m", "b"))
    small = materialize(values.groupBy("lang", "source", "m", "b").agg(F.count("*").alias("c")), "quality-sketches")
    tails = dict(zip([name for name, _, _ in FENCES], (params.symbols_tail, params.lines_tail, params.long_tail, params.short_tail), strict=True))

    def quantiles(group: list[str], mark: str) -> DataFrame:
        """The group's columns, its documents and the quantiles of its sketches, names behind the mark."""
        w = Window.partitionBy(*group, "m")
        s = small.groupBy(*group, "m", "b").agg(F.sum("c").alias("c"))
        s = s.withColumns({"_upto": F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("c").over(w)})
        at = lambda m, k: F.min(F.when((F.col("m") == m) & (F.col("_upto") * 100 >= F.col("_all") * k), F.col("b")))
        return s.groupBy(*group).agg(F.max("_all").alias(f"{mark}n"), *[at(m, tails[name]).alias(f"{mark}{name}") for name, m, _ in FENCES])

    def shrunk(own: str, above: str | int) -> Column:
        n = own[0] + "n"
        return F.expr(f"({n} * {own} + {params.prior} * {above}) div ({n} + {params.prior})")

    whole = quantiles([], "a").first()  # one row of four numbers
    langs = quantiles(["lang"], "l").select(F.col("lang").alias("_lang"), *[shrunk(f"l{name}", whole[f"a{name}"] or 0).alias(f"l{name}") for name in tails])
    langs = materialize(langs, "quality-languages")
    own = quantiles(["lang", "source"], "o").join(broadcast_if_small(langs), F.col("lang").eqNullSafe(F.col("_lang")))
    return own.select("lang", "source", *[shrunk(f"o{name}", f"l{name}").alias(name) for name in tails])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (lang, source, _q) with boolean _kept."""
    f = broadcast_if_small(materialize(limits, "quality-fences")).alias("f")
    out = rows.alias("r").join(f, F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source")), "left")
    inside = F.lit(True)
    for name, m, upper in FENCES:
        value, fence = bucket(F.col(f"r._q.{RATIOS[m]}")), F.col(f"f.{name}")
        inside = inside & (value <= fence if upper else value >= fence)
    # not a conjunction: Spark would push its first part below the join and compute the counts once more
    return out.select("r.*", F.when(F.col("r._q.base_failed"), False).otherwise(F.coalesce(inside, F.lit(True))).alias("_kept"))


def score_documents(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Per document the base counts, base_failed and kept."""
    stats = materialize(with_stats(docs.select("doc_id", "lang", "source", "text"), params).drop("text"), "quality-stats")
    out = judged(stats, fences(stats, params))
    return out.select("doc_id", *[f"_q.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))


@tidy
def keep_good(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged: a first pass for the sketches, a second that filters."""
    stats = materialize(with_stats(docs.select("lang", "source", "text"), params).drop("text"), "quality-stats")
    rows = with_stats(docs.select(F.struct(*docs.columns).alias("_row"), "lang", "source", "text"), params)
    return judged(rows.drop("text"), fences(stats, params)).where("_kept").select("_row.*")


@tidy
def digest(docs: DataFrame) -> DataFrame:
    """What op1 returns."""
    return score_documents(docs)


def oracle(params: QualityParams = QualityParams()) -> str:
    b = lambda v: f"(({v}) >> greatest(length(bin({v})) - 5, 0)) << greatest(length(bin({v})) - 5, 0)"
    tails = (params.symbols_tail, params.lines_tail, params.long_tail, params.short_tail)
    names = [name for name, _, _ in FENCES]

    def level(mark: str, group: str) -> str:
        """SQL of the sketches' quantiles by group, as table <mark>q."""
        lead, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
        at = ", ".join(f"min(b) FILTER (m = {m} AND 100 * upto >= {k} * total) AS {mark}{name}" for (name, m, _), k in zip(FENCES, tails, strict=True))
        counted = f"SELECT {lead}m, b, count(*) AS c FROM k GROUP BY {lead}m, b"
        summed = f"SELECT *, sum(c) OVER (PARTITION BY {lead}m ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {lead}m) AS total FROM ({counted})"
        return f"{mark}q AS (SELECT {lead}max(total) AS {mark}n, {at} FROM ({summed}) {by})"

    def shrunk(own: str, above: str, n: str, name: str) -> str:
        return f"({n} * {own}{name} + {params.prior} * {above}{name}) // ({n} + {params.prior})"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i+7], ' ')) AS c FROM g),
p AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS cov FROM h WHERE c > 1),
r AS (SELECT rid, sum(cov)::BIGINT AS rep FROM p GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls)::BIGINT AS n_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
q AS MATERIALIZED (SELECT *, n_words < {params.min_words} OR 100 * n_repeat_words > {params.max_repeat_percent} * n_words AS base_failed,
             (1000 * n_symbols) // greatest(word_chars, 1) AS v0, (1000 * n_dup_lines) // greatest(n_lines, 1) AS v1, (1000 * word_chars) // greatest(n_words, 1) AS v2 FROM s),
v AS (SELECT rid, lang, source, {b("v0")} AS b0, {b("v1")} AS b1, {b("v2")} AS b2, base_failed FROM q),
k AS MATERIALIZED (SELECT lang, source, unnest([0, 1, 2]) AS m, unnest([b0, b1, b2]) AS b FROM v WHERE NOT base_failed),
{level("a", "")}, {level("l", "lang")}, {level("o", "lang, source")},
ls AS (SELECT lang, {", ".join(shrunk("l.l", "a.a", "l.ln", x) + f" AS l{x}" for x in names)} FROM lq l, aq a),
x AS (SELECT o.lang, o.source, {", ".join(shrunk("o.o", "ls.l", "o.on", x) + f" AS {x}" for x in names)} FROM oq o JOIN ls ON o.lang IS NOT DISTINCT FROM ls.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, q.base_failed,
       NOT q.base_failed AND coalesce(b0 <= symbols_hi AND b1 <= lines_hi AND b2 <= length_hi AND b2 >= length_lo, true) AS kept
FROM q JOIN v USING (rid) LEFT JOIN x ON q.lang IS NOT DISTINCT FROM x.lang AND q.source IS NOT DISTINCT FROM x.source"""
