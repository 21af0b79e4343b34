"""Mixing sources to target weights along a curriculum [DataFrame operations only].

Each source has a weight that changes over training time. Its schedule is integrated, the demand for
its words is the share of the budget that its weight gets, and inverting the cumulative demand gives
each document the time at which the mix reaches it. Documents are range-sorted by that time.

Defined cases: a null or empty text has size 0 and is never taken; the null source is a source of its
own, last in order; documents that repeat are taken each; an empty table gives an empty plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize, shuffle_partitions, tidy


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in code point order, null last, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words to take, as a multiple of all words.
    share: float = 1.5
    #: No source is taken more often than this.
    max_repeats: int = 2
    #: Documents from which a source is cut into 65,536 ranges instead of 256.
    fine_from: int = 1 << 24
    #: Factors on the weight of each class at evenly spaced times from 0 to 1, linear in between:
    #: the first class is early, the second even, the third late.
    schedules: tuple[tuple[float, ...], ...] = field(default=((1.5, 1.25, 0.25), (1.0, 1.0, 1.0), (0.25, 1.25, 1.5)))


def source_targets(sized: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_rank, source_size, target) of (source, size) rows.

    A target is min(max_repeats * source_size, level * weight); the level is the one at which the
    targets add up to the budget. It is the greatest of the levels that arise when the k sources with
    the least room per weight are at their limit, for any k. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    n = len(params.weights)
    weights = F.array(*[F.lit(int(w)) for w in params.weights])
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", F.get(weights, F.col("source_rank") % n)).withColumn("_cap", F.col("source_size") * F.lit(params.max_repeats))
    s = s.withColumn("_room", F.col("_cap").cast("double") / F.col("_w"))
    s = s.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(params.share)))
    full = F.coalesce(F.sum("_cap").over(by_room), F.lit(0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_room), F.lit(0))
    s = s.withColumn("_level", (F.col("_budget") - full) / rest)
    s = s.withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return s.select("source", "source_rank", "source_size", target.alias("target"))


def integral(factors: tuple[float, ...]) -> list[float]:
    """The schedule's integral up to each of its times, as a part of the whole."""
    steps = [(a + b) / 2 for a, b in zip(factors, factors[1:], strict=False)]
    return [sum(steps[:k]) / sum(steps) for k in range(len(factors))]


def time_of(part: Column, factors: tuple[float, ...]) -> Column:
    """The time at which the schedule has asked for this part of its source's demand: the integral, inverted."""
    at, h = integral(factors), 1.0 / (len(factors) - 1)
    whole = sum((a + b) / 2 for a, b in zip(factors, factors[1:], strict=False))
    out = F.lit(1.0)
    for k in reversed(range(len(factors) - 1)):
        a, b = factors[k], factors[k + 1]
        need = (part - F.lit(at[k])) * F.lit(whole)  # a*x + (b-a)*x*x/2 = need, 0 <= x <= 1
        x = need / F.lit(a) if a == b else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * (b - a)) * need, F.lit(0.0))) - F.lit(a)) / F.lit(b - a)
        out = F.when(part < F.lit(at[k + 1]), F.lit(k * h) + x * F.lit(h)).otherwise(out)
    return out


def plan_mix(docs: DataFrame, params: MixParams = MixParams(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the kept columns, source, size, source_size, target, taken, and _take0, _at0, ... of each reading.

    A source's documents stand in the order of md5(doc_id); each holds the words from _before on. The
    mix takes the source's words from the start until the target, then from the start again: taken
    counts them, and _at0, _at1, ... are the times (0 to 1) at which a document's first, second, ...
    reading begins, null if it is not reached. Offsets are sums over 256 (or 65,536) ranges of
    md5 a source, so that a source with a third of all rows is spread over as many tasks.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = materialize(docs.select(*[F.col(c) for c in keep], F.col("source"), size.alias("size"), order.alias("_order")), "mix-sizes")
    return place(slim, params, keep)


def place(slim: DataFrame, params: MixParams, keep: tuple[str, ...]) -> DataFrame:
    digits = 2 if slim.count() < params.fine_from else 4
    targets = broadcast_if_small(materialize(source_targets(slim, params), "mix-targets"))
    out = slim.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_rank", "source_size", "target")
    out = out.withColumn("_range", F.conv(F.substring("_order", 1, digits), 16, 10).cast("int"))
    ranges = out.groupBy("source_rank", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source_rank").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source_rank", "_range").orderBy("_order", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(ranges, (F.col("source_rank") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    out = out.withColumn("_before", F.col("_in") + F.col("_start")).withColumn("_demand", F.floor("target").cast("long"))
    once = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_demand") - start))
    passes = [F.col("_before") + F.col("source_size") * k for k in range(params.max_repeats)]
    takes = [once(p).cast("long") for p in passes]
    out = out.withColumns({f"_take{k}": t for k, t in enumerate(takes)})
    for k in range(params.max_repeats):
        part = passes[k].cast("double") / F.col("target")
        at = F.lit(None).cast("double")
        n = len(params.schedules)
        for c in range(n):
            at = F.when(F.col("source_rank") % n == c, time_of(part, params.schedules[c])).otherwise(at)
        out = out.withColumn(f"_at{k}", F.when(F.col(f"_take{k}") > 0, at))
    taken = sum((F.col(f"_take{k}") for k in range(1, params.max_repeats)), F.col("_take0"))
    return out.select(*keep, "source", "size", "source_size", "target", taken.alias("taken"), *[f"_{c}{k}" for k in range(params.max_repeats) for c in ("take", "at")])


def in_training_order(df: DataFrame, position: str) -> DataFrame:
    """Range-sorted by position, documents that are never reached last."""
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), F.col(position).asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col(position).asc_nulls_last(), "doc_id")


@tidy
def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: rows of docs, a row for each reading, range-sorted by training time.

    Texts stay whole: a reading that the target cuts counts if at least half of the document is
    within it. Columns are those of docs.
    """
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    plan = plan_mix(docs.withColumn("_lw_row", row), params, keep=("doc_id", "_lw_row"))
    readings = F.array(*[F.when((F.col(f"_take{k}") > 0) & (F.col(f"_take{k}") * 2 >= F.col("size")), F.col(f"_at{k}")) for k in range(params.max_repeats)])
    plan = plan.select(F.col("doc_id").alias("_lw_doc"), "_lw_row", F.filter(readings, lambda x: x.isNotNull()).alias("_lw_at"))
    # documents that repeat (same id, same text) have a plan each; their readings are shared out by number
    same = Window.partitionBy("_lw_doc", "_lw_row").orderBy(F.size("_lw_at"), "_lw_at")
    plan = plan.where(F.size("_lw_at") > 0).withColumn("_lw_n", F.row_number().over(same))
    plan = plan.groupBy("_lw_doc", "_lw_row").agg(F.flatten(F.collect_list("_lw_at")).alias("_lw_at"))
    one = docs.withColumn("_lw_row", row)
    repeated = one.groupBy("doc_id", "_lw_row").agg(F.count("*").alias("_lw_c")).where("_lw_c > 1").drop("_lw_c")
    clash = repeated.select(F.col("doc_id").alias("_lw_doc"), "_lw_row")
    on = lambda a, b: a["doc_id"].eqNullSafe(b["_lw_doc"]) & (a["_lw_row"] == b["_lw_row"])
    rows = one if not clash.limit(1).count() else one.join(clash, on(one, clash), "left_anti").unionByName(one.join(clash, on(one, clash), "left_semi").dropDuplicates(["doc_id", "_lw_row"]))
    out = rows.join(plan, on(rows, plan)).withColumn("_lw_time", F.explode("_lw_at")).select(*[rows[c] for c in docs.columns], "_lw_time")
    return in_training_order(out, "_lw_time").drop("_lw_time")


@tidy
def digest(docs: DataFrame) -> DataFrame:
    """What op3 returns: doc_id, size, source_size, target, taken and the first position in training."""
    plan = plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.col("_at0").alias("position"))
    return in_training_order(plan, "position")


def sql_time(part: str, factors: tuple[float, ...]) -> str:
    """time_of() in SQL."""
    at, h = integral(factors), 1.0 / (len(factors) - 1)
    whole = sum((a + b) / 2 for a, b in zip(factors, factors[1:], strict=False))
    out = "1e0"
    num = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    for k in reversed(range(len(factors) - 1)):
        a, b = factors[k], factors[k + 1]
        need = f"(({part} - {num(at[k])}) * {num(whole)})"
        x = f"{need} / {num(a)}" if a == b else f"(sqrt(greatest({num(a * a)} + {num(2.0 * (b - a))} * {need}, 0e0)) - {num(a)}) / {num(b - a)}"
        out = f"CASE WHEN {part} < {num(at[k + 1])} THEN {num(k * h)} + {x} * {num(h)} ELSE {out} END"
    return out


def oracle(params: MixParams = MixParams()) -> str:
    n = len(params.schedules)
    at = "CASE r % {n} {cases} END".format(n=n, cases=" ".join(f"WHEN {c} THEN {sql_time('(before::DOUBLE / target)', params.schedules[c])}" for c in range(n)))
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, params.weights))}][r % {len(params.weights)} + 1] AS w, {params.max_repeats} * source_size AS cap FROM s),
l AS (SELECT *, ({float(params.share)} * (SELECT sum(source_size)::BIGINT FROM s)::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lv FROM w),
t AS (SELECT source, r, source_size, least(cap::DOUBLE, max(lv) OVER () * w::DOUBLE) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.r, t.source_size, t.target, floor(t.target)::BIGINT AS demand,
             coalesce(sum(d.size) OVER (PARTITION BY t.r ORDER BY d.o, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, demand - before)) + greatest(0, least(size, demand - source_size - before)))::BIGINT AS taken,
       CASE WHEN least(size, demand - before) > 0 THEN {at} END AS position
FROM p"""
