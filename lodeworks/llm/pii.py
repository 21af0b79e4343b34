"""Personal data: base patterns, extended by bootstrapped contextual extraction [DataFrame operations only].

Base matches of four kinds are seeds. So are long hexadecimal words, of a fifth kind, secrets, which no base
pattern knows; a secret counts only where a trusted pattern says so. The words around a seed are lexical
patterns: two or three words before it, the word on either side, two words behind it. Patterns and the
identifier-like values seen in them are a bipartite graph, scored in rounds: a pattern's score for a kind is
the sum of its values' scores over their number and a half, a free value's the mean of its patterns', seeds
stay at one, and seeds of other kinds and values whose shape cannot be of the kind stay at zero. Free values
of patterns with enough seeds, from enough documents, and a high score are found; they become seeds
themselves, new patterns are induced from all seeds, and so on until nothing new is found.

Positions come from the pieces between matches, so no text leaves the JVM. Texts are cut into chunks where
no match can cross, behind a letter and a blank or at a line end, so that the work grows with their length.
Offsets are code points.

Defined cases: a null text is empty and has no spans; repeated rows have the same spans each; matches of
different kinds may overlap; found values never overlap base spans; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, materialize, text_or_empty, tidy

KINDS = ("email", "ip", "card", "phone")
#: Kinds of found values: the base ones and secrets.
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
#: The contract's patterns, written so that Java neither tries a run again from its middle nor recurses on long ones.
REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "phone": "+"}
#: A value that may identify someone: a run of such letters with a digit or an at sign; marks at its ends are no part of it.
LOOSE = r"(?<![A-Za-z0-9@._%+:-])(?=[A-Za-z._%+:-]*+[0-9@])[A-Za-z0-9@._%+:-]++"
LEADING, TRAILING = r"^[._%:-]*+", r"[._%+:-]*+$"
#: And a run of digits joined by blanks, brackets, dots and hyphens: phones and cards without the '+', the length or the Luhn test.
RUN = r"\+?\(?[0-9]++(?:[\x20().-]++[0-9]++)++"
#: A seed of a secret.
HEX = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$"
#: A chunk: from some length on, up to the next place that no match crosses.
CHUNK = r"(?s).{8192,}?(?:[A-Za-z]\x20|\n)|.+"
SPAN = "struct<start:int,kind:int,end:int>"
SEEN = "struct<kind:int,chunk:int,start:int,end:int,value:string,patterns:array<string>>"


@dataclass(frozen=True)
class PiiParams:
    #: Seed values, and documents, that a pattern needs for a kind.
    least_seeds: int = 3
    #: Rounds of scores in a graph, and rounds of new seeds at most.
    rounds: int = 3
    generations: int = 4
    least_score: float = 0.8
    #: Characters on either side in which context words are sought.
    context: int = 48


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    r = F.reverse(d)
    one = lambda i: F.substring(r, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, one(i)).when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda t: (F.length(t) < 3) | ((F.length(t) == 3) & (t <= "255"))))
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, ok, made) -> Column:
    """Array of made(value, start, end) for the matches for which ok(value) holds."""
    empty = F.array_compact(F.array(F.when(F.lit(False), made(F.lit(""), F.lit(0), F.lit(0)))))

    def placed(m: Column) -> Column:
        def step(gaps: Column):
            def add(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(gaps, i))
                value = F.get(m, i)
                end = start + F.length(value)
                return F.struct(end.alias("at"), F.when(ok(value), F.concat(acc["out"], F.array(made(value, start, end)))).otherwise(acc["out"]).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

        return F.when(F.exists(m, ok), let(F.split(text, pattern, -1), step)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    found = []
    for k, kind in enumerate(KINDS):
        span = lambda v, s, e, k=k: F.struct(s.cast("int").alias("start"), F.lit(k).alias("kind"), e.cast("int").alias("end"))
        spans = matches(text, REGEX[kind], partial(valid, kind), span)
        if kind in NEEDS:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans)
        found.append(F.coalesce(spans, none_of(SPAN)))
    return F.array_sort(F.concat(*found))


def chunks(text: Column, context: int) -> Column:
    """The text's chunks, in order: at (where it starts), before and after (what stands around it), body. None if no value can be in it."""

    def placed(parts: Column) -> Column:
        upto = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none_of("int").alias("out")), upto, lambda a: a["out"])
        near = lambda x: F.coalesce(x, F.lit(""))
        one = lambda o: F.transform(parts, lambda x, i: F.struct(F.get(o, i).alias("at"), near(F.when(i > 0, F.right(F.get(parts, i - 1), F.lit(context)))).alias("before"), x.alias("body"), near(F.left(F.get(parts, i + 1), F.lit(context))).alias("after")))
        return let(starts, one)

    return F.when(F.regexp(text, F.lit("[0-9@]")), let(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), placed)).otherwise(none_of("struct<at:int,before:string,body:string,after:string>"))


def words_of(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """The patterns of a place, values in them masked: two and three words before it, the words on either side, two words behind it. Each holds a word."""
    mask = lambda w: F.regexp_replace(w, r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", "0")
    low = F.greatest(start - width, F.lit(0))

    def patterns(before: Column, after: Column) -> Column:
        left = [F.coalesce(mask(F.try_element_at(before, F.lit(-k))), F.lit("^")) for k in (1, 2, 3)]
        right = [F.coalesce(mask(F.get(after, F.lit(k))), F.lit("$")) for k in (0, 1)]
        forms = [F.concat_ws(" ", left[1], left[0], F.lit("_")), F.concat_ws(" ", left[0], F.lit("_"), right[0]), F.concat_ws(" ", left[2], left[1], left[0], F.lit("_")), F.concat_ws(" ", F.lit("_"), right[0], right[1])]
        return F.filter(F.array(*forms), lambda f: F.regexp(f, F.lit(r"(?:^|\x20)[^\x20]*[^\x20_^$0]")))

    return let(words_of(F.substring(text, low + 1, start - low)), lambda b: let(words_of(F.substring(text, end + 1, F.lit(width))), lambda a: patterns(b, a)))


def loose_values(text: Column) -> Column:
    """(start, end, value) of the values of a chunk that no base pattern need know: words, and runs of digits with blanks."""

    def trimmed(v: Column, s: Column, e: Column) -> Column:
        return let(F.length(F.regexp_extract(v, LEADING, 0)), lambda a: let(F.length(F.regexp_extract(v, TRAILING, 0)), lambda z: F.struct((s + a).cast("int").alias("start"), (e - z).cast("int").alias("end"), F.substring(v, a + 1, F.length(v) - a - z).alias("value"))))

    whole = lambda v, s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), v.alias("value"))
    words = F.filter(matches(text, LOOSE, lambda m: F.length(m) >= 5, trimmed), lambda x: F.length(x["value"]) >= 5)
    runs = matches(text, RUN, lambda m: (F.length(m) >= 5) & F.contains(m, F.lit(" ")), whole)
    inside = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    # of a word in a run, the run counts, unless only the word can be a value
    alone = lambda r: F.filter(words, lambda x: ~F.exists(r, lambda y: inside(x, y) & (could_be(y["value"]) | ~could_be(x["value"]))))
    return let(runs, lambda r: F.concat(alone(r), r))


def of_chunk(c: Column, number: Column, params: PiiParams) -> Column:
    """base: the spans of a chunk; seen: its values with their patterns, seeds with their kind, others without."""

    def found(around: Column, lead: Column, base: Column) -> Column:
        def seen(kind: Column, start: Column, end: Column, value: Column) -> Column:
            patterns = context(around, start + lead, end + lead, params.context)
            return F.struct(kind.cast("int").alias("kind"), number.alias("chunk"), (start + c["at"]).alias("start"), (end + c["at"]).alias("end"), value.alias("value"), patterns.alias("patterns"))

        seeds = F.transform(base, lambda b: seen(b["kind"], b["start"], b["end"], F.substring(c["body"], b["start"] + 1, b["end"] - b["start"])))
        free = F.filter(loose_values(c["body"]), lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        others = F.transform(free, lambda x: seen(F.when(F.regexp(x["value"], F.lit(HEX)), F.lit(SECRET)), x["start"], x["end"], x["value"]))
        moved = F.transform(base, lambda b: F.struct((b["start"] + c["at"]).alias("start"), b["kind"].alias("kind"), (b["end"] + c["at"]).alias("end")))
        return F.struct(moved.alias("base"), F.concat(seeds, others).alias("seen"))

    return let(F.concat(c["before"], c["body"], c["after"]), lambda around: let(F.length(c["before"]), lambda lead: let(base_spans(c["body"]), lambda base: found(around, lead, base))))


def with_spans(docs: DataFrame, params: PiiParams, key: list[Column]) -> DataFrame:
    """key columns, base (all base spans) and seen (all values with their patterns)."""
    out = docs.select(*key, chunks(text_or_empty(), params.context).alias("_lw_chunks"))
    out = out.withColumn("_lw_of", F.transform("_lw_chunks", lambda c, i: of_chunk(c, i, params))).drop("_lw_chunks")
    part = lambda name, kind: F.coalesce(F.flatten(F.transform("_lw_of", lambda x: x[name])), none_of(kind))
    return out.withColumns({"base": part("base", SPAN), "seen": part("seen", SEEN)}).drop("_lw_of")


def fits(kind: Column, value: Column) -> Column:
    """Whether an unknown value has a shape that the kind can take."""
    n, number = F.length(digits(value)), F.regexp(value, F.lit(r"^[+(]*[0-9][0-9().\x20-]*$"))
    secret = F.regexp(value, F.lit(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9._%+:-]{16,}$"))
    shapes = [F.contains(value, F.lit("@")), F.regexp(value, F.lit(r"^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,7}$")), number & n.between(12, 19), number & n.between(7, 15), secret]
    out = F.lit(False)
    for k, shape in enumerate(shapes):
        out = F.when(kind == k, shape).otherwise(out)
    return out


def could_be(value: Column) -> Column:
    """Whether a value fits any kind."""
    return F.coalesce(*[F.when(fits(F.lit(k), value), True) for k in range(len(ALL_KINDS))], F.lit(False))


def scores(edges: DataFrame, rounds: int) -> DataFrame:
    """(pattern, k, score) after so many rounds over edges (pattern, k, value, r): r is null for free values, which start at zero."""
    values = None
    for _ in range(rounds):
        rated = edges.withColumn("_now", F.coalesce("r", F.lit(0.0))) if values is None else edges.join(values, ["k", "value"], "left").withColumn("_now", F.coalesce("r", "s", F.lit(0.0)))
        patterns = rated.groupBy("pattern", "k").agg((F.sum("_now") / (F.count("*") + 0.5)).alias("score"))
        values = edges.where("r is null").join(patterns, ["pattern", "k"]).groupBy("k", "value").agg(F.avg("score").alias("s"))
    return patterns


def reliable_patterns(seen: DataFrame, params: PiiParams) -> DataFrame | None:
    """(pattern, k, score) of the patterns to trust, from (rid, kind, value, pattern): generations of patterns from seeds and seeds from patterns."""
    seeds = seen.where("kind is not null").select(F.col("kind").alias("k"), "value").distinct()
    of_kind = seeds.groupBy("value").agg(F.collect_set("k").alias("kinds"))  # at most as many as there are kinds
    trusted, many = None, -1
    for _ in range(params.generations):
        held = seen.select("rid", "pattern", "value").join(seeds, "value").groupBy("pattern", "k").agg(F.count_distinct("value").alias("v"), F.count_distinct("rid").alias("d"))
        strong = materialize(held.where((F.col("v") >= params.least_seeds) & (F.col("d") >= params.least_seeds)).select("pattern", "k"), "pii-patterns")
        if not strong.limit(1).count():
            return trusted
        edges = seen.select("pattern", "value").distinct().join(broadcast_if_small(strong), "pattern")
        known = seeds.select("k", "value", F.lit(True).alias("seed"))
        edges = edges.join(known, ["k", "value"], "left").join(of_kind, "value", "left")
        r = F.when(F.col("seed"), 1.0).when(F.col("kinds").isNotNull() | ~fits(F.col("k"), F.col("value")), 0.0)
        edges = materialize(edges.select("pattern", "k", "value", r.alias("r")), "pii-graph")
        trusted = materialize(scores(edges, params.rounds).where(F.col("score") >= params.least_score), "pii-scores")
        found = edges.where("r is null").join(broadcast_if_small(trusted.select("pattern", "k")), ["pattern", "k"], "left_semi").select("k", "value")
        seeds = materialize(seeds.unionByName(found).distinct(), "pii-seeds")
        if (now := seeds.count()) == many:
            break
        many = now
    return trusted


def discovered(slim: DataFrame, params: PiiParams, key: list[str]) -> DataFrame | None:
    """Key columns and _lw_found: the spans that trusted patterns add, as arrays by chunk; None if there are none."""
    seen = slim.where(F.size("seen") > 0).select(*key, F.explode("seen").alias("o")).select(*key, "o.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    rid = F.col(key[0]) if len(key) == 1 else F.xxhash64(*key)
    seen = materialize(seen.withColumn("rid", rid) if key != ["rid"] else seen, "pii-seen")
    trusted = reliable_patterns(seen.select("rid", "kind", "value", "pattern"), params)
    if trusted is None or not trusted.limit(1).count():
        return None
    loose = seen.where(f"kind is null or kind = {SECRET}").join(broadcast_if_small(trusted), "pattern").where(fits(F.col("k"), F.col("value")))
    spans = loose.groupBy(*key, "chunk", "start", "end").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("kind"))
    spans = spans.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = spans.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("chunk", "spans"))).alias("_lw_found"))
    return materialize(spans, "pii-found")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@tidy
def find(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row."""
    slim = materialize(with_spans(docs, params, [F.col("doc_id"), F.monotonically_increasing_id().alias("rid")]), "pii-rows")
    more = discovered(slim, params, ["rid"])
    out, every = slim.select("doc_id", "rid", "base"), F.col("base")
    if more is not None:
        out = out.join(more, "rid", "left")
        every = F.array_sort(F.concat("base", F.coalesce(F.flatten(F.map_values("_lw_found")), none_of(SPAN))))
    out = out.withColumn("_lw_every", every)
    n = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return out.select("doc_id", *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_lw_every")).alias("spans"), F.size("_lw_every").cast("long").alias("n_spans"))


def redacted(body: Column, spans: Column) -> Column:
    """body with each span replaced by its kind in brackets, overlapping ones by the first's."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def add(acc: Column, s: Column) -> Column:
        covered = s["start"] < acc["at"]
        piece = F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))


@tidy
def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets (overlapping spans by the first's); n_chars, if there, follows. A null text stays null."""
    key = [F.col("doc_id").alias("_lw_doc"), F.xxhash64("text").alias("_lw_text")]
    slim = materialize(with_spans(docs, params, key), "pii-rows")
    more = discovered(slim, params, ["_lw_doc", "_lw_text"])
    rows, text = docs, F.col("text")
    own = lambda c, i: base_spans(c["body"])
    if more is not None:
        rows = docs.withColumns({"_lw_d": F.col("doc_id"), "_lw_t": F.xxhash64("text")}).join(more, F.col("_lw_d").eqNullSafe(F.col("_lw_doc")) & (F.col("_lw_t") == F.col("_lw_text")), "left")
        here = lambda c, i: F.transform(F.coalesce(F.try_element_at("_lw_found", i), none_of(SPAN)), lambda s: F.struct((s["start"] - c["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] - c["at"]).alias("end")))
        own = lambda c, i: F.array_sort(F.concat(base_spans(c["body"]), here(c, i)))
    one = lambda c, i: let(own(c, i), lambda spans: F.struct(F.size(spans).alias("n"), redacted(c["body"], spans).alias("text")))
    rows = rows.withColumn("_lw_parts", F.transform(chunks(F.coalesce(text, F.lit("")), params.context), one))
    changed = F.exists("_lw_parts", lambda x: x["n"] > 0)
    rows = rows.withColumn("text", F.when(changed, F.array_join(F.transform("_lw_parts", lambda x: x["text"]), "")).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """What op5 returns."""
    return find(docs)
