"""Jaccard self-join on word n-grams with adaptive multi-match prefixes.

A document is the set of its distinct n-grams in one global order, rare before frequent. Two sets with
Jaccard similarity t or more share at least l of their first |x| - ceil(t|x|) + l elements, for any l up
to ceil(t|x|). Each document picks its own l: a longer prefix scans more lists but demands more shared
elements, so l is the one whose estimated cost, lists scanned plus candidates to verify, is least. A
pair is a candidate if the chosen prefixes share min(l, l') elements and what stands before their first
shared lists leaves room for the overlap; candidates are verified exactly.

Only links between components matter for the classes, so pairs are sought in two steps. First each
document is a candidate with one document of those it shares most lists with. Then, in lists whose
documents are not yet of one component, every document outside the list's largest component meets the
others, unless already connected. Both steps make the same demand of a pair before it is verified. No pair that could join two components is left out, and a group of m
near copies takes about m verifications, not m * m. Equal sets stand for each other from the start.

The order is by the number of documents, counted over all of them, so the n-grams that an edit has made
come first and lists stay short. Any order gives the same result. A block of documents sends each of its
n-grams once, with the number of its documents, so that one of all documents is an entry for each block.

Defined cases: words are runs of anything but ASCII white space, A-Z lower-cased; with fewer words than
n, the whole sequence is the one n-gram; a null or wordless text is an empty set and links with nothing;
rows that repeat are documents of their own with the same class; ids are integers, null is one that comes
after all others, and an id that repeats with other texts is several documents; an empty table gives no
rows. n-grams are compared by 64-bit hashes (48 bits in the order, which verification follows); sets and
texts that stand for each other agree in 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, partitions_for, tidy
from .packed import by_key, packed, planes, rows_of, runs, unplaned


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    #: Least Jaccard similarity, as a fraction.
    numerator: int = 8
    denominator: int = 10
    #: Longest multi-match prefix: shared elements demanded at most.
    matches: int = 3
    #: Cost of verifying a candidate, in list entries.
    verify_cost: int = 40
    #: Narrow rows up to which a side of ids is broadcast, after a count.
    broadcast_ids: int = 500_000

    def least_overlap(self, n):
        return -(-self.numerator * n // self.denominator)


MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
REMEMBERED = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(text: bytes, k: int, known: Words) -> np.ndarray:
    """The distinct n-grams' hashes, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    grams = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        grams = mix(grams * MIX3 + h[i : len(h) - k + 1 + i])
    return np.unique(grams)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    n = np.uint64(len(grams))
    sums = [mix(np.array([(mix(grams + np.uint64(s))).sum(dtype=np.uint64) + n])).view(np.int64)[0] for s in (11, 1_000_003)]
    return int(sums[0]), int(sums[1])


ENTRIES, DOCUMENTS, SHARED, MANY = 0, 1, 2, 3
BLOB = "bucket long, kind int, block long, a binary, b binary, c binary"
BLOB_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abc")])
#: n-grams in the order are held by so many bits.
BITS = 48
SLICE = 2000
#: Stands for the documents of an n-gram that has several in a block.
SEVERAL = 2**16 - 1
NO_ID = -(2**63)
SETS = "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, alone long, tokens array<long>"


def text_key(seed: int) -> Column:
    """64 bits of a text; two seeds make the 128 by which texts are found again."""
    return F.xxhash64(F.lit(seed), "text")


def same_document(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    """Whether rows have the same id and the same text, by names of (id, t1, t2)."""
    return (F.col(a[1]) == F.col(b[1])) & (F.col(a[2]) == F.col(b[2])) & F.col(a[0]).eqNullSafe(F.col(b[0]))


def sorted_prefixes(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(doc_id, t1, t2, n, k1, k2, alone, tokens) of every row: 128 bits of the text, set size, 128 bits of the set, how many n-grams no other document has, and, in the order, the others as far as any l can ask.

    Every n-gram of a block of documents goes to its bucket once, in packed arrays, with its number of
    documents; there those of two documents or more are summed and go back, the rest stay behind. Which
    documents of the block have an n-gram that several share waits with the block.
    """
    n_parts = partitions_for(docs, "text")
    shift = max(6, (4 * n_parts - 1).bit_length())  # buckets, as many as the partitions ask for, by the leading bits
    kept = np.uint64(64 - BITS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = Words(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, len(whole), SLICE):
                batch, block = whole.slice(lo, SLICE), part << 24 | number
                number += 1
                grams, rows = [], []
                for t in batch.column(1).cast(pa.binary()):
                    g = ngram_set(t.as_buffer().to_pybytes() if t.is_valid else b"", params.words, known)
                    rows.append((len(g), *set_key(g)))
                    grams.append(g >> kept)
                doc = np.repeat(np.arange(len(grams), dtype=np.uint16), [len(g) for g in grams])
                g = np.concatenate(grams)
                order = np.argsort(g, kind="stable")
                g, doc = g[order], doc[order]
                ids = [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
                about = np.array([ids, *(batch.column(k).to_pylist() for k in (2, 3)), *zip(*rows, strict=True)], np.int64)
                out = [(block, DOCUMENTS, block, about.tobytes(), b"", b"")]
                first = runs(g)
                count = np.diff(np.append(first, len(g)))
                many = np.repeat(count > 1, count)
                if many.any():
                    out.append((block, MANY, block, count[count > 1].astype(np.uint16).tobytes(), doc[many].tobytes(), b""))
                g, one = g[first], np.where(count > 1, SEVERAL, doc[first]).astype(np.uint16)
                bucket = (g >> np.uint64(BITS - shift)).astype(np.int64)
                starts = [*runs(bucket), len(g)]
                out += [(int(bucket[i]), ENTRIES, block, planes(np.diff(g[i:j], prepend=np.uint64(0))), one[i:j].tobytes(), count[i:j].astype(np.uint16).tobytes()) for i, j in zip(starts, starts[1:], strict=False)]
                yield packed(out, BLOB_ARROW)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            out = [r for r in rows if r[1] in (DOCUMENTS, MANY)]
            rows = [r for r in rows if r[1] == ENTRIES]
            if rows:
                parts = [np.cumsum(unplaned(r[3])) for r in rows]
                g = np.concatenate(parts)
                doc, count = (np.concatenate([np.frombuffer(r[k], np.uint16) for r in rows]) for k in (4, 5))
                block = np.repeat(np.array([r[2] for r in rows], np.int64), [len(x) for x in parts])
                order = np.argsort(g, kind="stable")
                start = runs(g[order])
                df = np.add.reduceat(count[order].astype(np.int64), start)
                entries = np.diff(np.append(start, len(g)))
                keep = order[np.repeat(df > 1, entries)]
                df = np.minimum(np.repeat(df, entries)[np.repeat(df > 1, entries)], 2**32 - 1).astype(np.uint32)
                out += [(b, SHARED, b, x.tobytes(), d.tobytes(), c.tobytes()) for b, x, d, c in rows_of(block[keep], g[keep], doc[keep], df)]
            if out:
                yield packed(out, BLOB_ARROW)

    names = [c.split()[0] for c in SETS.split(", ")]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            ids, t1, t2, n, k1, k2 = np.frombuffer(next(r[3] for r in rows if r[1] == DOCUMENTS), np.int64).reshape(6, -1)
            shared = [r for r in rows if r[1] == SHARED]
            g, doc, df = (np.concatenate([np.frombuffer(r[k], t) for r in shared]) if shared else np.zeros(0, t) for k, t in ((3, np.uint64), (4, np.uint16), (5, np.uint32)))
            several = doc == SEVERAL
            if several.any():  # as many as wait here, in the order of their n-grams
                count, those = next((np.frombuffer(r[3], np.uint16), np.frombuffer(r[4], np.uint16)) for r in rows if r[1] == MANY)
                order = np.argsort(g[several])
                g = np.concatenate((g[~several], np.repeat(g[several][order], count)))
                df = np.concatenate((df[~several], np.repeat(df[several][order], count)))
                doc = np.concatenate((doc[~several], those))
            order = np.lexsort((g, df, doc))
            g, doc = g[order].view(np.int64), doc[order]
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            alone = n - np.diff(first)
            room = np.maximum(np.where(n > 0, np.minimum(n, n - params.least_overlap(n) + params.matches), 0) - alone, 0)
            take = np.minimum(room, np.diff(first))
            at = np.repeat(first[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)), pa.int32()), pa.array(g[at]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *map(pa.array, (t1, t2, n, k1, k2, alone)), tokens], names=names)

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(1).alias("t1"), text_key(2).alias("t2")).mapInArrow(blocks, BLOB)
    back = sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, BLOB)
    rows = back.repartition(n_parts, "block").sortWithinPartitions("block").select("block", "kind", "block", "a", "b", "c")
    return materialize(rows.toDF("bucket", "kind", "block", "a", "b", "c").mapInArrow(documents, SETS), "join-sets")


def least_overlap(n: Column, params: JoinParams) -> Column:
    return F.ceil(n * params.numerator / F.lit(params.denominator)).cast("long") if params.denominator == 1 else F.floor((n * params.numerator + (params.denominator - 1)) / params.denominator).cast("long")


def overlap_needed(n: Column, m: Column, params: JoinParams) -> Column:
    """Least overlap of sets of n and m elements with the similarity."""
    whole = params.numerator + params.denominator
    return F.floor(((n + m) * params.numerator + (whole - 1)) / whole)


def possible(a: tuple[str, str], b: tuple[str, str], params: JoinParams) -> Column:
    """Whether two sets can have the similarity: (size, place of the first element that any other set has) of each.

    What stands before that place is in no other set, so it bounds the overlap.
    """
    (n, first), (m, other) = ((F.col(x), F.col(y)) for x, y in (a, b))
    need = overlap_needed(n, m, params)
    return (F.least(n, m) * params.denominator >= F.greatest(n, m) * params.numerator) & (F.least(n - first, m - other) >= need)


def verified(pairs: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, from texts (node, text)."""
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, held = Words(), None, None
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(i).cast(pa.binary()) for i in (2, 3)), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, held = x, ngram_set(x, params.words, known)
                other = ngram_set(y, params.words, known)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(common > 0 and params.denominator * common >= params.numerator * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def text_of(docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """(node, text) of the nodes (node, rep): the text of the document that stands for the set, found by its id and 128 bits of it."""
    ids = nodes.select("node", F.col("rep.doc_id").alias("_lw_id"), F.col("rep.t1").alias("_lw_1"), F.col("rep.t2").alias("_lw_2"))
    if ids.limit(params.broadcast_ids + 1).count() <= params.broadcast_ids:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(1).alias("t1"), text_key(2).alias("t2"))
    return rows.join(ids, same_document(("doc_id", "t1", "t2"), ("_lw_id", "_lw_1", "_lw_2"))).select("node", "text").dropDuplicates(["node"])


def enough(params: JoinParams) -> Column:
    """Whether the chosen prefixes of a and b (a_have, b_have, in the order) share as many elements as the prefixes demand.

    The shorter demand counts, and what the prefix that ends first leaves over cannot make up for fewer.
    """
    left = lambda x: least_overlap(F.col(f"{x}_n"), params) - F.col(f"{x}_l")  # noqa: E731  elements behind the chosen prefix
    need = overlap_needed(F.col("a_n"), F.col("b_n"), params)
    return F.size(F.array_intersect("a_have", "b_have")) >= F.greatest(F.least("a_l", "b_l"), need - F.greatest(left("a"), left("b")))


def side(prefixes: DataFrame, x: str) -> DataFrame:
    """prefixes (node, n, first, l, have) with names that begin with x."""
    return prefixes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "first", "l", "have")])


def stars(lists: DataFrame, prefixes: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): each document with one of those that the lists it is in point to, if the chosen prefixes share enough.

    A list points to the set with the fewest elements of its own: the least edited of a family.
    """
    pivots = lists.groupBy("token").agg(F.min(F.struct("first", "node", "n")).alias("p")).select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.first").alias("pf"))
    pivots = materialize(pivots, "join-pivots")  # apart from the join, which can then split a long list
    star = lists.join(pivots, "token").where((F.col("node") != F.col("pivot")) & possible(("n", "first"), ("pn", "pf"), params))
    star = star.groupBy("node", "pivot").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
    star = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return star.join(side(prefixes, "a"), "a").join(side(prefixes, "b"), "b").where(enough(params)).select("a", "b")


def candidates(lists: DataFrame, prefixes: DataFrame, comps: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b) of different components whose chosen prefixes share enough.

    A pair comes up once, in the list of the first element that both have. Its places there bound the
    overlap; so does the number of shared elements plus what the prefix that ends first leaves over.
    """
    rows = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("token", "node", "pos", "comp")
    rows = materialize(rows, "join-lists")
    parts = rows.groupBy("token", "comp").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").drop("mixed")
    rows = rows.join(materialize(mixed, "join-mixed"), "token")
    rows = materialize(rows.join(prefixes, "node"), "join-mixed")
    columns = ("node", "n", "first", "pos", "l", "comp", "have")
    a = rows.where("comp <> most").select("token", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select("token", "most", *[F.col(c).alias(f"b_{c}") for c in columns])
    once = (F.col("b_comp") == F.col("most")) | (F.col("a_node") < F.col("b_node"))
    need = overlap_needed(F.col("a_n"), F.col("b_n"), params)
    at_first = (F.get(F.array_intersect("a_have", "b_have"), F.lit(0)) == F.col("token")) & (F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= need)
    pairs = a.join(b, "token").where((F.col("a_comp") != F.col("b_comp")) & once & possible(("a_n", "a_first"), ("b_n", "b_first"), params) & at_first & enough(params))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def linked(docs: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """sorted_prefixes() of docs, and (k1, k2, n, component, rep) of their sets that are not empty: rep is the first document of the class (by_id), null ids last."""
    sets = sorted_prefixes(docs, params)
    by_id = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2")
    nodes = sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(by_id).alias("rep"), F.first("alone").alias("alone"), F.first("tokens").alias("tokens"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")  # written, so the numbers stay
    tokens = nodes.select("node", "n", "alone", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("alone")).drop("alone")
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "join-tokens")
    lists = materialize(tokens.join(shared, "token"), "join-shared")
    need = least_overlap(F.col("n"), params)
    scan = lambda k: F.sum(F.when(F.col("pos") < F.col("n") - need + k, F.col("df") - 1).otherwise(0))
    costs = lists.groupBy("node", "n").agg(F.min("pos").cast("long").alias("first"), *[scan(k).alias(f"s{k}") for k in range(1, params.matches + 1)])
    cost = lambda k: F.when(need >= k, F.col(f"s{k}") + F.col(f"s{k}") * params.verify_cost / F.lit(k))
    best = F.array_min(F.array(*[F.struct(F.coalesce(cost(k), F.lit(float("inf"))).alias("cost"), F.lit(k).alias("l")) for k in range(1, params.matches + 1)]))["l"]
    chosen = costs.select("node", "first", best.alias("l"))
    lists = materialize(lists.join(chosen, "node").where(F.col("pos") < F.col("n") - need + F.col("l")).select("token", "node", "n", "first", "pos", "l"), "join-chosen")
    have = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    prefixes = materialize(lists.groupBy("node", "n", "first", "l").agg(have.alias("have")), "join-prefixes")

    star = materialize(stars(lists, prefixes, params), "join-star")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = materialize(text_of(docs, ends(star).join(nodes.select("node", "rep"), "node"), params), "join-texts")
    edges = materialize(verified(star, texts, params), "join-links")
    comps = components(edges, "join-components")
    more = materialize(candidates(lists, prefixes, comps, params), "join-candidates")
    if more.limit(1).count():
        new = ends(more).join(texts.select("node"), "node", "left_anti").join(nodes.select("node", "rep"), "node")
        texts = texts.unionByName(materialize(text_of(docs, new, params), "join-texts"))
        edges = edges.unionByName(materialize(verified(more, texts, params), "join-links"))
        comps = components(edges, "join-components")
    found = nodes.select("node", "k1", "k2", "n", "rep").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = materialize(found, "join-classes")
    least = found.groupBy("component").agg(F.min("rep").alias("rep"))
    return sets, found.drop("rep").join(least, "component").select("k1", "k2", "n", "component", "rep")


@tidy
def classes(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); component_id is null for a class without ids."""
    sets, named = linked(docs, params)
    named = named.select("k1", "k2", "n", F.col("rep.doc_id").alias("component_id"), F.lit(True).alias("_lw_known"))
    out = sets.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_lw_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@tidy
def keep_one(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One row of each class, that of the least doc_id (null comes last); columns unchanged.

    Of rows without words all stay. Rows that are equal in id and text count once.
    """
    sets, named = linked(docs, params)
    key = ("doc_id", "t1", "t2")
    chosen = named.select("rep.*").select(*key).distinct().unionByName(sets.where("n = 0").select(*key).distinct())
    again = materialize(sets.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key), "join-repeats")
    mine, theirs = ("_lw_doc", "_lw_1", "_lw_2"), ("_lw_a", "_lw_b", "_lw_c")
    on = same_document(mine, theirs)
    keep = docs.withColumns(dict(zip(mine, (F.col("doc_id").cast("long"), text_key(1), text_key(2)), strict=True))).join(materialize(chosen, "join-chosen").toDF(*theirs), on, "left_semi")
    if again.limit(1).count():
        again = again.toDF(*theirs)
        again = F.broadcast(again) if again.limit(params.broadcast_ids + 1).count() <= params.broadcast_ids else again
        keep = keep.join(again, on, "left_anti").unionByName(keep.join(again, on, "left_semi").dropDuplicates(list(mine)))
    return keep.select(*docs.columns)


#: What the contract of op4 asks for.
CONTRACT = JoinParams(words=3, numerator=90, denominator=100)


def digest(docs: DataFrame) -> DataFrame:
    """What op4 returns: three-word n-grams, similarity 0.9."""
    return classes(docs, CONTRACT)


def oracle() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a AS v, b AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v, least(v, min(u)) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.v"""
