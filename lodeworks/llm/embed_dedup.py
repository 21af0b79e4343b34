"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates a unit vector by three rounds of random signs and fast Hadamard transforms and takes
the nearest vertex of the cross-polytope: the largest coordinate and its sign. A bucket of a table joins
two such hashes with the label. Each vector lies in one bucket of a table and also probes those next
nearest. Identical vectors stand for each other; buckets of one vector are dropped before vectors are
shipped. Large buckets are cut into blocks, and each pair of blocks is a unit of work, so no task gets a
bucket whole. Inside a unit all pairs are verified by cosine in double precision, and each pair is
counted in the first bucket that both share. Vectors with one bucket in the first table are counted there:
later buckets of only such vectors are dropped, and a large group of them in a later bucket has blocks of
its own that meet the others', but not each other. Units return counts and a spanning forest, not pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and those without
label, link with nothing; lengths must be equal; repeated rows are vectors of their own and link if they
can; a null vec_id is a vector like others and never names a class that has an id; rows of a class without
ids have component_id null and are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, shuffle_partitions, tidy


@dataclass(frozen=True)
class EmbedParams:
    cosine: float = 0.98
    tables: int = 8
    #: Buckets beside its own in which a vector looks, in each table.
    probes: int = 4
    #: Vectors of a bucket in a block.
    block: int = 2048
    #: Vectors that are compared with a block at once.
    rows: int = 512
    seed: int = 7


@functools.cache
def signs(dim: int, seed: int, table: int) -> np.ndarray:
    """Random signs of two rotations of three rounds each, over the next power of two."""
    return np.random.Generator(np.random.PCG64([seed, table, dim])).choice([-1.0, 1.0], size=(2, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, to scale."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray, params: EmbedParams) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket numbers: own bucket first, then the next nearest."""
    n, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    out = np.zeros((n, params.tables, 1 + params.probes), np.int64)
    near = min(3, size)
    for t in range(params.tables):
        vertex, lost = [], []
        for rounds in signs(size, params.seed, t):
            y = padded
            for s in rounds:
                y = hadamard(y * s)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            vertex.append(2 * top + (value < 0))
            lost.append(np.abs(value[:, :1]) - np.abs(value))
        cost = (lost[0][:, :, None] + lost[1][:, None, :]).reshape(n, -1)
        code = (vertex[0][:, :, None] * 2 * size + vertex[1][:, None, :]).reshape(n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + params.probes]
        out[:, t, : order.shape[1]] = np.take_along_axis(code, order, 1)
        out[:, t, order.shape[1] :] = out[:, t, :1]
    return out


def hashed(vectors: DataFrame, params: EmbedParams) -> DataFrame:
    """(id, n, label, unit, codes) of (id, n, label, embedding): the unit vector and the bucket numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(offsets)
            units, bins = [None] * len(sizes), [None] * len(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                c = codes(x, params)
                for i, v, b in zip(at, x, c, strict=True):
                    units[i], bins[i] = v.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(units, pa.binary()), pa.array(bins, pa.binary())], names=["id", "n", "label", "unit", "codes"])

    return vectors.select("id", "n", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "id long, n long, label string, unit binary, codes binary")


def buckets(hashes: DataFrame, params: EmbedParams) -> DataFrame:
    """(table, code, label, dim, id, own, home, second) of every bucket in which a vector lies or looks; home and second are its own ones in the first two tables."""
    width = 1 + params.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            dims = np.array(batch.column(2).to_pylist(), np.int64)
            c = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, params.tables, width)
            fresh = np.ones(c.shape, bool)
            for p in range(1, width):
                fresh[:, :, p] = (c[:, :, p : p + 1] != c[:, :, :p]).all(2)
            row, table, probe = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table, pa.int64()), pa.array(c[row, table, probe]), labels.take(pa.array(row)), pa.array(dims[row]), ids.take(pa.array(row)), pa.array((probe == 0).astype(np.int64)), pa.array(c[row, 0, 0]), pa.array(c[row, min(1, params.tables - 1), 0])],
                names=["table", "code", "label", "dim", "id", "own", "home", "second"],
            )

    return hashes.select("id", "label", F.octet_length("unit").alias("dim"), "codes").mapInArrow(run, "table long, code long, label string, dim long, id long, own long, home long, second long")


def work(where: DataFrame, params: EmbedParams) -> DataFrame:
    """(table, code, label, dim, i, j, id, side): the units i, j of blocks of each bucket and the vectors that they compare; side is the vector's block."""
    key = ["table", "code", "label", "dim"]
    groups = where.groupBy(*key, "home").agg(F.count("*").alias("c"), F.sum("own").alias("o"), F.min("second").alias("s0"), F.max("second").alias("s1"))
    large = F.collect_list(F.when(F.col("c") > params.block, F.struct("home", F.ceil(F.col("c") / params.block).cast("int").alias("n"))))
    shared = groups.groupBy(*key).agg(F.sum("c").alias("m"), F.sum("o").alias("owners"), F.count("*").alias("homes"), F.min("s0").alias("s0"), F.max("s1").alias("s1"), large.alias("large"), F.sum(F.when(F.col("c") <= params.block, F.col("c"))).alias("rest"))
    done = ((F.col("table") > 0) & (F.col("homes") == 1)) | ((F.col("table") > 1) & (F.col("s0") == F.col("s1")))  # all pairs were counted in an earlier table
    shared = shared.where((F.col("m") > 1) & (F.col("owners") > 0) & ~done)
    block = lambda home, i: F.struct(home.alias("home"), i.cast("int").alias("i"))
    of_large = F.flatten(F.transform("large", lambda g: F.transform(F.sequence(F.lit(1), g["n"]), lambda i: block(g["home"], i))))
    n_rest = F.ceil(F.coalesce("rest", F.lit(0)) / params.block).cast("int")
    none = F.lit(None).cast("long")
    of_rest = F.when(n_rest > 0, F.transform(F.sequence(F.lit(1), n_rest), lambda i: block(none, i)))
    blocks = F.concat(of_large, F.coalesce(of_rest, F.array().cast("array<struct<home:bigint,i:int>>")))
    shared = materialize(shared.select(*key, "large", n_rest.alias("n_rest"), blocks.alias("blocks")), "embed-shared")  # apart from the join, which can then split a large bucket
    turn = lambda n: F.pmod(F.xxhash64("id"), n).cast("int") + 1
    mine = F.get(F.filter("large", lambda g: g["home"] == F.col("home")), F.lit(0))
    rows = where.join(shared, key).withColumn("mine", mine)
    rows = rows.withColumn("mine", F.when(F.col("mine").isNotNull(), block(F.col("home"), turn(F.col("mine.n")))).otherwise(block(none, turn(F.col("n_rest")))))
    meets = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda p: ~F.coalesce((F.col("table") > 0) & (F.get("blocks", p)["home"] == F.col("mine.home")), F.lit(False)))
    rows = rows.select(*key, "id", (F.array_position("blocks", F.col("mine")) - 1).cast("int").alias("side"), F.explode(meets).alias("other"))
    return rows.select(*key, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "side")


def first_shared(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether (table, code) is the bucket in which pairs with bucket numbers a and b (pairs, tables, 1 + probes) count.

    Two vectors share a table if the own bucket of one is the own or a probed one of the other; they
    count in the first such table, there in the least such bucket.
    """
    a_in_b = (b == a[:, :, :1]).any(2)
    b_in_a = (a == b[:, :, :1]).any(2)
    earlier = (a_in_b | b_in_a)[:, :table].any(1)
    own_a, own_b = a[:, table, 0], b[:, table, 0]
    at_a, at_b = a_in_b[:, table], b_in_a[:, table]
    least = np.where(at_a & at_b, np.minimum(own_a, own_b), np.where(at_a, own_a, own_b))
    return ~earlier & (least == code)


def forest(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The least member of each member's component under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(units: DataFrame, params: EmbedParams) -> DataFrame:
    """(a, b, links) of sorted units: links of vector a (b null), or an edge a-b of a spanning forest (links null)."""
    width = 1 + params.probes

    def unit(table: int, code: int, i: int, j: int, ids, ns, side, vec, cod) -> tuple[list, list, list]:
        order = np.lexsort((ids, side))
        ids, ns, side = ids[order], ns[order], side[order]
        x = np.frombuffer(b"".join(vec[k] for k in order), np.float64).reshape(len(ids), -1)
        c = np.frombuffer(b"".join(cod[k] for k in order), np.int64).reshape(len(ids), params.tables, width)
        own = c[:, table, 0] == code
        edge = int(np.searchsorted(side, j)) if i != j else None  # the second block starts here
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        stop = len(ids) if edge is None else edge
        for lo in range(0, stop, params.rows):  # some rows with all after them, or with the other block
            hi, at = min(lo + params.rows, stop), lo if edge is None else edge
            close = (x[lo:hi] @ x[at:].T >= params.cosine) & (own[lo:hi, None] | own[None, at:])
            p, q = np.nonzero(np.triu(close, 1) if edge is None else close)
            p, q = p + lo, q + at
            for some in range(0, len(p), 1 << 18):
                a, b = p[some : some + (1 << 18)], q[some : some + (1 << 18)]
                once = first_shared(c[a], c[b], table, code)
                a, b = a[once], b[once]
                links += np.bincount(a, ns[b], len(ids)).astype(np.int64) + np.bincount(b, ns[a], len(ids)).astype(np.int64)
                root = forest(np.append(a, np.arange(len(ids))), np.append(b, root), len(ids))
        has, down = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return [*ids[has], *ids[down]], [*[None] * len(has), *ids[root[down]]], [*links[has], *[None] * len(down)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done():
            cols = [np.array(c) for c in list(zip(*rows, strict=True))[:3]]
            a, b, n = unit(*key, *cols, [r[3] for r in rows], [r[4] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "links"])

        for batch in batches:
            for t, c, _, _, i, j, *row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (now := (t, c, i, j)) != key or row[-1] != label:
                    if len(rows) > 1:
                        yield done()
                    key, label, rows = now, row[-1], []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    names = ["table", "code", "label", "dim", "i", "j", "id", "n", "side", "unit", "codes"]
    return units.select(*names, F.concat_ws("|", "label", "dim").alias("_same")).mapInArrow(run, "a long, b long, links long")


@tidy
def link_vectors(vectors: DataFrame, params: EmbedParams = EmbedParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = materialize(vectors.select("vec_id", "label", F.when(usable, e).alias("embedding")), "embed-rows")
    good = rows.where("embedding is not null")
    same = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    same = materialize(same.withColumn("id", F.monotonically_increasing_id()), "embed-distinct")  # written, so the numbers stay
    hashes = materialize(hashed(same, params), "embed-hashes")
    where = materialize(buckets(hashes, params), "embed-buckets")
    key = ["table", "code", "label", "dim", "i", "j"]
    units = work(where, params).join(hashes.select("id", "n", "unit", "codes"), "id")
    units = units.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    found = materialize(verified(units, params), "embed-found")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comps = components(found.where("b is not null").select("a", "b"), "embed-components").withColumnRenamed("node", "id")
    ids = same.join(links, "id", "left").join(comps, "id", "left")
    ids = materialize(ids.select("label", "embedding", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "embed-result")
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.drop("least").join(least, "component")
    out = good.join(ids, ["label", "embedding"]).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = out.unionByName(rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def digest(vectors: DataFrame) -> DataFrame:
    """What op2 returns."""
    return link_vectors(vectors)


def oracle(cosine: float = 0.98) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= {cosine}),
r AS (SELECT a AS v, b AS w FROM p UNION SELECT r.v, p.b FROM r JOIN p ON r.w = p.a),
c AS (SELECT v, least(v, min(w)) AS c FROM r GROUP BY v),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON vec_id = a LEFT JOIN c ON vec_id = v"""
