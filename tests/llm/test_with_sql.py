"""Operators that SQL can express, over the awkward rows and the driver's tables."""

from __future__ import annotations

import random

import pytest
from harness import TABLES, of_duckdb, of_spark

from lodeworks.llm import embed_dedup, mixing, ngram_join, quality, queries


@pytest.mark.parametrize("operator", [quality, mixing, ngram_join])
def test_awkward_rows(docs, none, operator):
    if operator is not quality:  # rows of one id are told apart by row, the SQL joins by id
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert of_spark(operator.digest(docs)) == of_duckdb(operator.oracle(), {"documents": docs})
    assert operator.digest(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_driver_tables(spark, data, name):
    found = of_spark(queries.queries()[name](spark, data))
    assert found == of_duckdb(queries.oracle_sql()[name], {t: f"{data}/{t}.parquet" for t in TABLES})


def test_vectors(spark):
    rng, rows = random.Random(3), []
    for c in range(6):
        centre = [rng.gauss(0, 1) for _ in range(20)]
        rows += [(len(rows) + k, [x + rng.gauss(0, 0.12) for x in centre], c % 2) for k in range(25)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * 20, 1), (1005, [float("nan")] * 20, 1), (1006, [], 1), (1007, [None, 1.0], 1), (1008, [3.0, 4.0], 1), (1009, [6.0, 8.0], 1), (1010, [float("inf")] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = of_duckdb(embed_dedup.oracle(), {"embeddings": df})
    assert of_spark(embed_dedup.digest(df)) == want
    assert of_spark(embed_dedup.link_vectors(df, embed_dedup.EmbedParams(block=3))) == want
    clash = df.withColumns({c: df["vec_id"] for c in ("id", "n", "unit", "code", "component_id")})
    assert of_spark(embed_dedup.link_vectors(clash, embed_dedup.EmbedParams(block=7, rows=4))) == want
    assert embed_dedup.digest(df.limit(0)).count() == 0


def test_vectors_without_id(spark):
    """A null id never names a class that has an id; a class without ids is kept whole."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a, 1), (4, a, 1), (9, [1.0, 0.01, 0.0], 1), (None, b, 1), (None, [0.01, 1.0, 0.0], 1), (None, c, 1), (None, None, 1), (2, c, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.digest(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (9, 2, 4, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True), (2, 0, 2, True)], key=str)


def test_dense_family_of_vectors(spark):
    """Many near copies in blocks smaller than their buckets: counts and classes as by all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 32))
    x = np.repeat(base, (300, 40, 5), axis=0) + rng.normal(size=(345, 32)) * 0.11
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for block in (16, 2048):
        got = {r["vec_id"]: r["n_links"] for r in embed_dedup.link_vectors(df, embed_dedup.EmbedParams(block=block, rows=8)).collect()}
        found, all_links = sum(got.values()), int(close.sum()) - len(x)
        assert all(got[i] <= close[i].sum() - 1 for i in got) and found >= 0.99 * all_links


def test_recall_of_hashing(spark):
    """Random pairs at the threshold, where hashes collide least."""
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * n
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate((a, b)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = embed_dedup.digest(df).where("n_links > 0").count()
    assert linked >= 0.99 * len(rows)


def test_quality_keeps_rows_whole(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.digest(docs).where("kept").count()


def test_join_by_five_words(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and not {6, 7, 8} & set(ids) and ids.count(5) == 1 and {10, 12, 13} <= set(ids)


def test_rows_without_id_are_linked(spark):
    """Near and exact copies among rows without id, a class that such a row bridges, and one that an id names."""
    word = lambda c, edits: " ".join(f"{c}edit{j}" if j in edits else f"{c}{j}" for j in range(200))
    rows = [(None, word("a", ())), (None, word("a", (50,)))] + [(None, word("b", ()))] * 30 + [(1, word("c", ())), (None, word("c", (20, 50, 80))), (2, word("c", (20, 50, 80, 110, 140, 170)))]
    rows += [(None, word("d", ())), (3, word("d", (90,))), (None, None), (None, None), (None, ""), (4, word("e", ()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    params = ngram_join.JoinParams(words=5, numerator=8, denominator=10)
    found = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.classes(df, params).where("doc_id is not null").collect())
    assert found == [(1, 1), (2, 1), (3, 3), (4, 4)]
    kept = ngram_join.keep_one(df, params).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4]
    nameless = [r["text"] for r in kept if r["doc_id"] is None]
    assert sorted((t or "")[:1] for t in nameless) == ["", "", "a", "b"]


def test_mixed_rows(docs):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    plan = mixing.digest(docs)
    for r in plan.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert r["sum(taken)"] <= 2 * r["source_size"]
    assert mixed.groupBy("doc_id", "text").count().where("count > 6").count() == 0
    assert sorted(map(tuple, mixing.digest(docs).select("doc_id", "taken").collect()), key=str) == sorted(map(tuple, plan.select("doc_id", "taken").collect()), key=str)


@pytest.mark.parametrize("repeats", [1, 2, 3])
def test_mixing_with_other_parameters(docs, repeats):
    params = mixing.MixParams(share=0.9 * repeats, max_repeats=repeats, fine_from=1)
    plan = mixing.plan_mix(docs, params).collect()
    coarse = mixing.plan_mix(docs, mixing.MixParams(share=0.9 * repeats, max_repeats=repeats)).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, coarse), key=str)
    for source in {r["source"] for r in plan}:
        rows = [r for r in plan if r["source"] == source]
        assert all(r["taken"] <= repeats * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    mixed = mixing.mix_documents(docs, params)
    assert mixed.columns == docs.columns
    whole = {r["doc_id"] for r in plan if r["size"] and r["taken"] == repeats * r["size"]}
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(times[i] >= repeats for i in whole)


def test_chain_of_links(spark):
    """A family of near copies, each linked with its neighbours only: one class, whichever pairs are verified."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):
        w = list(words)
        for j in range(k):
            w[j * 13] = f"edit{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.classes(df, ngram_join.JoinParams(words=3, numerator=95, denominator=100)).select("component_id").distinct().collect()
    assert [r[0] for r in found] == [0]
