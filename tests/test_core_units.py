"""Operators on rows that can be checked by hand, and against other ways to compute the same."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import cluster, explore, graph, itemsets, recommend, sampling, similarity, sketch
from lodeworks.operators.components import components
from lodeworks.sources import readers, writers
from lodeworks.streaming import queries as streams


def test_words_keep_what_the_stop_test_misses(spark):
    texts = spark.createDataFrame([("The the, cat\nsat  [cat] cat.",)], "text string")
    stop = spark.createDataFrame([("the",)], "word string")
    got = {r["word"]: r["n"] for r in explore.word_counts(texts, stop).collect()}
    assert got == {"the": 1, "cat\nsat": 1, "cat": 2}


def test_categories_are_weighted_by_reviews(spark):
    reviews = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 4.0), (3, 2.0)], "business_id long, stars double")
    business = spark.createDataFrame([(1, "A, B"), (2, ""), (3, " B ,A"), (4, None)], "business_id long, categories string")
    got = [(r["category"], r["stars"]) for r in explore.top_categories(reviews, business).collect()]
    assert got == [("A", pytest.approx(8 / 3)), ("B", pytest.approx(8 / 3))]


def test_partition_report_shows_empty_partitions(spark):
    df = spark.range(10).select((F.col("id") * 3).alias("k"))
    got = sorted((r["part"], r["n_items"]) for r in explore.partition_report(df, 6, F.col("k")).collect())
    assert got == [(0, 5), (1, 0), (2, 0), (3, 5), (4, 0), (5, 0)]
    assert sum(r["n_items"] for r in explore.partition_report(df.repartition(3), 0).collect()) == 10


BASKETS = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (3, "c"), (4, "a"), (4, "d")]


def test_itemsets_of_all_sizes(spark):
    long = itemsets.baskets(spark.createDataFrame(BASKETS, "b long, i string"), "b", "i")
    want = {("a",): 4, ("b",): 3, ("c",): 3, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3, ("a", "b", "c"): 3}
    for found in (itemsets.mine(long, 3), itemsets.fp_growth(long, 3), itemsets.two_phase(long, 3, 2)):
        assert {tuple(r["items"]): r["n"] for r in found.collect()} == want
    assert [r["n"] for r in itemsets.agreement(itemsets.mine(long, 3), itemsets.fp_growth(long, 3)).collect()] == [7, 7, 7]
    assert [r["value"] for r in writers.itemset_report(itemsets.mine(long, 3)).collect()][2] == "('a', 'b', 'c')"


def test_fp_growth_keeps_sets_at_the_threshold(spark):
    long = spark.createDataFrame([(b, "x") for b in range(7)] + [(b, "y") for b in range(25)], "basket long, item string")
    assert {tuple(r["items"]): r["n"] for r in itemsets.fp_growth(long, 7).collect()} == {("x",): 7, ("y",): 25, ("x", "y"): 7}


def test_jaccard_and_precision(spark):
    m = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2), ("r", 2), ("r", 3), ("s", 9)], "id string, idx long")
    got = {(r["a"], r["b"]): r["sim"] for r in similarity.jaccard_pairs(m).collect()}
    assert got == {("p", "q"): 1.0, ("p", "r"): pytest.approx(1 / 3), ("q", "r"): pytest.approx(1 / 3)}
    sigs = similarity.signatures(m, 10)
    found = similarity.verified(similarity.candidate_pairs(similarity.bands(sigs)), m)
    assert {(r["a"], r["b"]) for r in found.collect()} <= set(got)
    pr = similarity.precision_recall(found, similarity.jaccard_pairs(m)).first()
    assert pr["precision"] == 1.0
    assert similarity.precision_recall(found.limit(0), found).first()["precision"] is None


def test_pearson_needs_variance_and_common_raters(spark):
    rows = [(u, b, s) for b, stars in (("x", (1, 2, 3)), ("y", (2, 4, 5)), ("z", (3, 2, 1)), ("c", (4, 4, 4)), ("f", (1, 2))) for u, s in enumerate(stars)]
    model = recommend.item_model(spark.createDataFrame(rows, "user_id long, business_id string, stars long"))
    got = [(r["b1"], r["b2"], r["sim"]) for r in model.collect()]
    assert got == [("x", "y", pytest.approx(0.981980506))]


def test_prediction_falls_back(spark):
    ratings = spark.createDataFrame([(1, "x", 4.0), (2, "y", 2.0)], "user_id long, business_id string, stars double")
    model = spark.createDataFrame([("x", "z", 0.5)], "b1 string, b2 string, sim double")
    pairs = spark.createDataFrame([(1, "z"), (1, "z"), (2, "x"), (1, "new"), (9, "x")], "user_id long, business_id string")
    got = {(r["user_id"], r["business_id"]): r["stars"] for r in recommend.predict_by_items(pairs, ratings, model, recommend.business_average(ratings)).collect()}
    assert got == {(1, "z"): 4.0, (2, "x"): 4.0, (1, "new"): 0.0}


def graph_of(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


BARBELL = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def test_betweenness_both_ways(spark):
    path = graph_of(spark, [(1, 2), (2, 3), (3, 4)])
    assert {(r["u"], r["v"]): r["betweenness"] for r in graph.betweenness(path).collect()} == {(1, 2): 3.0, (2, 3): 4.0, (3, 4): 3.0}
    bar = graph_of(spark, BARBELL)
    a, b = ({(r["u"], r["v"]): r["betweenness"] for r in f(bar).collect()} for f in (graph.betweenness, graph.betweenness_by_joins))
    assert a == b and a[(3, 4)] == 9.0


def test_girvan_newman_both_ways(spark):
    bar = graph_of(spark, BARBELL)
    for small in (100, 0):
        assert [r["members"] for r in graph.girvan_newman(bar, small).collect()] == [[1, 2, 3], [4, 5, 6]]


def test_modularity_is_the_double_sum(spark):
    label = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    degree = {v: sum(v in e for e in BARBELL) for v in label}
    m = len(BARBELL)
    total = sum(((i, j) in BARBELL or (j, i) in BARBELL) - degree[i] * degree[j] / (2 * m) for i, j in itertools.product(label, label) if label[i] == label[j])
    got = graph.modularity(graph_of(spark, BARBELL), spark.createDataFrame(list(label.items()), "node long, label long")).first()[0]
    assert got == pytest.approx(total / (2 * m))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(graph_of(spark, chain)).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}
    assert components(graph_of(spark, chain).limit(0)).count() == 0


def test_pair_of_nodes_swaps_labels(spark):
    got = {r["node"]: r["label"] for r in graph.label_propagation(graph_of(spark, [(1, 2)]), 5).collect()}
    assert got == {1: 2, 2: 1}


CITIES = ["Las Vegas", "Montréal", "Saint-Louis-du-Ha!-Ha!-Ville", "", None, "x"]


def number(s: str, m: int) -> int:
    return int(s.encode().hex(), 16) % m


def test_bloom_filter_has_no_false_negatives(spark):
    df = spark.createDataFrame([(c,) for c in CITIES], "city string")
    bits = sketch.bloom_filter(df)
    want = {(a * number(c, 233333333333) + b) % 233333333333 % 7000 for c in CITIES if c for a, b in sketch.BLOOM_HASHES}
    assert {r["bit"] for r in bits.collect()} == want
    got = {r["city"]: r["hit"] for r in sketch.bloom_lookup(df.unionByName(spark.createDataFrame([("elsewhere",)], "city string")), bits).collect()}
    assert got == {"Las Vegas": 1, "Montréal": 1, "Saint-Louis-du-Ha!-Ha!-Ville": 1, "": 0, None: 0, "x": 1, "elsewhere": 0}


def test_distinct_counts_match_python(spark):
    names = [f"city {i}" for i in range(60)]
    rows = [("2024-01-01 00:00:05", n) for n in names] + [("2024-01-01 00:00:05", None), ("2024-01-01 00:00:05", "")]
    df = spark.createDataFrame(rows, "t string, city string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "city")
    zeros = lambda h: len(bin(h)[2:]) - len(bin(h)[2:].rstrip("0"))
    r = [max(zeros((a * number(n, 450) + b) % 450) for n in names) for a, b in sketch.FM_HASHES]
    means = sorted(round(sum(2**x for x in r[g * 5 : g * 5 + 5]) / 5) for g in range(9))
    got = sketch.windowed_counts(df).collect()
    assert len(got) == 3 and {(g["truth"], g["estimate"]) for g in got} == {(60, means[4])}


def test_reservoir_merges(spark):
    events = spark.range(1000).select(F.col("id").alias("event_id"))
    whole = {r[0] for r in sampling.reservoir(events).collect()}
    parts = [sampling.reservoir(events.where(F.col("event_id") % 3 == k)) for k in range(3)]
    merged = sampling.merged(sampling.merged(parts[0], parts[1]), parts[2])
    assert {r[0] for r in merged.collect()} == whole and len(whole) == 100


def test_tiers_keep_ties(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("d", 1), ("e", 1), ("f", 0)], "tag string, n long")
    got = {r["tag"]: r["tier"] for r in sampling.top_tiers(counts).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 3}


def test_bfr_accounts_for_every_point(spark):
    rows = [(i, [float(i % 2 * 20 + (i * 7 % 5) / 10), float((i * 3 % 7) / 10), 1.0]) for i in range(120)] + [(500, [900.0, -900.0, 1.0])]
    points = spark.createDataFrame(rows, "point_id long, features array<double>")
    state = cluster.bfr([points.where(F.col("point_id") % 3 == k) for k in range(3)], k=2)
    seen = 0
    for k, (_, _, ds, _, cs, rs) in enumerate(state.rounds):
        seen += points.where(F.col("point_id") % 3 == k).count()
        assert ds + cs + rs == seen
    labels = {r["point_id"]: r["cluster"] for r in cluster.labels(points, state).collect()}
    assert len(labels) == len(rows) and labels[500] == -1


def test_summary_deviation():
    s = cluster.Summary(2, [2.0, 6.0], [2.0, 20.0])
    assert s.centre() == [1.0, 3.0] and s.std() == [cluster.LEAST_STD, pytest.approx(math.sqrt(10 - 9))]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "points").write_text("1,0.5,x\n2,1,2\n")
    assert [tuple(r) for r in readers.points_csv(spark, str(tmp_path / "points")).collect()] == [(1, [0.5, None]), (2, [1.0, 2.0])]
    (tmp_path / "sets").write_text("b,a,b\n")
    assert readers.itemsets(spark, str(tmp_path / "sets")).first()["items"] == ["a", "b"]
    (tmp_path / "stop").write_text(" the \nof\n")
    assert {r["word"] for r in readers.stop_words(spark, str(tmp_path / "stop")).collect()} == {"the", "of"}
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4, "date": "2005-01-02 03:04:05"}\n{"date": "x"}\nbroken\n')
    r = readers.reviews(spark, str(tmp_path / "r.json"))
    assert [x["ts"] is None for x in r.collect()] == [False, True, True]
    assert explore.in_year(r, 2005).first()["n"] == 1
    (tmp_path / "m.json").write_text('{"business_id": "b", "features": [1]}\n{"user_id": "u", "features": [2, 3]}\n')
    b, u = readers.content_model(spark, str(tmp_path / "m.json"))
    assert b.first()["features"] == [1] and u.first()["features"] == [2, 3]
    assert [c.count() for c in readers.point_chunks(spark, [str(tmp_path / "points")])] == [2]
    (tmp_path / "chunks").mkdir()
    for name, n in (("b", 2), ("a", 1)):
        (tmp_path / "chunks" / name).write_text("1,0.5\n" * n)
    assert [c.count() for c in readers.point_chunks(spark, str(tmp_path / "chunks"))] == [1, 2]
    (tmp_path / "n").write_text("17\n")
    assert readers.single_number(spark, str(tmp_path / "n")).first()["value"] == 17
    assert readers.literal(spark, [("a", 1)], "k string, v int").first()["v"] == 1


def test_written_files(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "d", 0.5), ("a", "z", 0.1), ("a", "c", 1.0)], "a string, b string, sim double")
    writers.similar_pairs(pairs, str(tmp_path / "pairs"))
    text = [line for f in sorted((tmp_path / "pairs").glob("part-*")) for line in f.read_text().splitlines() if line != "b1,b2,sim"]
    assert text == ["a,c,1.0", "a,z,0.1", "b,d,0.5"]
    for k in range(2):
        writers.append_csv(spark.createDataFrame([(k, 5)], "t int, n int"), str(tmp_path / "windows"))
    assert spark.read.csv(str(tmp_path / "windows"), header=True).count() == 2
    tiers = spark.createDataFrame([("x", 1, 2), ("b", 3, 1), ("a", 3, 1)], "tag string, n long, tier long")
    writers.lines(writers.tag_report(7, tiers), str(tmp_path / "report"))
    assert next((tmp_path / "report").glob("part-*")).read_text() == "The number of tweets with tags from the beginning: 7\na: 3\nb: 3\nx: 1\n\n"


def test_operators_delete_what_they_wrote(spark, data):
    import os

    from lodeworks.plans import registry
    from lodeworks.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = registry.queries()["q30_item_model"](spark, data)
    left = set(os.listdir(folder)) - before
    assert len(left) <= 1 and found.count() > 0


def test_command_line(spark, data, tmp_path, capsys):
    from lodeworks.__main__ import main

    main(["q04_top_users", data, "--out", str(tmp_path / "out"), "--order", "n"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 5 and "Duration" in capsys.readouterr().out
    main([])
    assert "q12_frequent_itemsets" in capsys.readouterr().out


def test_edges_from_prefixes(spark):
    """Users of a business that all have, and of rare ones: the pairs that share enough, and no others."""
    pairs = [(u, 0) for u in range(40)] + [(u, 1 + (u * k) % 11) for u in range(40) for k in range(1, 5)]
    sets = {u: {b for v, b in pairs if v == u} for u in range(40)}
    for least in (1, 2, 4):
        got = {(r["a"], r["b"]) for r in graph.shared_edges(spark.createDataFrame(pairs, "u long, b long"), "u", "b", least).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


def test_streams_of_chunks_and_sockets(spark, tmp_path):
    rows = [(i, [float(i % 2 * 20 + (i * 7 % 5) / 10), float((i * 3 % 7) / 10)]) for i in range(90)]
    points = spark.createDataFrame(rows, "point_id long, features array<double>")
    chunks = [points.where(F.col("point_id") % 3 == k).coalesce(1) for k in range(3)]
    keeper = streams.ChunkedBfr(k=2)
    for k, c in enumerate(chunks):
        keeper(c, k)
    keeper(chunks[2], 2)  # a batch that is run again
    assert keeper.result().rounds == cluster.bfr(chunks, k=2).rounds

    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b'{"city": "a"}\n{"city": "b"}\nbroken\n')
        threading.Event().wait(8)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    seen = []
    query = streams.start(readers.socket_cities(spark, "127.0.0.1", server.getsockname()[1]), lambda batch, n: seen.extend(r["city"] for r in batch.collect()), str(tmp_path / "c"), "1 second")
    query.awaitTermination(6)
    query.stop()
    assert sorted(seen, key=str) == [None, "a", "b"] or sorted(seen, key=str) == ["a", "b", None]


def test_report_lines(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 3.0)], "u string, v string, betweenness double")
    assert [r[0] for r in writers.betweenness_lines(edges).collect()] == ["('a', 'c'),3.0", "('a', 'b'),2.0"]
    assert writers.bit_line(spark.createDataFrame([(1, 0), (0, 1)], "position int, hit int")).first()[0] == "1 0"
    assert writers.point_labels(spark.createDataFrame([(2, -1), (1, 0)], "point_id long, cluster int")).first()[0] == '{"1":0,"2":-1}'


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{i % 60:02d}", f"c{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "t string, city string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "city")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    s = readers.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = streams.run_available(sketch.windowed_counts(s), "windows", "complete")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(sketch.windowed_counts(df))
    late = streams.run_available(streams.windowed_distinct(readers.file_stream(spark, str(tmp_path / "in"), df.schema), late="1 second"), "late")
    assert set(late.columns) == {"window_start", "truth", "estimate"}


def test_predictions_for_every_source(spark, monkeypatch):
    from lodeworks.plans import registry

    n = 10_050
    prof = spark.range(n).selectExpr("id AS business_id", "CAST(id % 2 AS long) AS idx", "1.0D AS score")
    users = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0)], "user_id long, idx long, score double")
    texts = spark.range(n).selectExpr("1 + id % 2 AS user_id", "id AS business_id")
    monkeypatch.setattr(registry, "profiles", lambda spark, d: (texts, prof, users))
    got = {(r["user_id"], round(r["sim"], 6)): r["count"] for r in registry.queries()["q29_content_predictions"](spark, "").groupBy("user_id", "sim").count().collect()}
    assert got == {(1, 1.0): n // 2, (2, round(0.5**0.5, 6)): n}


def test_girvan_newman_takes_the_graph_of_seven_shared_parts(spark, monkeypatch):
    from lodeworks.plans import registry

    rows = spark.createDataFrame([(u, p) for u in (1, 2) for p in range(7)] + [(3, p) for p in range(6)], "user_id long, business_id long")
    monkeypatch.setattr(registry.inputs, "order_reviews", lambda spark, d: rows)
    assert [r["members"] for r in registry.queries()["q40_girvan_newman"](spark, "").collect()] == ["1,2"]


def test_users_of_one_common_business_make_no_written_pairs(spark, monkeypatch):
    """All of 60 users share one business with each other, two of them eight: only what can be an edge is written."""
    written, keep = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    pairs = [(u, 100 * min(u, v) + max(u, v)) for u in range(60) for v in range(60) if u != v] + [(u, 9000 + k) for u in (3, 7) for k in range(7)]
    got = graph.shared_edges(spark.createDataFrame(pairs, "u long, b long"), "u", "b", 7).collect()
    assert [tuple(r) for r in got] == [(3, 7)] and written["candidates"].count() == 1


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Users of few businesses: blocks give what pairs by joins give, of signatures of one and two rows a band, and make no candidate pairs."""
    rows = [(u, (u * k * k + k) % 12, (u * 7 + k * 3) % 5 + 1) for u in range(90) for k in range(9)]
    ratings = recommend.mean_ratings(spark.createDataFrame(rows, "user_id long, business_id long, stars long"))
    wanted = spark.createDataFrame([(u, b) for u in range(0, 95, 3) for b in range(14)], "user_id long, business_id long")
    average, hashes = recommend.business_average(ratings), [(3, 5), (7, 2), (11, 3), (2, 9)]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for band_rows in (1, 2):
        with monkeypatch.context() as m:
            m.setattr(recommend, "crowded", lambda *_: False)
            model = recommend.user_model(ratings, hashes, band_rows=band_rows)
            joined, predicted = key(model), key(recommend.predict_by_users(wanted, ratings, model, average, 4))
        with monkeypatch.context() as m:
            m.setattr(similarity, "candidate_pairs", None)
            m.setattr(recommend.user_blocks, "USERS", 16)
            m.setattr(recommend.user_blocks, "COLUMNS", 5)
            assert key(recommend.user_model(ratings, hashes, band_rows=band_rows)) == joined and joined
            assert key(recommend.predict_by_hashed_users(wanted, ratings, hashes, average, 4, band_rows=band_rows)) == predicted


def test_windows_count_distinct_slices(spark, monkeypatch):
    """25-second windows every 10 seconds: events become distinct cities of 5-second slices before windows multiply them; batches may come again."""
    import datetime

    written, keep = {}, sketch.materialize
    monkeypatch.setattr(sketch, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    rows = [(f"2024-01-01 00:00:{(i * i) % 37:02d}", f"c{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "t string, city string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "city")
    zero, want = datetime.datetime(2024, 1, 1), {}
    for t, c in rows:
        second = int(t[-2:])
        for start in range(-30, 60, 10):
            if start <= second < start + 25:
                want.setdefault(str(zero + datetime.timedelta(seconds=start)), set()).add(c)
    got = sorted(map(tuple, sketch.windowed_counts(df, "25 seconds", "10 seconds").collect()))
    assert [(w, n) for w, n, _ in got] == sorted((w, len(c)) for w, c in want.items())
    assert written["slices"].count() == len({(int(t[-2:]) // 5, c) for t, c in rows})
    keeper = streams.StreamedDistinct("25 seconds", "10 seconds")
    for k in (0, 1, 1, 2, 0):
        keeper(df.where(F.col("ts").cast("string").substr(-1, 1).cast("int") % 3 == k), k)
    assert sorted(map(tuple, keeper.counts().collect())) == got


def test_baskets_are_packed_once(spark, data, monkeypatch):
    """One row for all equal baskets of a part, whatever they are repeated; the same sets from packed and long baskets; the lines are joined once."""
    from lodeworks.plans import inputs, registry

    long = spark.createDataFrame([(b, i) for b in range(60) for i in "abcd"[: 1 + b % 4]] + [(1, "a")], "basket long, item string")
    dealt = itemsets.packed(itemsets.in_parts(long, 4), ["part"])
    assert dealt.count() == 4 and dealt.agg(F.sum("w")).first()[0] == 60
    key = lambda df: sorted((tuple(r["items"]), r["n"]) for r in df.collect())
    for f in (itemsets.mine, itemsets.fp_growth, lambda x, t: itemsets.two_phase(x, t, 4)):
        assert key(f(dealt, 15)) == key(f(long, 15)) == [(s, n) for s, n in key(itemsets.mine(long, 1)) if n >= 15]
    assert itemsets.copies(spark.createDataFrame([(["a"], 20_001)], "has array<string>, w long")).count() == 20_001
    reads, keep = [], inputs.brand_pairs
    monkeypatch.setattr(inputs, "brand_pairs", lambda spark, d: reads.append(d) or keep(spark, d))
    written, store = [], registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df, name: written.append(name) or store(df, name))
    for name in ("q10_local_candidates", "q14_fp_growth", "q15_agreement"):
        registry.queries()[name](spark, data)
    assert len(reads) == 3 and written.count("packed-baskets") == 3
