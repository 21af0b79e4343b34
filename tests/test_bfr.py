"""BFR and K-means against a plain version of the same choices, on the driver's vectors and on random groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lodeworks.operators import cluster


def centres_and_labels(points: dict, k: int, rounds: int, tol: float = 1e-4) -> dict:
    """point -> number of its cluster after Lloyd rounds from the points of the least seeded hashes."""
    ids = sorted(points, key=lambda i: (hashlib.md5(f"666:{i}".encode()).hexdigest(), i))
    if not ids:
        return {}
    x, names = np.array([points[i] for i in points]), list(points)
    centres = np.array([points[i] for i in ids[:k]])
    nearest = lambda: np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(2)).argmin(1)
    for _ in range(rounds):
        label = nearest()
        moved = 0.0
        for c in set(label.tolist()):
            mean = x[label == c].mean(0)
            moved = max(moved, float(np.sqrt(((mean - centres[c]) ** 2).sum())))
            centres[c] = mean
        if moved < tol:
            break
    return dict(zip(names, nearest().tolist(), strict=True))


class Group:
    def __init__(self, rows):
        rows = np.array(rows)
        self.n, self.s, self.q = len(rows), rows.sum(0), (rows**2).sum(0)

    def add(self, other):
        self.n, self.s, self.q = self.n + other.n, self.s + other.s, self.q + other.q

    def far(self, point):
        mean = self.s / self.n
        std = np.maximum(1e-9, np.sqrt(np.maximum(0, self.q / self.n - mean**2)))
        return float(np.sqrt((((point - mean) / std) ** 2).sum()))

    def near(self, point):
        return self.far(point) < 3 * np.sqrt(len(self.s))


def plain(chunks: list[dict], k: int) -> tuple[list[tuple], dict]:
    """Rounds and labels of BFR: discard sets are lists of groups, compressed ones a dictionary by key."""
    rounds, label = [], {}
    discard, compressed, retained = {}, {}, {}

    def absorb(points, sets, mark):
        rest, fresh = {}, {}
        for i, p in points.items():
            best = min(((g.far(np.array(p)), key) for key, g in sorted(sets.items())), default=None)
            if best and best[0] < 3 * np.sqrt(len(p)):
                fresh.setdefault(best[1], []).append(p)
                if mark:
                    label[i] = int(best[1][1:])
            else:
                rest[i] = p
        for key, rows in fresh.items():
            sets[key].add(Group(rows))
        return rest

    def compress(points, number, iterations):
        found = centres_and_labels(points, 3 * k, iterations)
        alone = {}
        for c in sorted(set(found.values())):
            ids = [i for i in points if found[i] == c]
            if len(ids) == 1:
                alone[ids[0]] = points[ids[0]]
            else:
                compressed[f"R{number}C{c:04d}"] = Group([points[i] for i in ids])
        return alone

    for number, chunk in enumerate(chunks):
        if not number:
            head = dict(sorted(chunk.items())[: -(-len(chunk) // 10)])
            for i, c in centres_and_labels(head, k, 5).items():
                label[i] = c
            for c in set(label.values()):
                discard[f"D{c:04d}"] = Group([head[i] for i in head if label[i] == c])
            retained = compress({i: p for i, p in chunk.items() if i not in head}, 0, 3)
        else:
            rest = absorb(absorb(chunk, discard, True), compressed, False)
            retained = compress(retained | rest, number, 5)
            merged = {}
            for key in sorted(compressed):
                g = compressed[key]
                into = next((m for m in sorted(merged) if merged[m].near(g.s / g.n)), None)
                if into is None:
                    merged[key] = g
                else:
                    merged[into].add(g)
            compressed = merged
        if number == len(chunks) - 1:
            for key in sorted(compressed):
                centre = compressed[key].s / compressed[key].n
                close = sorted((g.far(centre), d) for d, g in discard.items() if g.near(centre))
                if close:
                    discard[close[0][1]].add(compressed.pop(key))
        rounds.append((number, len(discard), sum(g.n for g in discard.values()), len(compressed), sum(g.n for g in compressed.values()), len(retained)))
    return rounds, label


def grouped(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 4)) * 20
    return {i: (centres[i % 6] + rng.normal(size=4) if i % 29 else rng.normal(size=4) * 60).tolist() for i in range(300)}


@pytest.mark.parametrize("seed", [None, 1])
def test_bfr_by_chunks(spark, data, seed):
    if seed is None:
        points = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
        k = 10
    else:
        points, k = grouped(seed), 6
    chunks = [{i: p for i, p in points.items() if i % 5 == c} for c in range(5)]
    want, label = plain(chunks, k)
    state = cluster.bfr([spark.createDataFrame(list(c.items()), "point_id long, features array<double>") for c in chunks], k)
    assert state.rounds == want
    every = spark.createDataFrame(list(points.items()), "point_id long, features array<double>")
    assert {r["point_id"]: r["cluster"] for r in cluster.labels(every, state).collect()} == {i: label.get(i, -1) for i in points}


def test_kmeans_rounds(spark):
    points = grouped(3)
    df = spark.createDataFrame(list(points.items()), "point_id long, features array<double>")
    got = {r["point_id"]: int(r["cluster"]) for r in cluster.kmeans(df, 6, 4)[0].collect()}
    assert got == centres_and_labels(points, 6, 4)
