"""Toxicity by multiple-instance learning: labels of documents train a score of sentences.

A sentence's score is the logistic of summed weights of its distinct words' features (hashes of the word and of
its first four, five and six letters); features of few documents have no weight. A document is toxic if any of its sentences is, so its score
is their noisy-or, 1 - product of (1 - p). The weights are trained through the noisy-or on document
labels alone; the sentence scores then locate what is offensive.

The training sample is bounded (TRAIN_ROWS rows of either label, of whole texts); it is drawn in the order
of md5(doc_id), so the same table gives the same model. Executors hash the features of its sentences; the
driver gets their numbers. Every text is scored whole. Labels, language, source and id are inputs to no score.

Defined cases: null, empty and wordless texts score as one empty sentence; repeated rows score alike;
an id with several texts trains with that of the least md5, one with several labels counts as toxic if any
says so, null ids do not train; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each label, at most, in the training sample.
TRAIN_ROWS = 2500
FEATURES, EPOCHS, RATE, DECAY, LEAST_ROWS = 1 << 20, 60, 0.1, 5e-4, 5
#: Weights start as this part of the log odds, a sentence without evidence at this logit.
START, BIAS = 0.8, -10.0
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
REMEMBERED = 600_000
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    return [zlib.crc32(x.encode()) % FEATURES for x in (f"w {word}", *(f"{k} {word[:k]}" for k in (4, 5, 6) if len(word) > k))]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has words; one empty sentence if none has."""
    found = [(m.start(), m.end(), w) for m in SENTENCE.finditer(text) if (w := list(dict.fromkeys(TOKEN.findall(m[0].lower()))))]
    return found or [(0, len(text), [])]


def bag(text: str, known: dict[str, list[int]]) -> tuple[bytes, bytes]:
    """A text's sentences for training: how many features each has, and the features, as packed int32 arrays."""
    sizes, feats = [], []
    for _, _, words in sentences(text):
        before = len(feats)
        for w in words:
            if (f := known.get(w)) is None:
                f = known[w] = features(w)
            feats += f
        sizes.append(len(feats) - before)
    return np.array(sizes, np.int32).tobytes(), np.array(feats, np.int32).tobytes()


def train(bags: list[tuple[bytes, bytes]], labels: list[int], start: float = START, bias: float = BIAS) -> np.ndarray:
    """Weights of the features, then the bias, from the bags of texts and their labels.

    Starts at the features' log odds over documents, then descends the noisy-or's log loss; log
    (1 - p) of a document is minus the sum of its sentences' softplus.
    """
    weights = np.zeros(FEATURES + 1)
    labels = np.array(labels, float)
    rows = bags
    if not len(rows) or labels.min() == labels.max():
        weights[-1] = -np.inf
        return weights
    sizes = [np.frombuffer(s, np.int32) for s, _ in bags]
    feats = np.concatenate([np.frombuffer(f, np.int32) for _, f in bags])
    doc_of = np.repeat(np.arange(len(bags), dtype=np.int32), [len(s) for s in sizes])
    sent_of = np.repeat(np.arange(len(doc_of), dtype=np.int32), np.concatenate(sizes))
    seen = np.unique(feats.astype(np.int64) * len(rows) + doc_of[sent_of])  # (feature, document) pairs
    of, doc = seen // len(rows), seen % len(rows)
    hot = np.bincount(of, labels[doc], FEATURES)
    cold = np.bincount(of, 1 - labels[doc], FEATURES)
    used = np.append(hot + cold >= LEAST_ROWS, True)
    weights[:-1] = start * np.clip(np.log((hot + 0.5) / (labels.sum() + 1)) - np.log((cold + 0.5) / ((1 - labels).sum() + 1)), -1, 4) * used[:-1]
    weights[-1] = bias
    sums = np.full(FEATURES + 1, 1e-8)
    n_sent = len(doc_of)
    for _ in range(EPOCHS):
        z = np.bincount(sent_of, weights[feats], n_sent) + weights[-1]
        soft = np.logaddexp(0, z)
        s = np.bincount(doc_of, soft, len(rows))
        p = np.clip(-np.expm1(-s), 1e-9, 1 - 1e-9)
        # d loss / d s of a document: 1 - y/p; times the sentence's own p
        slope = (1 - labels / p)[doc_of] * np.exp(-np.logaddexp(0, -z))
        grad = np.append(np.bincount(feats, slope[sent_of], FEATURES), slope.sum()) / len(rows)
        grad[:-1] += DECAY * weights[:-1]
        grad *= used
        sums += grad * grad
        weights -= RATE * grad / np.sqrt(sums)
    return weights


def fit(docs: DataFrame, labels: DataFrame, fold: Column | None = None) -> np.ndarray:
    """Weights from labelled documents where fold holds (all if None)."""
    lab = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_lw_y"))
    if fold is not None:
        lab = lab.where(fold)
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [lab.where(F.col("_lw_y") == y).orderBy(order, "doc_id").limit(TRAIN_ROWS) for y in (0, 1)]
    both = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * TRAIN_ROWS rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(both, "doc_id")
    rows = rows.groupBy("doc_id", "_lw_y").agg(F.min_by("text", F.md5("text")).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            sizes, feats = zip(*(bag(t.as_py(), known) for t in batch.column(2)), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(sizes, pa.binary()), pa.array(feats, pa.binary())], names=["id", "y", "sizes", "feats"])

    rows = rows.select("doc_id", "_lw_y", "text").mapInArrow(bags, "id string, y int, sizes binary, feats binary").collect()
    rows.sort(key=lambda r: r["id"])
    return train([(r["sizes"], r["feats"]) for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, weights: np.ndarray, locate: bool = False, least: float = 0.3) -> DataFrame:
    """docs' doc_id with score; with locate also offending: (start, end, score) of the sentences of at least that score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)  # FEATURES + 1 numbers
    found = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())] + [T.StructField("offending", found)] * locate)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value

        class Memory(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > REMEMBERED:
                    self.clear()
                value = self[word] = float(sum(w[f] for f in features(word)))
                return value

        get = Memory().__getitem__
        for batch in batches:
            sums, starts, spans = [], [], []
            for cell in batch.column(1):
                parts = sentences(cell.as_py() or "")
                starts.append(len(sums))
                sums += [sum(map(get, words)) for _, _, words in parts]
                if locate:
                    spans.append([(a, b) for a, b, _ in parts])
            z = np.array(sums, float) + w[-1]
            total = np.add.reduceat(np.logaddexp(0, z), starts) if starts else np.zeros(0)
            columns = [batch.column(0), pa.array(-np.expm1(-total))]
            if locate:
                p = np.exp(-np.logaddexp(0, -z))
                columns.append(pa.array([[(a, b, float(p[s + k])) for k, (a, b) in enumerate(span) if p[s + k] >= least] for s, span in zip(starts, spans, strict=True)], arrow))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op6 returns: the fold with remainder 2 is held out from training."""
    weights = fit(docs, labels, remainder() != HELD_OUT)
    out = score(docs, weights)
    return out.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
