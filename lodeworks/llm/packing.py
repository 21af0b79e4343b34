"""Best-fit packing of token sequences by large-item matching.

Only lengths decide a packing, and there are at most `capacity` of them: a histogram of lengths is
packed on the driver, whatever the number of documents. Pieces above one third of the capacity go at
most two to a sequence: the longest is matched with the longest that fits beside it. The smaller ones,
longest first, go where they leave the least room. The result is a list of runs: "pieces number r..
of length L go to sequences from b on, m to each, from offset o". Each piece then finds its place by
its number among the pieces of its length.

Defined cases: a null or empty text is one piece of the end id alone; repeated rows are packed each; a
null doc_id is kept; an empty table gives no pieces. Whole texts are encoded; pieces partition them.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, materialize, tidy

CAPACITY, END_ID = 2048, 0
VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Texts with a longer run without white space are encoded by the library, which merges long words faster.
LONG_RUN = re.compile(r"\S{20000}")


@functools.cache
def encoder(vocabulary: str):
    """The library by which ids are defined."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@functools.cache
def by_ranks(vocabulary: str):
    """The same vocabulary as ranks: five times as fast, with the same ids."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids that the library gives for the whole text, special strings included, without added ones."""
    if len(text) >= 20_000 and LONG_RUN.search(text):
        return encoder(vocabulary).encode(text, add_special_tokens=False).ids
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        ids += ([SPECIAL_ID] if k else []) + by_ranks(vocabulary).encode_ordinary(part)
    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """Pieces with their number among those of their length in the same task (_rank, _pid)."""
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "_rank", "_pid"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    arrow = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            rows, found, blobs = [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "", vocabulary)
                ids.append(END_ID)
                raw = np.array(ids, "<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append(i)
                    found.append((k, start, length, zlib.crc32(part), seen[length], pid))
                    seen[length] += 1
                    if with_ids:
                        blobs.append(part)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)] if found else [pa.array([], t) for t in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns, *([pa.array(blobs, pa.binary())] if with_ids else [])], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, first sequence, pieces to a sequence, offset) that pack counts[length] pieces each.

    Groups of sequences with the same content are handled as one, so the work depends on the number of
    distinct lengths only.
    """
    left, used, bins = dict(counts), dict.fromkeys(counts, 0), 0
    by_gap: dict[int, list] = {}  # gap -> groups [first sequence, number of sequences, [(length, first number, m, offset)]]
    gaps: list[int] = []  # sorted keys of by_gap

    def put(gap: int, group: list) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        by_gap[gap].append(group)

    def take(length: int, n: int) -> int:
        at = used[length]
        used[length] += n
        left[length] -= n
        return at

    def opened(n: int) -> int:
        nonlocal bins
        bins += n
        return bins - n

    large = sorted(x for x in left if 3 * x > capacity)
    for k in range(len(large) - 1, -1, -1):
        a = large[k]
        at = min(k, bisect.bisect_right(large, capacity - a) - 1)
        while left[a] and at >= 0:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:
                at -= 1
                continue
            first, ra = opened(n), take(a, n)
            put(capacity - a - b, [first, n, [(a, ra, 1, 0), (b, take(b, n), 1, a)]])
        if left[a]:
            n = left[a]
            put(capacity - a, [opened(n), n, [(a, take(a, n), 1, 0)]])

    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            g = bisect.bisect_left(gaps, x)
            if g < len(gaps):
                gap = gaps[g]
                first, n, content = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[g]
            else:
                gap, content = capacity, []
                n = -(-left[x] // (capacity // x))
                first = opened(n)
            m = min(gap // x, left[x])
            fits = left[x] // m if m < gap // x else min(n, left[x] // m)
            fits = min(fits, n)
            put(gap - m * x, [first, fits, [*content, (x, take(x, m * fits), m, capacity - gap)]])
            if fits < n:  # the rest of the group keeps its gap
                put(gap, [first + fits, n - fits, [(y, r + fits * k, k, o) for y, r, k, o in content]])
    return [(x, r, first, m, o) for groups in by_gap.values() for first, _, content in groups for x, r, m, o in content]


@tidy
def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian uint32)."""
    spark = docs.sparkSession
    cutup = materialize(pieces(docs, capacity, vocabulary, with_ids), "pack-pieces")
    each = cutup.groupBy("_pid", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(each.select("_pid", "length", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")), "pack-shifts")
    histogram = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(pack_lengths(histogram, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def found(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = number.to_numpy()
        run = table[np.searchsorted(keys, (length.to_numpy() << 44) | n, "right") - 1]
        sequence, slot = np.divmod(n - run[:, 1], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 2] + sequence, "offset": run[:, 4] + slot * run[:, 0]})

    out = cutup.join(broadcast_if_small(shifts.drop("_n")), ["_pid", "length"]).withColumn("_place", found("length", F.col("_rank") + F.col("_shift")))
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *(["ids"] if with_ids else []))


def digest(docs: DataFrame) -> DataFrame:
    """What op9 returns."""
    return pack_documents(docs)
