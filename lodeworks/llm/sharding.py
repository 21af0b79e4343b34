"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..n-1 in the order of doc_id; a keyed permutation of 0..n-1 shuffles them;
the permuted number p gives shard p % shards and slot p // shards. So the shuffle is reproducible,
shard sizes differ by one row at most (the law `rows`), slots have no gap, and where row r of n goes
is computable without the table. Numbering decides, so equal texts are not kept together.

Defined cases: null texts weigh 16 bytes and have the CRC of the empty text; rows that repeat are
rows; null doc_ids come first; an empty table gives no rows. Where shards are written, columns of docs
keep their names: if one is called shard or slot, the added column gets underscores in front.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_row_number, text_or_empty, tidy

SHARDS, SEED, ROUNDS = 40, 20240229, 6
#: Fixed cost of a row beside its text.
ROW_BYTES = 16
PRIME = 2_147_483_647  # 2^31 - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an addend below PRIME for each round."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [(int(a), int(b)) for a, b in rng.integers(1, PRIME, size=(rounds, 2))]


def permute(rows: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The permuted numbers of rows (0..n-1), by an alternating Feistel network over a square of side ceil(sqrt(n)).

    The square has at most 2 * sqrt(n) + 1 numbers over n; a number that lands there walks on along
    its cycle until it is below n.
    """
    if n <= 1:
        return np.zeros(len(rows), np.int64)
    side, keys = math.isqrt(n - 1) + 1, round_keys(seed, rounds)
    out = rows.astype(np.int64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] // side, out[walking] % side
        for a, b in keys:
            mixed = ((right + b) % PRIME * a) % PRIME
            mixed = (mixed ^ (mixed >> 13)) * 1_103_515_245 % PRIME
            left, right = right, (left + mixed) % side
        out[walking] = left * side + right
        walking = walking[out[walking] >= n]
    return out


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number, without any table."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def assign_shards(numbered: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """Adds the shard and the slot to a DataFrame with row numbers _lw_row (0..n-1), which are dropped."""

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    p = F.col("_lw_p")
    out = numbered.withColumn("_lw_p", permuted("_lw_row"))
    return out.withColumns({names[0]: (p % shards).cast("int"), names[1]: F.floor(p / F.lit(shards)).cast("long")}).drop("_lw_p", "_lw_row")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    text = text_or_empty()
    slim = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = global_row_number(slim, ["doc_id", "text_crc32", "size"], "shard-rows")
    out = assign_shards(numbered, n, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores in front as it takes to differ from all others."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Writes docs as Parquet in a folder per shard, each in slot order, and returns the written table."""
    text = text_or_empty()
    keyed = docs.withColumns({"_lw_crc": F.crc32(text.cast("binary")), "_lw_size": F.octet_length(text)})
    numbered, n = global_row_number(keyed, ["doc_id", "_lw_crc", "_lw_size"], "shard-docs")
    shard, slot = names = tuple(free_name(c, docs.columns) for c in ("shard", "slot"))
    out = assign_shards(numbered, n, shards, seed, names).drop("_lw_crc", "_lw_size")
    out.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


@tidy
def digest(docs: DataFrame) -> DataFrame:
    """What op10 returns."""
    return shard_documents(docs)
