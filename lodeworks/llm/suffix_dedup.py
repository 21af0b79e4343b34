"""Removal of long repeats by column-wise construction of a collection's Burrows-Wheeler transform.

A byte goes if a string of `width` bytes that covers it also starts in a document of a smaller id.

The construction takes one symbol of every string a round, from their ends: the suffixes of a collection
in sorted order, extended by the symbols before them, are in sorted order once those symbols are sorted
stably. The common prefix of two neighbours grows by one over the least of those between the places they
come from. After as many rounds as strings are long, runs with common prefixes of `width` symbols are
the repeated strings, and the least document of a run is the one that keeps it. Arrays of a round are
read from front to back and written anew, as sequential files would be; they stay in the memory of a
task, as executors share no local folder.

Whole documents would take as many rounds as the longest has bytes. So the collection is made of what can
repeat: each window of `width` bytes holds an anchor, the least of its `seed`-byte strings by hash, and
equal windows hold equal anchors. The strings of the collection are the surroundings of anchors, all
windows that can hold them; the anchors stand in one column. As equal windows have their anchors in equal
places, they start in equal columns: a round then sorts only the suffixes of one column, one of each string,
and only the columns where windows start are read. Surroundings that agree in 128 bits of hashes are proposed
as equal: only the least document of each matters then, and only anchors with different surroundings need
rounds. Nothing is removed on a hash: proposals of neighbouring anchors are joined into long matches, the
bytes of the smaller document are sent to the larger one, and what differs stays.

Anchors, surroundings and results travel as packed arrays, one row for a bucket and a block of documents. A
block sends equal surroundings only once, so that a passage of all documents reaches a task once for each
block. Anchors in many surroundings are taken apart into windows, which spread over the buckets; those that
are crowded in one block already stay there, and their bucket only hears of them.

Defined cases: a null text is empty; a null id comes before all others; rows of equal id do not remove
from each other; texts shorter than `width` bytes lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, partitions_for, text_or_empty, tidy
from .packed import by_key, packed, pair_runs, parcels, planes, rows_of, runs, unplaned

U8 = np.uint64
PAD = 255  # no byte of UTF-8
#: Strings that are compared with others at once.
AT_ONCE = 8192
#: Strings of rows that are made together, unless one row has more.
AT_MOST = 30_000
MIX1, MIX2 = U8(0xBF58476D1CE4E5B9), U8(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
LETTERS = np.random.Generator(np.random.PCG64(50)).integers(1, 2**63, 256, dtype=np.int64).astype(U8) * U8(2) + U8(1)


@dataclass(frozen=True)
class DedupParams:
    width: int = 50
    seed: int = 28
    #: Entries of an anchor in a bucket from which it is taken apart into windows.
    frequent: int = 50_000
    #: Different surroundings of an anchor in one block from which it is crowded.
    crowd: int = 512
    #: Rows, of a key each, up to which the documents that are asked for bytes are found by a broadcast, after a count.
    broadcast_keys: int = 500_000
    #: Strings that go through the rounds together, unless one anchor has more.
    together: int = 2000


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U8), np.ones(1, U8)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            step, back = pow(BASE, m, 1 << 64), pow(BASE, -m, 1 << 64)
            self.up = np.concatenate((self.up, self.up * U8(step)))
            self.down = np.concatenate((self.down, self.down * U8(back)))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(30))) * MIX1
    x = (x ^ (x >> U8(27))) * MIX2
    return x ^ (x >> U8(31))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w neighbours."""
    have = 1
    out = x
    while have * 2 <= w:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, params: DedupParams, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, hashes of the surroundings) of the least seed strings of all windows."""
    n, k = len(data), params.seed
    if n < params.width:
        return np.zeros(0, np.int64), np.zeros(0, U8), np.zeros(0, U8)
    up, down = powers.get(n)
    sums = np.zeros(n + 1, U8)
    np.cumsum(LETTERS[data] * up, out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    w = params.width - k + 1
    least = sliding(h, w, np.minimum)
    padded = np.zeros(len(least) + 2 * (w - 1), U8)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(sliding(padded, w, np.maximum) == h)
    low, high = np.maximum(at - (params.width - k), 0), np.minimum(at + params.width, n)
    around = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(U8) * U8(BASE))
    return at, mix(h[at] * U8(3)), around  # least hashes are small: mixed again, they spread over the buckets


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), o


BLOB = "bucket long, kind int, block long, a binary, b binary, c binary, d binary, e binary"
BLOB_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcde")])
ANCHORS, CROWDED, HITS, DOCUMENTS, COVERED, MATCHES = range(6)
#: Kinds of rows in what the anchors tell: of a document, of the bytes a block is asked for, and the keys of its rows.
TOLD, ASKED, KEYS = range(3)
SLICE = 2500


def joined_rows(rows: list, kinds: tuple, *columns: tuple[int, type]) -> list[np.ndarray]:
    """Packed columns (number, type) of the rows of some kinds, each as one array."""
    rows = [r for r in rows if r[1] in kinds]
    return [np.concatenate([np.frombuffer(r[k], t) for r in rows] or [np.zeros(0, t)]) for k, t in columns]


def repeated_anchors(keyed: DataFrame, n: int, params: DedupParams) -> DataFrame:
    """What anchors tell, packed: (kind, key, a, b, c, d, e).

    TOLD, by row key: intervals low, high that a smaller document of the same block covers, compared byte
    by byte, and the anchors left to the rounds: positions, hashes and whether they are taken apart.
    ASKED, by block: row in it, first byte, length, of what should cover (row key, first byte) of another
    block. KEYS, by block: the keys of its rows.
    """
    shift = max(6, (4 * n - 1).bit_length())
    back, width = params.width - params.seed, 2 * params.width - params.seed

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, part, number = Powers(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, len(whole), SLICE):
                batch, block = whole.slice(lo, SLICE), part << 24 | number
                number += 1
                data, offsets = bytes_of(batch.column(2))
                found = [anchors(data[offsets[i] : offsets[i + 1]], params, powers) for i in range(len(batch))]
                doc = np.repeat(np.arange(len(found), dtype=np.uint16), [len(p) for p, _, _ in found])
                pos, h, around = (np.concatenate(x) for x in zip(*found, strict=True))
                del found
                rk, ids = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
                sizes = np.diff(offsets)
                order = np.lexsort((ids[doc], around, h))
                h, around, doc, pos = h[order], around[order], doc[order], pos[order].astype(np.uint32)
                start = pair_runs(h, around)
                first = np.repeat(start, np.diff(np.append(start, len(h))))
                gone = ids[doc] > ids[doc][first]
                for some in np.array_split(np.flatnonzero(gone), max(1, gone.sum() // AT_ONCE)):
                    one, other = (surroundings(data, offsets[:-1][doc[i]], np.maximum(pos[i].astype(np.int64) - back, 0), np.minimum(pos[i].astype(np.int64) + params.width, sizes[doc[i]]), width) for i in (some, first[some]))
                    gone[some] = (one == other).all(1)
                out = [(block, DOCUMENTS, block, rk.tobytes(), sizes.tobytes(), b"", b"", b"")]
                if gone.any():
                    out.append((block, COVERED, block, doc[gone].tobytes(), pos[gone].tobytes(), b"", b"", b""))
                h, around, doc, pos = h[~gone], around[~gone], doc[~gone], pos[~gone]
                start = runs(h)
                many = np.diff(np.append(start, len(h)))
                crowded = np.repeat(many > params.crowd, many)
                bucket = (h >> U8(64 - shift)).astype(np.int64)
                if crowded.any():
                    out.append((block, HITS, block, h[crowded].tobytes(), doc[crowded].tobytes(), pos[crowded].tobytes(), np.ones(int(crowded.sum()), np.uint8).tobytes(), b""))
                    known = start[many > params.crowd]
                    out += [(b, CROWDED, block, x.tobytes(), b"", b"", b"", b"") for b, x in rows_of(bucket[known], h[known])]
                    h, around, doc, pos, bucket = (x[~crowded] for x in (h, around, doc, pos, bucket))
                ends = [*runs(bucket), len(h)]
                out += [(int(bucket[i]), ANCHORS, block, planes(np.diff(h[i:j], prepend=U8(0))), around[i:j].tobytes(), planes(ids[doc[i:j]]), doc[i:j].tobytes(), pos[i:j].tobytes()) for i, j in zip(ends, ends[1:], strict=False)]
                del order, start, first, gone
                yield from parcels(out, BLOB_ARROW)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            out = [r for r in rows if r[1] not in (ANCHORS, CROWDED)]
            crowds = np.unique(joined_rows(rows, (CROWDED,), (3, U8))[0])
            rows = [r for r in rows if r[1] == ANCHORS]
            if rows:
                parts = [np.cumsum(unplaned(r[3])) for r in rows]
                h, ids = np.concatenate(parts), np.concatenate([unplaned(r[5]) for r in rows]).view(np.int64)
                around, doc, pos = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((4, U8), (6, np.uint16), (7, np.uint32)))
                block = np.repeat(np.array([r[2] for r in rows], np.int64), [len(x) for x in parts])
                order = np.lexsort((ids, around, h))
                h, around, ids, doc, pos, block = (x[order] for x in (h, around, ids, doc, pos, block))
                inner = pair_runs(h, around)
                first = np.repeat(inner, np.diff(np.append(inner, len(h))))
                gone = ids > ids[first]
                start = runs(h)
                length = np.diff(np.append(start, len(h)))
                kinds = np.diff(np.append(np.searchsorted(inner, start), len(inner)))
                crowded = np.isin(h[start], crowds)
                left = np.repeat((kinds > 1) | crowded, length) & ~gone
                apart = np.repeat(crowded | (np.add.reduceat(left.astype(np.int64), start) > params.frequent), length).astype(np.uint8)
                of = first[gone]
                out += [(b, MATCHES, b, *(x.tobytes() for x in columns)) for b, *columns in rows_of(block[gone], doc[gone], pos[gone], block[of], doc[of], pos[of])]
                out += [(b, HITS, b, *(x.tobytes() for x in columns), b"") for b, *columns in rows_of(block[left], h[left], doc[left], pos[left], apart[left])]
            if out:
                yield from parcels(out, BLOB_ARROW)

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *((x, pa.binary()) for x in "abcde")])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_key(batches):
            rk, size = (np.frombuffer(x, np.int64) for x in next(r[3:5] for r in rows if r[1] == DOCUMENTS))
            doc, pos = (x.astype(np.int64) for x in joined_rows(rows, (COVERED,), (3, np.uint16), (4, np.uint32)))
            doc, low, high = merged(doc, np.maximum(pos - back, 0), np.minimum(pos + params.width, size[doc]))
            covers = {d: (x.tobytes(), y.tobytes()) for d, x, y in rows_of(doc, low, high)}
            h, at, pos, apart = joined_rows(rows, (HITS,), (3, U8), (4, np.uint16), (5, np.uint32), (6, np.uint8))
            hits = {d: (p.tobytes(), x.tobytes(), f.tobytes()) for d, p, x, f in rows_of(at.astype(np.int64), pos, h, apart)}
            out = [(TOLD, int(rk[d]), *covers.get(d, (b"", b"")), *hits.get(d, (b"", b"", b""))) for d in sorted({*covers, *hits})]
            out.append((KEYS, block, rk.tobytes(), b"", b"", b"", b""))
            doc, pos, other, its, there = (x.astype(np.int64) for x in joined_rows(rows, (MATCHES,), (3, np.uint16), (4, np.uint32), (5, np.int64), (6, np.uint16), (7, np.uint32)))
            if len(doc):
                low, start = np.maximum(pos - back, 0), np.maximum(there - back, 0)
                high = np.minimum(pos + params.width, size[doc])
                shifted = start - low
                order = np.lexsort((shifted, its, other, doc))
                group = np.zeros(len(doc), np.int64)  # matches of the same two rows at the same distance
                group[order] = np.cumsum(np.any([np.append(True, x[order][1:] != x[order][:-1]) for x in (doc, other, its, shifted)], axis=0))
                one = np.zeros(group.max() + 1, np.int64)
                one[group] = np.arange(len(group))
                group, low, high = merged(group, low, high)
                i = one[group]
                out += [(ASKED, b, *(x.tobytes() for x in columns)) for b, *columns in rows_of(other[i], its[i], low + shifted[i], high - low, rk[doc[i]], low)]
            yield packed(out, schema)

    sent = keyed.mapInArrow(blocks, BLOB)
    back_again = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, BLOB)
    found = back_again.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(documents, "kind int, key long, a binary, b binary, c binary, d binary, e binary")
    return materialize(found, "dedup-anchors")


BYTES = "bucket long, rk binary, low binary, size binary, bytes binary"
BYTES_ARROW = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("rk", "low", "size", "bytes"))])


def proposed(keyed: DataFrame, found: DataFrame, n: int, buckets: int, params: DedupParams) -> DataFrame:
    """(bucket, rk, low, size, bytes): what should stand from byte low on in the rows of some keys if matches hold, packed by buckets of the keys."""

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            keys = next((np.frombuffer(r[2], np.int64) for r in rows if r[1] == KEYS))
            who, *columns = joined_rows(rows, (ASKED,), *((k, np.int64) for k in range(2, 7)))
            if len(who):
                yield packed([(k, *(x.tobytes() for x in some)) for k, *some in rows_of(keys[who], *columns)], pa.schema([("rk", pa.int64()), *((x, pa.binary()) for x in "abcd")]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0  # sent on by size: a document may be asked for bytes by very many others
        for whole in batches:
            for lo in range(0, len(whole), 200):
                for text, *columns in zip(*(c.to_pylist() for c in whole.slice(lo, 200).columns), strict=True):
                    data = text.encode()
                    start, size, rk, low = (np.frombuffer(c, np.int64) for c in columns)
                    turn = np.cumsum(size) >> 20  # a megabyte of bytes at a time
                    for t in np.unique(turn):
                        some = turn == t
                        for b, s, z, r, x in rows_of(np.mod(rk[some], buckets), start[some], size[some], rk[some], low[some]):
                            out.append((b, r.tobytes(), x.tobytes(), z.tobytes(), b"".join(data[i : i + k] for i, k in zip(s.tolist(), z.tolist(), strict=True))))
                            held += int(z.sum())
                        if held > 4 << 20:
                            yield packed(out, BYTES_ARROW)
                            out, held = [], 0
        yield packed(out, BYTES_ARROW)

    asked = found.where(F.col("kind").isin(ASKED, KEYS)).select("key", "kind", "a", "b", "c", "d", "e")
    asked = asked.repartition(n, "key").sortWithinPartitions("key").mapInArrow(resolved, "rk long, a binary, b binary, c binary, d binary")
    asked = materialize(asked, "dedup-asked")
    texts = keyed.select("rk", "text").join(broadcast_if_small(asked.select("rk").distinct(), params.broadcast_keys), "rk", "left_semi").dropDuplicates(["rk"])
    return texts.join(asked, "rk").select("text", "a", "b", "c", "d").mapInArrow(read, BYTES)


def surroundings(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, lead: np.ndarray | int = 0) -> np.ndarray:
    """Strings data[at + low : at + high] as rows of `width` bytes, from column `lead` on, padded on both sides."""
    columns, lead = np.arange(width), np.broadcast_to(lead, low.shape)
    start, end = at + low - lead, high - low + lead
    out = np.empty((len(low), width), np.uint8)
    for i in range(0, len(low), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        inside = (columns < end[some, None]) & (columns >= lead[some, None])
        out[some] = np.where(inside, data[np.clip(start[some, None] + columns, 0, len(data) - 1)], np.uint8(PAD))
    return out


def fingerprints(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row."""
    words = np.ascontiguousarray(strings).view(U8)
    a, b = np.zeros(len(strings), U8), np.full(len(strings), U8(BASE))
    for k in range(words.shape[1]):
        a = mix(a * U8(3) + words[:, k] + U8(k + 1))
        b = mix((b ^ words[:, k]) * U8(5) + U8(7 * k + 3))
    return a, b


def equal_rows(strings: np.ndarray) -> tuple[np.ndarray, int]:
    """(class of each row, number of classes): rows of a class have the same bytes."""
    a, b = fingerprints(strings)
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(a) else np.zeros(0, bool)
    out = np.zeros(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    one = np.zeros(int(new.sum()), np.int64)
    one[out] = np.arange(len(out))
    if not all(np.array_equal(strings[i : i + AT_ONCE], strings[one[out[i : i + AT_ONCE]]]) for i in range(0, len(strings), AT_ONCE)):
        _, out = np.unique(np.ascontiguousarray(strings).view(f"V{strings.shape[1]}").ravel(), return_inverse=True)
        return out, int(out.max()) + 1
    return out, int(new.sum())


def range_minima(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of x over low..high, the last included, from tables over powers of two."""
    length = (high - low + 1).astype(np.int32)
    logs = np.zeros(int(length.max()) + 1, np.int32)
    for k in range(1, len(logs).bit_length()):
        logs[1 << k :] = k
    tables = np.empty((int(logs[-1]) + 1, len(x)), x.dtype)
    tables[0] = x
    for k in range(1, len(tables)):
        half = 1 << (k - 1)
        np.minimum(tables[k - 1, :-half], tables[k - 1, half:], out=tables[k, :-half])
        tables[k, -half:] = tables[k - 1, -half:]
    level = logs[length]
    flat, row = tables.ravel(), level * np.int32(len(x))
    return np.minimum(flat[row + low], flat[row + high + 1 - (np.int32(1) << level)])


def column_wise(strings: np.ndarray, columns: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before) of all suffixes of the rows, sorted, by the rounds described above.

    With `columns`, of those that start in the first columns, one column after the other, each sorted for itself.
    """
    m, width = strings.shape
    flat = np.ascontiguousarray(strings).ravel()
    ends = np.arange(1, m + 1, dtype=np.int32) * width - 1  # where the symbol before each suffix stands
    at, prefix, none = ends, np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    done = []
    for column in reversed(range(width)):
        symbol = flat[at]
        order = np.argsort(symbol, kind="stable")
        s = symbol[order]
        between = np.zeros(len(order), np.uint8)
        same = np.flatnonzero(s[1:] == s[:-1])
        if len(same):
            low, high = (order[same] + 1).astype(np.int32), order[same + 1].astype(np.int32)
            between[same + 1] = range_minima(prefix, low, high) + 1
        if columns is None:
            at = np.concatenate((ends, at[order] - 1))
            prefix = np.concatenate((none, between))
        else:
            if column < columns:
                done.append((at[order] // width, np.full(m, column), between))
            at, prefix = at[order] - 1, between
    if columns is not None:
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))
    at = at + 1  # where each suffix starts; an empty one starts behind its row
    who = np.concatenate((np.arange(m), at[m:] // width))
    return who, np.concatenate((np.full(m, width), at[m:] % width)), prefix


def leading(strings: np.ndarray, width: int) -> np.ndarray:
    """Columns before each string, which holds `width` bytes or more."""
    return (strings[:, : strings.shape[1] - width] == PAD).cumprod(1, dtype=np.uint8).sum(1, dtype=np.int64)


def covered_offsets(strings: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows inside the rows that a row of a smaller document has too, in the same columns."""
    who, offset, prefix = column_wise(strings, strings.shape[1] - width + 1)
    lead = leading(strings, width)
    inside = (offset >= lead[who]) & (offset + width <= (lead + (strings != PAD).sum(1))[who])
    run = np.cumsum(prefix < width) - 1
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run[inside], docs[who[inside]])
    hit = inside & (least[run] < docs[who])
    return who[hit], offset[hit]


def merged(rk: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each rk, with those that touch or overlap joined."""
    if not len(rk):
        return rk, low, high
    order = np.lexsort((low, rk))
    rk, low, high = rk[order], low[order].astype(np.int64), high[order].astype(np.int64)
    group = np.cumsum(np.append(True, rk[1:] != rk[:-1])) - 1
    lift = group * (1 << 40)
    reach = np.maximum.accumulate(high + lift)
    new = np.append(True, low[1:] + lift[1:] > reach[:-1])
    start = np.flatnonzero(new)
    return rk[start], low[start], reach[np.append(start[1:], len(rk)) - 1] - lift[start]


COVER = "bucket long, kind int, key binary, strings binary, doc binary, rk binary, low binary, high binary"
COVER_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("key", "strings", "doc", "rk", "low", "high"))])
STRINGS, INTERVALS, PROPOSED = range(3)
RESULT = "rk long, low binary, high binary, at binary, size binary, bytes binary"


def covers(keyed: DataFrame, known: DataFrame, bytes_of_others: DataFrame, n: int, buckets: int, params: DedupParams) -> DataFrame:
    """(rk, low, high, at, size, bytes): sorted intervals that go from each row, and what goes if the bytes from `at` on are these; packed arrays. known is what the anchors told of rows."""
    width, reach = params.width, params.width - params.seed
    room = -(-(2 * width - params.seed) // 8) * 8

    def intervals(rk: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        rk, low, high = merged(rk, low, high)
        for b, r, x, y in rows_of(np.mod(rk, buckets), rk, low, high):
            yield (b, INTERVALS, b"", b"", b"", r.tobytes(), x.astype(np.int64).tobytes(), y.astype(np.int64).tobytes())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            made = [len(f or b"") + reach * (f or b"").count(1) for f in whole.column(5).to_pylist()]  # strings of each row
            cuts = np.flatnonzero(np.diff(np.cumsum(made) // AT_MOST, prepend=-1)).tolist() if made else []
            for lo, hi in zip(cuts, [*cuts[1:], len(whole)], strict=True):
                batch = whole.slice(lo, hi - lo)
                data, offsets = bytes_of(batch.column(2))
                rks, ids = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
                where = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(3).to_pylist()]
                doc = np.repeat(np.arange(len(where)), [len(x) for x in where])
                pos = np.concatenate(where)
                h = np.concatenate([np.frombuffer(x, U8) for x in batch.column(4).to_pylist()])
                apart = np.concatenate([np.frombuffer(x, np.uint8) for x in batch.column(5).to_pylist()]).astype(bool)
                size = np.diff(offsets)[doc]
                low, high = np.maximum(pos - reach, 0), np.minimum(pos + width, size)
                lead = reach - (pos - low)  # all anchors stand in one column, windows taken apart start in the first
                windows = 0
                if apart.any():
                    starts = [(np.flatnonzero(apart & (low + k + width <= high)), k) for k in range(reach + 1)]
                    at = np.concatenate([i for i, _ in starts])
                    first = np.concatenate([low[i] + k for i, k in starts])
                    keep = ~apart
                    doc, low, high = np.append(doc[keep], doc[at]), np.append(low[keep], first), np.append(high[keep], first + width)
                    lead = np.append(lead[keep], np.zeros(len(at), np.int64))
                    windows = len(at)
                    h = np.append(h[keep], np.zeros(windows, U8))
                strings = surroundings(data, offsets[:-1][doc], low, high, room, lead)
                kind, n = equal_rows(strings)
                if windows:
                    h[-windows:] = fingerprints(strings[-windows:])[0]
                least = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(least, kind, ids[doc])
                gone = ids[doc] > least[kind]
                out = list(intervals(rks[doc[gone]], low[gone], high[gone]))
                keep = np.flatnonzero(~gone)
                order = keep[np.lexsort((low[keep], rks[doc[keep]], kind[keep]))]
                if len(order):  # rows that repeat, or overlap in the same place, are sent once
                    k, r, x = kind[order], rks[doc[order]], low[order]
                    order = order[np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (x[1:] != x[:-1]))]
                for b, i in rows_of((h[order] % U8(buckets)).astype(np.int64), order):
                    out.append((b, STRINGS, h[i].tobytes(), strings[i].tobytes(), ids[doc[i]].tobytes(), rks[doc[i]].tobytes(), low[i].tobytes(), high[i].tobytes()))
                yield from parcels(out, COVER_ARROW)

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            out = [r for r in rows if r[1] == INTERVALS]
            rows = [r for r in rows if r[1] == STRINGS]
            if rows:
                key, strings, ids, rk, low, high = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((2, U8), (3, np.uint8), (4, np.int64), (5, np.int64), (6, np.int64), (7, np.int64)))
                strings = strings.reshape(-1, room)
                kind, n = equal_rows(strings)
                least = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(least, kind, ids)
                gone = ids > least[kind]
                parts = [(rk[gone], low[gone], high[gone])]
                one = np.zeros(n, np.int64)
                one[kind] = np.arange(len(kind))  # a row of each class
                order = one[np.argsort(key[one], kind="stable")]
                start = runs(key[order])
                length = np.diff(np.append(start, len(order)))
                group = np.repeat(np.arange(len(start)), length)
                order, group = order[np.repeat(length > 1, length)], group[np.repeat(length > 1, length)]
                holders = np.argsort(kind, kind="stable")
                first = np.searchsorted(kind[holders], np.arange(n + 1))
                lead = leading(strings, width)
                lo = 0
                while lo < len(order):
                    hi = min(lo + params.together, len(order))
                    hi = int(np.searchsorted(group, group[hi - 1], "right"))
                    some = order[lo:hi]
                    who, offset = covered_offsets(strings[some], least[kind[some]], width)
                    if len(who):  # of each class, the rows of its least document
                        classes = kind[some][who]
                        many = first[classes + 1] - first[classes]
                        at = holders[np.repeat(first[classes], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                        off = np.repeat(offset, many)
                        stay = ~gone[at]
                        at = at[stay]
                        off = off[stay] - lead[at]
                        parts.append((rk[at], low[at] + off, low[at] + off + width))
                    lo = hi
                out += intervals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if out:
                yield from parcels(out, COVER_ARROW)

    schema = pa.schema([("rk", pa.int64()), *((x, pa.binary()) for x in ("low", "high", "at", "size", "bytes"))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            rk, low, high = merged(*joined_rows(rows, (INTERVALS,), *((k, np.int64) for k in (5, 6, 7))))
            sure = {k: (x.tobytes(), y.tobytes()) for k, x, y in rows_of(rk, low, high)}
            rk, at, size = joined_rows(rows, (PROPOSED,), *((k, np.int64) for k in (5, 6, 7)))
            texts = b"".join(r[3] for r in rows if r[1] == PROPOSED)
            end = np.cumsum(size)
            if_equal = {k: (x.tobytes(), z.tobytes(), b"".join(texts[e - c : e] for e, c in zip(y.tolist(), z.tolist(), strict=True))) for k, x, y, z in rows_of(rk, at, end, size)}
            yield packed([(k, *sure.get(k, (b"", b"")), *if_equal.get(k, (b"", b"", b""))) for k in sorted({*sure, *if_equal})], schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rk % buckets, INTERVALS, b"", b"", b"", np.full(len(low) // 8, rk, np.int64).tobytes(), low, high) for rk, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield packed(out, COVER_ARROW)

    hits = known.where(F.octet_length("positions") > 0).select("rk", "positions", "hashes", "apart")
    rows = keyed.join(hits, "rk").select("rk", "id", "text", "positions", "hashes", "apart").mapInArrow(blocks, COVER)
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(resolved, COVER)
    rows = rows.unionByName(known.where(F.octet_length("low") > 0).select("rk", "low", "high").mapInArrow(told, COVER))
    none = F.lit(b"")
    rows = rows.unionByName(bytes_of_others.select("bucket", F.lit(PROPOSED).alias("kind"), none.alias("key"), F.col("bytes").alias("strings"), none.alias("doc"), "rk", "low", F.col("size").alias("high")))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(together, RESULT)
    return materialize(rows, "dedup-covers")


def row_key() -> Column:
    """A key of rows: equal for equal ids and texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_or_empty())


def covered(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """docs with what goes of each row, as removed() reads it: low, high, at, size, bytes (null: nothing)."""
    keyed = docs.select(row_key().alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_or_empty().alias("text"))
    n = partitions_for(keyed, "text")
    buckets = 2 * n
    long_enough = keyed.where(F.octet_length("text") >= params.width)
    found = repeated_anchors(long_enough, n, params)
    names = {"low": "a", "high": "b", "positions": "c", "hashes": "d", "apart": "e"}
    known = found.where(F.col("kind") == TOLD).groupBy(F.col("key").alias("rk")).agg(*[F.first(c).alias(name) for name, c in names.items()])  # rows that repeat
    known = materialize(known, "dedup-known")
    cover = covers(long_enough, known, proposed(long_enough, found, n, buckets, params), n, buckets, params)
    return docs.withColumn("_lw_rk", row_key()).join(cover.withColumnRenamed("rk", "_lw_rk"), "_lw_rk", "left").drop("_lw_rk")


def removed(data: bytes, low: bytes | None, high: bytes | None, at: bytes | None, size: bytes | None, expected: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals to remove: the sure ones, and those whose bytes are as expected."""
    low, high, at, size = (np.frombuffer(x or b"", np.int64) for x in (low, high, at, size))
    end = np.cumsum(size)
    equal = [data[i : i + k] == expected[e - k : e] for i, k, e in zip(at.tolist(), size.tolist(), end.tolist(), strict=True)]
    at, size = at[equal], size[equal]
    both = np.append(low, at), np.append(high, at + size)
    return merged(np.zeros(len(both[0]), np.int64), *both)[1:]


WHAT = ("low", "high", "at", "size", "bytes")


def remaining(data: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    cuts = [0, *np.column_stack((low, high)).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


@tidy
def digest(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """What op8 returns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch, rows = whole.slice(lo, 500), []
                for text, *what in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                    data = (text or "").encode()
                    a, b = removed(data, *what)
                    rows.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(remaining(data, a, b)).hexdigest()))
                out = packed(rows, schema)
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return covered(docs.select("doc_id", "text"), params).select("doc_id", "text", *WHAT).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@tidy
def remove_repeats(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """docs with their texts without the repeats; bytes of a letter that was cut go with it. Other columns are unchanged."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, low: pd.Series, high: pd.Series, at: pd.Series, size: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else remaining(t.encode(), *removed(t.encode(), *what)).decode(errors="ignore") for t, *what in zip(text, low, high, at, size, expected, strict=True)])

    renamed = covered(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_lw_all")), params)
    out = renamed.withColumn("_lw_cut", cut("text", *WHAT))
    return out.select(*[F.col("_lw_cut").alias("text") if c == "text" else F.col(f"_lw_all.{c}").alias(c) for c in docs.columns])
