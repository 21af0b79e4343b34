"""Operators without SQL, held against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodeworks.llm import packing, pii, sharding, suffix_dedup, token_counts, toxicity

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# personal data ----------------------------------------------------------------------------------


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            s, d = m[0], re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f x@y.z.w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.256", "😀 a@b.co 4111 1111 1111 1111-", "+1 (988) 555-2485+1 (988) 555-2485", "4" * 5000 + " x " + "a" * 30000, "1 " * 20000]
    texts += ["".join(rng.choice("ab@@..111444  -+()2é😀\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(df).collect():
        spans = base_spans(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"foo bar{i} call me at +1 (988) 555-{1000 + i} thanks") for i in range(8)]
    rows += [(100, "so call me at 988-555-0192 thanks"), (101, "weight 988-555-0192 is"), (102, "call me at noon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert got[100] == "phone:14:26" and got[101] == got[102] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[100] == "so call me at [PHONE] thanks"


def test_contexts_find_values_written_with_blanks(spark):
    cards = [f"4111 1111 1111 1{k:03d}" for k in range(200)]
    cards = [c for c in cards if luhn(c.replace(" ", ""))][:8]
    rows = [(i, f"foo bar{i} call me at +1 (988) 555-{1000 + i} thanks") for i in range(8)] + [(20 + i, f"baz my card is {c} okay") for i, c in enumerate(cards)]
    want = {100: ("so call me at ", "(988) 555-0192", " thanks", "phone"), 101: ("so call me at ", "988 555 0192", " thanks", "phone"), 102: ("ask my card is ", "4111 1111 1111 1112", " okay", "card")}
    rows += [(i, a + v + b) for i, (a, v, b, _) in want.items()] + [(103, "weight (988) 555-0192 is"), (104, "call me at 5 or 6 thanks")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert {i: got[i] for i in want} == {i: f"{kind}:{len(a)}:{len(a + v)}" for i, (a, v, _, kind) in want.items()}
    assert got[103] == got[104] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert {i: clean[i] for i in want} == {i: f"{a}[{kind.upper()}]{b}" for i, (a, _, b, kind) in want.items()}


def test_redaction_keeps_rows(docs, none):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.redact(none).count() == pii.digest(none).count() == 0


# suffixes ---------------------------------------------------------------------------------------


def repeats(rows: list[tuple], width: int = 50) -> list[tuple]:
    key = lambda i: -(2**63) if i is None else i
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - width + 1):
            w = b[j : j + width]
            first[w] = min(first.get(w, 2**63), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < key(i):
                gone[j : j + width] = b"\1" * width
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("frequent", "crowd"), [(50_000, 512), (1, 512), (50_000, 1)])
def test_repeats(spark, docs, frequent, crowd):
    rng = random.Random(4)
    bits = ["".join(rng.choice("abé 😀") for _ in range(rng.randrange(20, 130))) for _ in range(12)]
    rows = [(i if rng.random() > 0.05 else None, "".join(rng.choice(bits) + ("x" if rng.random() < 0.3 else "") for _ in range(rng.randrange(5))) or None) for i in range(60)]
    rows += [rows[5], rows[5], (7, rows[9][1]), (1000, "a" * 500), (1001, "a" * 49), (1002, "a" * 50), (1003, "a" * 51 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = repeats([tuple(r) for r in df.collect()])
    assert rows_of(suffix_dedup.digest(df, suffix_dedup.DedupParams(frequent=frequent, crowd=crowd))) == want


def test_column_wise_order():
    """Sorted suffixes and common prefixes of random strings."""
    import numpy as np

    rng = np.random.default_rng(2)
    s = rng.integers(97, 99, (9, 16)).astype(np.uint8)
    who, offset, prefix = suffix_dedup.column_wise(s)
    found = [bytes(s[w][o:]) for w, o in zip(who, offset, strict=True)]
    assert found == sorted(found) and len(found) == 9 * 17
    for a, b, n in zip(found, found[1:], prefix[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_rounds_handle_each_string_once(monkeypatch):
    """The work of a round grows with the strings alone, and finds all windows of surroundings whose anchors stand in one column."""
    import numpy as np

    rng = random.Random(6)
    sides = [("".join(rng.choice("ab") for _ in range(22)), "".join(rng.choice("ab") for _ in range(22))) for _ in range(8)]
    seed = "".join(rng.choice("abcd") for _ in range(28))
    texts = [(x[rng.choice((0, 0, 9, 22)) :] + seed + y).encode() for x in (a for a, _ in sides) for y in (b for _, b in sides) for _ in range(3)]
    ids = np.array([rng.randrange(99) for _ in texts])
    size = np.array([len(t) for t in texts])
    lead = 72 - size
    strings = suffix_dedup.surroundings(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.zeros(len(size), np.int64), size, 72, lead)
    first: dict = {}
    for t, i in zip(texts, ids, strict=True):
        for j in range(len(t) - 49):
            first[t[j : j + 50]] = min(first.get(t[j : j + 50], 99), i)
    want = {(w, j + lead[w]) for w, t in enumerate(texts) for j in range(len(t) - 49) if first[t[j : j + 50]] < ids[w]}
    most, minima = [], suffix_dedup.range_minima
    monkeypatch.setattr(suffix_dedup, "range_minima", lambda x, low, high: most.append(len(x)) or minima(x, low, high))
    who, offset = suffix_dedup.covered_offsets(strings, ids, 50)
    assert set(zip(who.tolist(), offset.tolist(), strict=True)) == want and want
    assert max(most) == len(texts)


def test_removal_keeps_columns(docs, none):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.digest(none).count() == 0


# tokens -----------------------------------------------------------------------------------------

ODD = ["it's we're I'll '! '' 'real 'x'll", "İSTANBUL ΣΑΣ été x a", "a<|endoftext|>b <|startoftext|>", "日本語 한국어 ١٢٣ ²³ ½", "a\x1cb\x85c d​e", "", " \n", "😀😀👍🏽 naïve ﬁ ŉ ǆ"]


def samples() -> list[str]:
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab'lLrsétT.,!1²  \n\tΣ😀ß<|>") for _ in range(rng.randrange(1, 30))) for _ in range(150)]


def test_prefix_counts_are_the_librarys(spark, docs, none):
    bpe = token_counts.counter(token_counts.VOCABULARY)
    count = lambda t: len(bpe.library.encode(t, add_special_tokens=False).ids)
    for t in samples():
        assert [int(x) for x in bpe.prefixes(t)] == [count(t[:k]) for k in range(len(t) + 1)]
        assert bpe.count(t) == count(t)
    for r in token_counts.digest(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), count(r["text"] or ""), count(r["text"] or "") > 2048)
            stored = token_counts.stored_counts(r["prefix_tokens"])
            assert len(stored) == len(r["text"] or "") + 1 and stored[-1] == r["n_tokens"] and r["cut_chars"] == token_counts.longest_within(r["prefix_tokens"], 2048)
    assert token_counts.digest(none).count() == 0


def test_prefixes_of_composed_letters_and_special_strings():
    bpe = token_counts.counter(token_counts.VOCABULARY)
    count = lambda t: len(bpe.library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(7)
    parts = ["e", "\u0301", "\u0327", "a", "b", " ", "'", "s", "İ", "Σ", "1", "-", "<|endoftext|>", "<|startoftext|>", "<|", "\u1100", "\u1161", "\u11a8", "\u0915\u093c", "=\u0338"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    texts += ["ab" * 60 + "e\u0301" * 40 + "<|endoftext|>" + "e\u0301x" * 50]
    for t in texts:
        assert [int(x) for x in bpe.prefixes(t)] == [count(t[:k]) for k in range(len(t) + 1)]
    t = ("word " * 2000 + "<|endoftext|>") * 5 + "e\u0301" * 10_000 + "한국" * 10_000 + "<|startoftext|>" * 100  # over 10^5 letters
    counts = bpe.prefixes(t)
    assert len(counts) == len(t) + 1 and all(counts[k] == count(t[:k]) for k in (1000, 10_009, 50_066, 60_065, 60_066, 75_000, 90_001, len(t) - 7, len(t)))


def test_stored_prefixes_answer_budgets(spark):
    text = "The quick brown fox's naïve jumps, 42 times over lazy dogs."
    row = token_counts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    lib = token_counts.counter(token_counts.VOCABULARY).library
    n = lambda k: len(lib.encode(text[:k], add_special_tokens=False).ids)
    for budget in range(12):
        assert token_counts.longest_within(row["prefix_tokens"], budget) == max(k for k in range(len(text) + 1) if n(k) <= budget)
    assert token_counts.tokens_of_prefix(row["prefix_tokens"], 17) == n(17)


def test_packing(spark, docs, none):
    import numpy as np

    library = packing.encoder(packing.VOCABULARY)
    texts = samples() + ["word " * k for k in (10, 500, 682, 700, 1024, 2046, 2047, 2048, 2049, 5000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = defaultdict(list)
    pieces = defaultdict(list)
    for r in packing.digest(df).collect():
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in packed.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // 2048)))
        assert sum(r["length"] for r in got) == len(ids) and all(r["length"] == 2048 for r in got[1:])
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.digest(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packing.digest(none).count() == 0


def test_runs_fill_sequences():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.choice([10, 64, 2048])
        counts = Counter(rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 400)))
        bins, seen = defaultdict(list), Counter()
        runs = packing.pack_lengths(counts, cap)
        by_length = defaultdict(list)
        for run in runs:
            by_length[run[0]].append(run)
        for length, n in counts.items():
            ordered = sorted(by_length[length], key=lambda r: r[1])
            for number in range(n):
                _, first, b, m, offset = [r for r in ordered if r[1] <= number][-1]
                k, slot = divmod(number - first, m)
                bins[b + k].append((offset + slot * length, length))
                seen[length] += 1
        assert seen == counts
        for content in bins.values():
            end = 0
            for offset, length in sorted(content):
                assert offset == end
                end += length
            assert end <= cap
            assert sum(3 * length > cap for _, length in content) <= 2


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    import bisect

    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return len(gaps)


def test_ids_of_all_documents_are_the_librarys(spark, data):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += samples() + ["x" * 50_000 + " y", "<|endoftext|>" * 3 + "a <|endoftext|>", "é" * 25_000]
    library = packing.encoder(packing.VOCABULARY)
    assert all(packing.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_as_few_sequences_as_best_fit(spark, data):
    rows = packing.digest(spark.read.parquet(f"{data}/documents.parquet")).select("length", "sequence_id").collect()
    lengths = [r["length"] for r in rows]
    used = len({r["sequence_id"] for r in rows})
    assert -(-sum(lengths) // 2048) <= used <= best_fit_decreasing(lengths, 2048)


# toxicity, shards -------------------------------------------------------------------------------


def test_toxicity_learns_sentences(spark, none):
    rng = random.Random(8)
    words = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(6))
        bad = i % 4 == 0
        rows.append((i, text + (f". You {rng.choice(['vilest', 'vilestan', 'vilestor'])} thing. Good bye" if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "12 34")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(400) if got[i]["held_out"]] == held
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] <= 1 for i in (1000, 1001, 1002))
    weights = toxicity.fit(docs, lab)
    spans = toxicity.score(docs.where("doc_id = 0"), weights, locate=True).first()["offending"]
    assert [rows[0][1][s["start"] : s["end"]].split()[1][:5] for s in spans] == ["viles"]
    assert toxicity.digest(none, lab).count() == 0
    assert {r["predicted"] for r in toxicity.digest(docs, lab.limit(0)).collect()} == {0}


def test_toxicity_of_long_and_repeated_rows(spark):
    """A toxic sentence far behind the start of a text trains; repeated ids with contradicting labels give the same scores however rows are dealt."""
    rng = random.Random(2)
    plain = lambda n: ". ".join(" ".join(f"plain{rng.randrange(300)}" for _ in range(8)) for _ in range(n))
    rows = [(i, plain(500 if i % 2 else 4) + (". You vilest thing" if i % 2 else "")) for i in range(60)]
    labels = [(i, int(i % 2)) for i in range(60)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, "you vilest thing"), (2, "plain1 plain2 plain3")], "doc_id long, text string"), weights).collect()}
    assert got[1] > 0.5 > got[2]
    rows += [(i % 60, f"{t} again {i}") for i, (_, t) in enumerate(rows[:20])] + [(3, None), (None, "x")]
    labels += [(i, 1 - i % 2) for i in range(20)] + [(None, 1), (5, None)]
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        lab = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts)
        clash = docs.withColumns({c: docs["doc_id"] for c in ("label", "toxic", "_y", "score")})
        found.append(rows_of(toxicity.digest(clash, lab)))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_shards(docs, none, tmp_path):
    got = sharding.digest(docs).collect()
    n = docs.count()
    shards = Counter(r["shard"] for r in got)
    assert len(got) == n and max(shards.values()) - min([*shards.values(), n // 40]) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows_of(sharding.digest(docs)) == sorted(map(tuple, got), key=str)
    assert sharding.digest(none).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    clash = docs.withColumns({c: docs["found"] for c in ("shard", "_pid", "_row", "_at", "_p", "_shift")})
    back = sharding.write_shards(clash, str(tmp_path / "shards"), 4)
    assert set(back.columns) == {*clash.columns, "_shard", "slot"} and back.groupBy("_shard").count().count() == 4
    assert rows_of(back.select(*clash.columns)) == rows_of(clash)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    import numpy as np

    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert all(sharding.place(i, n, 7) == (int(p[i]) % 7, int(p[i]) // 7) for i in range(0, n, 13))


def test_pipeline(spark, data, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert stage(spark, none, data).count() == 0
    last = corpus_pipeline.run(spark, data)
    assert last.count() > 0 and "sequence_id" in last.columns
