"""Each stage of the pipeline on what the one before kept, against plain Python, on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from harness import of_duckdb
from test_against_brute_force import base_spans

from lodeworks.llm import packing, quality
from lodeworks.storage import materialize

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(rows: list) -> list[list]:
    """Rows by class: linked at Jaccard 0.8, equal rows once."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[top(i)].append(r)
    return list(out.values())


def prose(seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(1, 8))) for _ in range(60))


def redacted(text: str) -> str:
    out, at = "", 0
    for start, _, end, kind in base_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_one_after_the_other(spark, docs, awkward):
    base = awkward[5][1]
    mails = [(200 + i, f"write to user{i}@mail.example.org or call +1 (988) 555-{2000 + i} now. " + prose(i), "en", "s1", None, None, None, None) for i in range(30)]
    extra = [(5, base + " again and again", "en", "s1", 1, None, None, None), (None, base, "en", "s2", None, None, None, None), (None, base, "en", "s2", None, None, None, None), (7, None, None, None, None, None, None, None), (7, None, None, None, None, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(mails + extra, docs.schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mix", "pack"]
    stage = dict(corpus_pipeline.STAGES)

    columns, judged = of_duckdb(quality.oracle(), {"documents": rows})
    kept = Counter(r[columns.index("doc_id")] for r in judged if r[columns.index("kept")] == "true")
    good = materialize(stage["quality"](spark, rows, ""), "stage")
    assert Counter("null" if r["doc_id"] is None else str(r["doc_id"]) for r in good.collect()) == kept

    before = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = materialize(stage["near_duplicates"](spark, good, ""), "stage")
    after = Counter((r["doc_id"], r["text"]) for r in one.collect())
    found = classes(before)
    assert sum(after.values()) == len(found) and len(found) < len(before)
    for rows_of_class in found:
        stay = [r for r in rows_of_class if after[r]]
        assert len(stay) == 1 and after[stay[0]] == 1
        assert stay[0][0] == min((i for i, _ in rows_of_class if i is not None), default=None)

    clean = materialize(stage["personal_data"](spark, one, ""), "stage")
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, redacted(t)) for i, t in after)
    assert any("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] for r in clean.collect())

    mixed = materialize(stage["mix"](spark, clean, ""), "stage")
    assert mixed.columns == docs.columns
    size, times = defaultdict(int), Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    for r in clean.collect():
        size[r["source"]] += len(WORDS.findall(r["text"]))
        assert times[r["doc_id"], r["text"], r["source"]] <= 2
    ranks = sorted(size, key=lambda s: (s is None, s))
    weights, budget, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(ranks)}, 1.5 * sum(size.values()), set()
    while True:  # targets stop at twice a source's size, the rest is dealt out by weight
        level = (budget - sum(2 * size[s] for s in full)) / sum(weights[s] for s in ranks if s not in full) if len(full) < len(ranks) else 0
        over = {s for s in ranks if s not in full and weights[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in ranks:
        target = 2 * size[s] if s in full else weights[s] * level
        longest = max((len(WORDS.findall(r["text"])) for r in clean.collect() if r["source"] == s), default=0)
        assert abs(sum(len(WORDS.findall(t)) * n for (_, t, source), n in times.items() if source == s) - target) <= longest

    packed = stage["pack"](spark, mixed, "").collect()
    library = packing.encoder(packing.VOCABULARY)
    assert sum(r["length"] for r in packed) == sum(n * (1 + len(library.encode(t, add_special_tokens=False).ids)) for (_, t, _), n in times.items())
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in sequences.values():
        ends = [0]
        for offset, length in sorted(content):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
