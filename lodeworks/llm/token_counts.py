"""Token counts of every prefix by dynamic programming over a BPE vocabulary.

A sequence of tokens is a BPE encoding exactly if each token and each adjacent pair of tokens is the
encoding of its own string. So the encoding of a prefix ends in the one token that is compatible with
the last token of the encoding of what stands before it, and the count at a prefix is one more than
the count there. Words end in a mark; a prefix that ends inside a word is a word of its own, so each
prefix has an open encoding (the word goes on) and a closed one, by the same rule.

Stored counts answer how many tokens a cut text has, and where to cut for a budget, without encoding;
the count of a whole text is that of its last prefix. Runs without white space are remembered with the
counts of all their prefixes. Texts are taken apart at special strings, where the library starts anew, and
prefixes that end inside a letter that normalisation composes continue the states of the run before it.

Defined cases: a null text is empty and has 0 tokens; repeated rows count each; special strings in a
text are one token each, as in the library, and ordinary text while a prefix ends inside them; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

VOCABULARY, LIMIT = "word_bpe_49k", 2048
#: Entries of a worker's memory of words; it is cleared when full.
REMEMBERED = 600_000
SHORT = (2, 1)
#: Letters of words that share the states of their common prefixes.
SHARED = 64
#: White space for the vocabulary's pattern.
SPACES = re.compile("([\t-\r \x85\xa0  -     　]+)")
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Remembered(dict):
    """A function of strings that remembers its values, so many at a time: the older half goes when it is full."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        if len(self) > REMEMBERED:
            for old in list(itertools.islice(self, len(self) // 2)):
                del self[old]
        value = self[key] = self.function(key)
        return value


@functools.cache
def followers() -> frozenset:
    """Letters that may join the one before them when a text is composed: second in a decomposition, or a part of a Hangul syllable."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0xA0, 0x30000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


def composed(s: str) -> str:
    return unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()


class PrefixBpe:
    """Counts for a vocabulary of words with end marks."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{vocabulary}.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.made: dict[str, tuple[str, str, int]] = {}  # token -> the two it is merged from, and when
        for (a, b), k in self.ranks.items():
            self.made.setdefault(a + b, (a, b, k))
        vocab = spec["model"]["vocab"]
        self.inner = {t for t in vocab if not t.endswith(END)}
        self.final = {t[: -len(END)] for t in vocab if t.endswith(END)}
        self.longest = max(map(len, self.inner | self.final))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.pairs: dict[tuple, bool] = {}
        self.alone: dict[tuple, bool] = {}
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.inner_lengths, self.final_lengths = self.by_ending(self.inner), self.by_ending(self.final)
        #: Of beginnings of words: the tokens of each prefix as a word, and the state as an open prefix, if a longer one needed it.
        self.ended: dict[str, bytes] = {"": b""}
        self.opened: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.runs = Remembered(self.of_run)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the adjacent pair of the least rank is merged, leftmost first."""
        ranks, far = self.ranks, len(self.ranks)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), far))
            if (symbols[best], symbols[best + 1]) not in ranks:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def own(self, token: str, end: str) -> bool:
        """Whether the token is the encoding of its own string."""
        key = (token, end)
        if (known := self.alone.get(key)) is None:
            known = self.alone[key] = self.merge([*token[:-1], token[-1] + end]) == [token + end]
        return known

    def compatible(self, before: str, token: str, end: str) -> bool:
        """Whether no merge crosses from one token into the next while both are being built.

        Beside the boundary stand, one after the other in time, the right parts of the left token and the
        left parts of the right one. Two of them merge if their rank comes before either is merged away;
        of equal ranks the leftmost comes first.
        """
        key = (before, token, end)
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        ranks, made, far = self.ranks, self.made, len(self.ranks)
        known, left, left_gone = True, before, far
        while known:
            right, right_gone = token + end, far
            while True:
                if (rank := ranks.get((left, right))) is not None and rank < left_gone and rank <= right_gone:
                    known = False
                    break
                if right not in made:
                    break
                right, _, right_gone = made[right]
            if left not in made:
                break
            _, left, left_gone = made[left]
        self.pairs[key] = known
        return known

    @staticmethod
    def by_ending(tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """Lengths, longest first, of the tokens with an ending of three letters; tokens of two and one come last with every ending."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        return {e: (*sorted(n, reverse=True), *SHORT) for e, n in found.items()}

    def close(self, word: str, j: int, state) -> int:
        """Tokens of word[:j] as a whole word, from the states (last token and count) of shorter open prefixes."""
        for n in self.final_lengths.get(word[j - 3 : j], SHORT) if j > 2 else SHORT:
            if n <= j and (t := word[j - n : j]) in self.final:
                if n == j:
                    if self.own(t, END):
                        return 1
                    continue
                last, count = state(j - n)
                if (known := self.pairs.get((last, t, END))) or known is None and self.compatible(last, t, END):
                    return count + 1
        return 0

    def open(self, word: str, j: int, state) -> tuple[str, int]:
        """The state of the open prefix word[:j], from those of shorter ones."""
        for n in self.inner_lengths.get(word[j - 3 : j], SHORT) if j > 2 else SHORT:
            if n <= j and (t := word[j - n : j]) in self.inner:
                if n == j:
                    if self.own(t, ""):
                        return t, 1
                    continue
                last, count = state(j - n)
                if (known := self.pairs.get((last, t, ""))) or known is None and self.compatible(last, t, ""):
                    return t, count + 1
        return "", 0

    def extend(self, word: str, states: list[tuple[str, int]], closed: list[int] | None = None) -> None:
        """Carry the states to the end of a word in byte letters; closed gets the counts of the prefixes as words."""
        for j in range(len(states), len(word) + 1):
            if closed is not None:
                closed.append(self.close(word, j, states.__getitem__))
            states.append(self.open(word, j, states.__getitem__))

    def ends(self, word: str) -> bytes | list[int]:
        """Tokens of each prefix of a word as a word. Short words share what their common prefixes have."""
        if len(word) > SHARED:
            out: list[int] = []
            self.extend(word, [("", 0)], out)
            return out
        ended, opened = self.ended, self.opened
        if len(ended) > REMEMBERED:
            ended.clear()
            opened.clear()
            ended[""], opened[""] = b"", ("", 0)
        j = len(word)
        while (known := ended.get(word[:j])) is None:
            j -= 1
        if j == len(word):
            return known
        state = lambda i: opened[word[:i]]
        if (key := word[:j]) not in opened:  # a word so far, now the beginning of a longer one
            opened[key] = self.open(word, j, state)
        for j in range(j + 1, len(word) + 1):
            key = word[:j]
            known = ended[key] = known + bytes((self.close(word, j, state),))
            if j < len(word):
                opened[key] = self.open(word, j, state)
        return known

    def spelled(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def of_piece(self, piece: str) -> bytes | list[int]:
        """Tokens of each prefix of a piece, the empty one left out."""
        if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # a contraction: its prefixes are cut otherwise
            return bytes(sum(self.closed(p)[-1] for p in self.pattern.findall(piece[:k])) for k in range(1, len(piece) + 1))
        return self.closed(piece)

    def closed(self, piece: str) -> bytes | list[int]:
        out = self.ends(self.spelled(piece))
        if piece.isascii():
            return out
        at = itertools.accumulate(len(c.encode()) for c in piece)
        return bytes(out[e - 1] for e in at) if type(out) is bytes else [out[e - 1] for e in at]

    def of_run(self, run: str) -> bytes | tuple[int, ...]:
        """Tokens of each prefix of a run without white space, the empty one left out: as bytes, if they fit."""
        if run.isalpha():  # one piece
            inner = self.closed(run)
            return inner if type(inner) is bytes else tuple(inner)
        out: list[int] = []
        done = 0
        for m in self.pattern.finditer(run):
            out += [done] * (m.start() - len(out))
            inner = self.of_piece(m[0])
            out += [done + n for n in inner] if done else inner
            done = out[-1]
        out += [done] * (len(run) - len(out))
        return bytes(out) if max(out, default=0) < 256 else tuple(out)

    def of_plain(self, plain: str) -> np.ndarray:
        """Tokens of plain[:k] for k = 0.., of a composed text in lower case without special strings."""
        parts = SPACES.split(plain)
        runs = list(map(self.runs.__getitem__, parts[::2]))
        try:
            inner = np.frombuffer(b"".join(runs), np.uint8)
        except TypeError:
            inner = np.fromiter(itertools.chain.from_iterable(runs), np.uint32)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        totals = np.zeros(len(parts), np.int64)
        totals[::2] = [r[-1] if r else 0 for r in runs]
        done = np.cumsum(totals)
        out = np.zeros(len(plain) + 1, np.uint32)
        before = done - totals  # a run counts from what stands before it; white space adds nothing
        out[1:] = np.repeat(before, lens)
        if len(parts) == 1:
            out[1:] += inner
        else:
            in_run = np.repeat(np.arange(len(parts)) % 2 == 0, lens)
            out[1:][in_run] += inner
        return out

    def of_segment(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k = 0.., of a text without special strings."""
        if text.isascii():
            return self.of_plain(text.lower())
        if unicodedata.is_normalized("NFC", text):
            plain = text.replace("Σ", "σ").lower()
            if len(plain) == len(text):
                return self.of_plain(plain)
        # letters with what joins them: their composed forms make up the whole, and prefixes that end inside one are closed apart
        join = followers()
        starts = [k for k, c in enumerate(text) if not k or not (unicodedata.combining(c) or c in join)]
        letters = [text[a:b] for a, b in itertools.pairwise([*starts, len(text)])]
        forms = list(map(composed, letters))
        plain = "".join(forms)
        whole = self.of_plain(plain)
        out = np.zeros(len(text) + 1, np.uint32)
        ends = list(itertools.accumulate(map(len, forms), initial=0))
        out[[*starts, len(text)]] = whole[ends]
        inside = [(s + k, p, composed(letter[:k])) for s, p, letter in zip(starts, ends, letters, strict=False) if len(letter) > 1 for k in range(1, len(letter))]
        if inside:
            pieces, at, known = [m.span() for m in self.pattern.finditer(plain)], 0, OpenPiece(self, plain, 0)
            for k, p, form in inside:
                while at < len(pieces) and pieces[at][1] < p:
                    at += 1
                start = pieces[at][0] if at < len(pieces) and pieces[at][0] < p <= pieces[at][1] else p
                if known.start != start:
                    known = OpenPiece(self, plain, start)
                out[k] = whole[start] + known.ended(p, form)
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text: the count of its last prefix."""
        return int(self.prefixes(text)[-1])

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k = 0..len(text), as the library would count each."""
        parts = self.cuts.split(text) if "<|" in text else [text]
        if len(parts) == 1:
            return self.of_segment(text)
        out, done = [np.zeros(1, np.uint32)], 0
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            counts = self.of_segment(parts[k] + special[:-1])  # a special string is text until it is whole
            out.append(counts[1:] + np.uint32(done))
            done += int(counts[len(parts[k])]) + bool(special)
            if special:
                out.append(np.array([done], np.uint32))
        return np.concatenate(out)


class OpenPiece:
    """The states of the piece of plain that begins at start, carried on as far as they are asked for."""

    def __init__(self, bpe: PrefixBpe, plain: str, start: int) -> None:
        self.bpe, self.plain, self.start, self.upto = bpe, plain, start, start
        self.word, self.states = "", [("", 0)]

    def ended(self, p: int, tail: str) -> int:
        """Tokens of plain[start:p] + tail, for growing p. The last letters of the piece and their states are enough."""
        bpe, head = self.bpe, self.plain[max(self.start, p - 2) : p]
        if p - self.start <= 2:
            return sum(bpe.of_piece(x)[-1] for x in bpe.pattern.findall(head + tail))
        new, self.upto = bpe.spelled(self.plain[self.upto : p]), p
        self.word += new
        self.extend(self.word, self.states)
        keep = 2 * bpe.longest
        if len(self.word) > 4 * keep:  # a token that ends from here on cannot begin before what stays
            self.word, self.states = self.word[-keep:], self.states[-keep - 1 :]
        first, *rest = bpe.pattern.findall(head + tail)  # the piece goes on as far as the first
        word, states = self.word + bpe.spelled(first[len(head) :]), list(self.states)
        self.extend(word[:-1], states)
        return bpe.close(word, len(word), states.__getitem__) + sum(bpe.of_piece(x)[-1] for x in rest)

    def extend(self, word: str, states: list[tuple[str, int]]) -> None:
        self.bpe.extend(word, states)


@functools.cache
def counter(vocabulary: str) -> PrefixBpe:
    return PrefixBpe(vocabulary)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as deflated differences of neighbours, behind a byte that tells their width."""
    steps = np.diff(counts.astype(np.int64))
    kind = "<i1" if not len(steps) or np.abs(steps).max() < 128 else "<i4"
    return kind[-1:].encode() + zlib.compress(steps.astype(kind).tobytes(), 1)


def stored_counts(prefix_tokens: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(prefix_tokens[1:]), f"<i{prefix_tokens[:1].decode()}")
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(steps, dtype=np.int64)))


def tokens_of_prefix(prefix_tokens: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points."""
    counts = stored_counts(prefix_tokens)
    return int(counts[min(n_chars, len(counts) - 1)])


def longest_within(prefix_tokens: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(stored_counts(prefix_tokens) <= budget)[-1])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, budget: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, cut_chars, prefix_tokens of every row.

    prefix_tokens holds the count of each prefix, by code points (stored_counts() reads it); n_tokens is
    its last, cut_chars the length of the longest prefix within the budget.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "cut_chars")), T.StructField("prefix_tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary)
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                counts = bpe.prefixes(text)
                n = int(counts[-1])
                within = len(text) if n <= budget else int(np.flatnonzero(counts <= budget)[-1])
                rows.append((len(text.encode()), n, within, pack_counts(counts)))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@tidy
def digest(docs: DataFrame) -> DataFrame:
    """What op7 returns, with the cut for the limit and the stored prefix counts."""
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_chars", "prefix_tokens")
