"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The probability of a word (a run
of letters in lower case, with a space before it) is the sum over all its segmentations into pieces of the
products of their probabilities, which the forward algorithm computes; a text's is the product over its words.
The piece probabilities are fitted by expectation maximisation, with forward and backward sums, on all words of
``SAMPLE_DOCS`` documents a language (about, chosen by a hash of the id), which is the bound of the sample. All
texts are predicted whole.

Long words are first cut where no piece of the vocabulary crosses: every segmentation has a bound there, so the
sum over the whole is the product of the sums over the parts. Parts of up to ``TOGETHER`` bytes go through the
lattice many at a time; longer ones, such as a letter repeated, one at a time with scaled numbers.

Only documents whose crc32 of the id as text leaves a remainder other than 1 by 3, with text and language, are
learnt from. A prediction uses the text alone: the language of the highest probability, the first by name of
several, and as score its share in the sum over languages, each equally likely beforehand.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text if there is
nothing to learn from; runs of letters of any length are scored whole; a null id is not held out; repeated rows
give repeated rows; an empty table gives an empty table; other columns are not read. The model, a number for each
piece and language, is sent to all executors, so more than ``MOST_LANGS`` languages raise.
"""

from __future__ import annotations

import base64
import ctypes
import gc
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SAMPLE_DOCS = 1500
MOST_LANGS = 512
ROUNDS = 4
SMOOTHING = 0.05
TOGETHER = 40
CACHE = 300_000
CACHED_BYTES = 256
TABLE_BITS = 21

_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def vocabulary(rank_file: str) -> "Pieces":
    with open(rank_file, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines]
    return Pieces([t for t in tokens if len(t) == 1 or _wordlike(t)])


def _wordlike(token: bytes) -> bool:
    """Might lie in a space and letters: also parts of characters."""
    return all(b >= 128 or chr(b).isalpha() and chr(b).islower() for b in token.removeprefix(b" "))


class Pieces:
    """Numbers of byte strings by a polynomial hash: one look-up in a table, and a search where two share a slot."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.count = len(pieces)
        h = np.zeros(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            v = 0
            for b in p:
                v = (v * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            h[k] = v
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.hash = h
        slot = self._slot(h)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[slot] = np.arange(len(pieces))
        used, times = np.unique(slot, return_counts=True)
        self.table[used[times > 1]] = -2
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * _SLOT) >> np.uint64(64 - TABLE_BITS)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or ``count``."""
        found = self.table[self._slot(h)].astype(np.int64)
        shared = np.nonzero(found == -2)[0]
        if len(shared):
            at = np.minimum(np.searchsorted(self.sorted, h[shared]), self.count - 1)
            found[shared] = np.where(self.sorted[at] == h[shared], self.order[at], -1)
        return np.where((found >= 0) & (self.hash[np.maximum(found, 0)] == h), found, self.count).astype(np.int32)

    def all_in(self, word: bytes) -> np.ndarray:
        """numbers[e][k]: the piece that ends after byte e with k + 1 bytes, or ``count``."""
        length = len(word)
        letters = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        out = np.full((length, min(self.longest, length)), self.count, np.int32)
        h = np.zeros(length, np.uint64)
        for k in range(out.shape[1]):
            # The hash of the k + 1 bytes up to each place is that of the k bytes up to it and one byte before them.
            h = h[1:] + letters[: length - k] * self.powers[k] if k else letters
            out[k:, k] = self.numbers(h)
        return out


def parts_of(pieces: Pieces, word: bytes) -> list[bytes]:
    """The word, cut wherever no piece crosses."""
    if len(word) <= TOGETHER:
        return [word]
    found = pieces.all_in(word) < pieces.count
    crossed = np.zeros(len(word) + 1, np.int64)
    for k in range(1, found.shape[1]):
        # A piece of k + 1 bytes that ends after byte e crosses the k places before that byte.
        ends = np.nonzero(found[:, k])[0]
        np.add.at(crossed, ends - k + 1, 1)
        np.add.at(crossed, ends + 1, -1)
    cuts = np.nonzero(np.cumsum(crossed)[1:-1] == 0)[0] + 1
    # Parts that together stay short needn't be cut.
    out, start = [], 0
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)]):
        if hi - start > TOGETHER and lo > start:
            out.append(word[start:lo])
            start = lo
    return [*out, word[start:]]


def log_forward(numbers: np.ndarray, p: np.ndarray) -> np.ndarray:
    """numbers: length x sizes, as of ``all_in``. Logs of the forward sums at all places, places x languages; they are
    scaled on the way, so that words of any length have them."""
    length, sizes = numbers.shape
    out = np.zeros((length + 1, p.shape[1]))
    window, scale = np.zeros((sizes, p.shape[1])), np.zeros(p.shape[1])
    window[0] = 1
    for e in range(length):
        now = (window * p[numbers[e]]).sum(axis=0)
        window[1:] = window[:-1]
        window[0] = now
        if e % 8 == 7 or (now < 1e-200).any():
            most = np.maximum(window.max(axis=0), 1e-300)
            window /= most
            scale += np.log(most)
            now = window[0]
        out[e + 1] = np.log(np.maximum(now, 1e-300)) + scale
    return out


def log_expected(numbers: np.ndarray, p: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` how often each piece is used over all segmentations of one word."""
    length, sizes = numbers.shape
    ahead = log_forward(numbers, p)
    turned = np.full_like(numbers, len(p) - 1)
    for k in range(sizes):
        turned[k:, k] = numbers[k:, k][::-1]
    behind = log_forward(turned, p)[::-1]
    for k in range(sizes):
        n = numbers[k:, k]
        share = np.exp(np.minimum(ahead[: length - k] + behind[k + 1 :] - ahead[length], 700.0)) * p[n] * weights
        for lang in range(p.shape[1]):
            out[:, lang] += np.bincount(n, share[:, lang], len(p))
    out[-1] = 0


class Lattice:
    """The pieces of words of one length: numbers[e][k] are those that end at byte e with k + 1 bytes."""

    def __init__(self, pieces: Pieces, words: list[bytes]) -> None:
        length = len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        self.length, self.words = length, len(words)
        prefix = np.zeros((length + 1, len(words)), np.uint64)
        for e in range(length):
            prefix[e + 1] = prefix[e] * _BASE + letters[:, e]
        self.numbers = [[pieces.numbers(prefix[e] - prefix[e - k] * pieces.powers[k]) for k in range(1, min(pieces.longest, e) + 1)] for e in range(1, length + 1)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: pieces x languages with a last row of zeros. Returns places x words x languages."""
        a = np.zeros((self.length + 1, self.words, p.shape[1]))
        a[0] = 1
        for e, by_size in enumerate(self.numbers, 1):
            for k, n in enumerate(by_size, 1):
                a[e] += a[e - k] * p[n]
        return a

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of words that occur ``weights`` times."""
        a = self.forward(p)
        b = np.zeros_like(a)
        b[self.length] = weights / np.maximum(a[self.length], 1e-300)
        out = np.zeros_like(p)
        for e in range(self.length, 0, -1):
            for k, n in enumerate(self.numbers[e - 1], 1):
                part = b[e] * p[n]
                b[e - k] += part
                part *= a[e - k]
                for lang in range(p.shape[1]):
                    out[:, lang] += np.bincount(n, part[:, lang], len(p))
        out[-1] = 0
        return out


def runs(token: bytes) -> list[bytes]:
    """The words in a stretch of text, each with a space before it."""
    return [b" " + run.encode() for run in _LETTERS.findall(token.decode("utf-8", "replace").lower())]


def _by_length(words: list[bytes], at_once: int = 8192) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for _, ks in sorted(groups.items()):
        for lo in range(0, len(ks), at_once):
            yield ks[lo : lo + at_once]


def fit(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """counts: words x languages. Returns the piece probabilities, pieces x languages with a row of zeros."""
    p = np.full((pieces.count + 1, counts.shape[1]), 1.0 / pieces.count)
    p[-1] = 0
    cut = [(part, k) for k, word in enumerate(words) for part in parts_of(pieces, word)]
    short = [(part, k) for part, k in cut if len(part) <= TOGETHER]
    long = [(pieces.all_in(part), counts[k]) for part, k in cut if len(part) > TOGETHER]
    of = np.array([k for _, k in short], np.int64)
    lattices = [(Lattice(pieces, [short[k][0] for k in ks]), counts[of[ks]]) for ks in _by_length([part for part, _ in short])]
    for _ in range(rounds):
        used = np.zeros_like(p)
        for lattice, weights in lattices:
            used += lattice.expected(p, weights)
        for numbers, weights in long:
            log_expected(numbers, p, weights, used)
        used[:-1] += SMOOTHING
        p = used / used.sum(axis=0)
    return p


class Scorer:
    """Log probabilities of the words of texts by language; stretches seen are remembered up to a bound."""

    def __init__(self, pieces: Pieces, p: np.ndarray) -> None:
        self.pieces, self.p = pieces, p
        self._forget()

    def _forget(self, room: int = CACHE) -> None:
        self.known: dict[bytes, int] = {}
        self.logs = np.zeros((max(room, CACHE), self.p.shape[1]))

    def _learn(self, tokens: list[bytes]) -> None:
        start = len(self.known)
        self.logs[start : start + len(tokens)] = self._scored(tokens)
        self.known.update(zip(tokens, range(start, start + len(tokens)), strict=True))

    def _scored(self, tokens: list[bytes]) -> np.ndarray:
        logs = np.zeros((len(tokens), self.p.shape[1]))
        found = [(k, part) for k, t in enumerate(tokens) for r in runs(t) for part in parts_of(self.pieces, r)]
        short = [x for x in found if len(x[1]) <= TOGETHER]
        for ks in _by_length([part for _, part in short]):
            ends = np.log(np.maximum(Lattice(self.pieces, [short[k][1] for k in ks]).forward(self.p)[-1], 1e-300))
            np.add.at(logs, np.array([short[k][0] for k in ks]), ends)
        for k, part in found:
            if len(part) > TOGETHER:
                logs[k] += log_forward(self.pieces.all_in(part), self.p)[-1]
        return logs

    def score(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        # Long stretches aren't remembered, so that what is remembered stays small.
        long = [[x for x in tokens if len(x) > CACHED_BYTES] for tokens in split]
        split = [[x for x in tokens if len(x) <= CACHED_BYTES] if some else tokens for tokens, some in zip(split, long)]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > len(self.logs):
            new = set().union(*split)
            self._forget(len(new))
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        out = np.zeros((len(texts), self.p.shape[1]))
        for k, tokens in enumerate(split):
            if tokens:
                out[k] = self.logs[np.fromiter(map(get, tokens), np.int64, len(tokens))].sum(axis=0)
            for token in long[k]:
                out[k] += self._scored([token])[0]
        return out


def in_parts(batch: pa.RecordBatch, text: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``size`` bytes of text, with the texts."""
    column = pc.cast(batch.column(text), pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
        yield batch.slice(lo, hi - lo), [t or b"" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages by name and piece probabilities."""
    own = df.select(df[id_col].cast("string").alias("id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    own = own.filter(~held_out(df[id_col])).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, 0))
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{len(sizes)} languages; there may be {MOST_LANGS}")
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(-(-1_000_000 * sample_docs // n))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist(), strict=True):
                for token, n in Counter(text.split()).items():
                    for run in runs(token):
                        seen.setdefault(lang, Counter())[run] += n
            flat = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in flat], pa.string()), "word": pa.array([x[1] for x in flat], pa.binary()), "n": pa.array([x[2] for x in flat], pa.int64())})

    chosen = own.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("lang", "text")
    words = chosen.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    keys, counts = tabled(((bytes(r["word"]), r["lang"], r["n"]) for r in words.toLocalIterator()), langs)
    if not keys:
        return [], np.zeros((0, 0))
    p = fit(vocabulary(rank_file), keys, counts)
    del keys, counts
    give_back()
    return langs, p


def tabled(found: Iterable[tuple[bytes, str, int]], langs: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The words in order, and their counts, words x languages. While it reads, a word is a number and a count three."""
    numbers: dict[bytes, int] = {}
    at, of, n = array("q"), array("q"), array("d")
    place = {lang: k for k, lang in enumerate(langs)}
    for word, lang, count in found:
        at.append(numbers.setdefault(word, len(numbers)))
        of.append(place[lang])
        n.append(count)
    counts = np.zeros((len(numbers), len(langs)))
    np.add.at(counts, (np.frombuffer(at, np.int64), np.frombuffer(of, np.int64)), np.frombuffer(n))
    keys = sorted(numbers)
    return keys, counts[[numbers[k] for k in keys]]


def give_back() -> None:
    """Memory that is free again goes back to the system, where the C library can do that; it would stay with the driver
    for the rest of the session."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def predict(df: DataFrame, rank_file: str, langs: list[str], p: np.ndarray, text_col: str = "text", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """One row per row of ``df``: all its columns, and language and score by ``names``; columns of those names that
    ``df`` has give way to them."""
    df = df.select(*[df[c] for c in df.columns if c.lower() not in {n.lower() for n in names}])
    columns = list(df.columns)
    at = columns.index(text_col)
    model = df.sparkSession.sparkContext.broadcast(p.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary(rank_file), model.value) if langs else None
        for batch in batches:
            for part, texts in in_parts(batch, at):
                found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if scorer:
                    logs = scorer.score(texts)
                    some = np.nonzero(logs.any(axis=1))[0]
                    for k in some:
                        shares = np.exp(logs[k] - logs[k].max())
                        best = int(shares.argmax())
                        found[k], scores[k] = langs[best], shares[best] / shares.sum()
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(columns))), pa.array(found, pa.string()), pa.array(scores)], names=[*columns, *names])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema)


def identify(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    langs, p = train(df, rank_file, id_col, text_col, lang_col, sample_docs)
    texts = df.select(df[id_col].alias("doc_id"), held_out(df[id_col]).alias("held_out"), df[text_col].cast("string").alias("text"))
    return predict(texts, rank_file, langs, p, "text").select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
