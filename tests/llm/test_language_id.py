import tracemalloc
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest

from edgeloom.llm import language_id as lid

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def all_segmentations(word, probability):
    """The sum over every way to cut the word."""
    total = np.zeros_like(next(iter(probability.values())))
    for cuts in product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        if all(p in probability for p in parts):
            total = total + np.prod([probability[p] for p in parts], axis=0)
    return total


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba", b" ab"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 3))
    p[-1] = 0
    index = lid.Pieces(pieces)
    for word in (b" a", b" abab", b" bbaab", b" ababab"):
        got = lid.Lattice(index, [word, word]).forward(p)[-1]
        want = all_segmentations(word, {x: p[k] for k, x in enumerate(pieces)})
        assert np.allclose(got, [want, want])


def test_fit_raises_the_likelihood():
    index = lid.vocabulary(RANKS)
    words, counts = [b" the", b" then", b" other", b" le", b" les", b" \xc3\xa9t\xc3\xa9"], np.array([[9, 0], [5, 0], [3, 0], [0, 9], [0, 5], [0, 2.0]])
    log = lambda p: sum((np.log(lid.Lattice(index, [w]).forward(p)[-1][0]) * c).sum() for w, c in zip(words, counts))
    values = [log(lid.fit(index, words, counts, n)) for n in (1, 3, 6)]
    assert values == sorted(values)
    assert np.allclose(lid.fit(index, words, counts).sum(axis=0), 1)


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "12 !? 3.", "en", "x"), (None, "the dog", "en", "x"), (7, "le " * 50_000, "fr", "x"), (8, "Ünïcode" + "a" * 5000, None, "x"), (1, "the cat and the dog", "en", "x")], "doc_id long, text string, lang string, score string")
    rows = lid.identify(df, RANKS).collect()
    assert len(rows) == 9
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (3, 4, 5))
    none = lid.identify(df.limit(0), RANKS)
    assert none.count() == 0
    assert {r.lang_pred for r in lid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).filter("lang is null"), RANKS).collect()} == {"und"}


def test_learns_only_from_its_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    out = lid.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(docs["lang"]))
    a, b = (sorted(map(tuple, lid.identify(d, RANKS, sample_docs=10**6).collect())) for d in (docs, other))
    assert a == b


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lid.identify(docs, RANKS).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def plain_log(word, log_p, longest):
    """The log of the sum over all segmentations, by adding logs one after another."""
    import math

    a = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        terms = [a[s] + log_p[word[s:e]] for s in range(max(0, e - longest), e) if word[s:e] in log_p]
        top = max(terms)
        a[e] = top + math.log(sum(math.exp(t - top) for t in terms))
    return a[-1]


def small_vocabulary(tmp_path):
    import base64

    own = [" th", "the", " the", "le", " le", "letters", " internation", "international", "aa", "aaa", "дом", " дом", "ра", "при", "привет"]
    pieces = [bytes([b]) for b in range(256)] + [x.encode() for x in own]
    path = tmp_path / "ranks.tiktoken"
    path.write_text("".join(f"{base64.b64encode(x).decode()} {k}\n" for k, x in enumerate(pieces)))
    return str(path), pieces


def test_texts_against_plain_sums(spark, tmp_path):
    path, pieces = small_vocabulary(tmp_path)
    assert max(map(len, pieces)) > 12
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces) + 1, 3)) ** 4
    p[-1] = 0
    p /= p.sum(axis=0)
    words = ["the", "letters", "international", "internationalletters", "приветдом", "дом", "a" * 200, "le" * 150, "x" * 90, "日本語" * 40, "привет" * 30, "qué"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)] + ["The INTERNATIONAL, letters; дом!", "a" * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r["__lang"], r["__score"]) for r in lid.predict(df, path, ["aa", "bb", "cc"], p).collect()}
    import regex

    for k, text in enumerate(texts):
        logs = np.array([sum(plain_log(b" " + w.encode(), {x: np.log(p[n, lang]) for n, x in enumerate(pieces)}, 20) for w in regex.findall(r"\p{L}+", text.lower())) for lang in range(3)])
        shares = np.exp(logs - logs.max())
        assert got[k][0] == ["aa", "bb", "cc"][int(logs.argmax())] and abs(got[k][1] - shares.max() / shares.sum()) < 1e-6


def test_cuts_and_long_parts_change_no_sum(tmp_path):
    path, pieces = small_vocabulary(tmp_path)
    index = lid.vocabulary(path)
    rng = np.random.default_rng(3)
    p = rng.random((index.count + 1, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    for word in (b" " + b"letters" * 30, b" " + b"a" * 300, "дом привет".encode() * 20):
        assert b"".join(lid.parts_of(index, word)) == word
        whole = lid.log_forward(index.all_in(word), p)[-1]
        parts = sum(lid.log_forward(index.all_in(x), p)[-1] for x in lid.parts_of(index, word))
        assert np.allclose(whole, parts) and np.isfinite(whole).all()
    word = b" theletters" * 3
    want = lid.Lattice(index, [word]).expected(p, np.array([[2.0, 3.0]]))
    got = np.zeros_like(p)
    lid.log_expected(index.all_in(word), p, np.array([2.0, 3.0]), got)
    assert np.allclose(got, want)


def test_longest_pieces_of_the_public_vocabulary_are_used():
    index = lid.vocabulary(RANKS)
    assert index.longest > 12
    words = [b" internationale", b" a"]
    p = lid.fit(index, words * 2, np.ones((4, 1)))
    longest = max(len(x) for x in words)
    assert index.all_in(words[0]).shape == (longest, min(longest, index.longest)) and np.allclose(p.sum(axis=0), 1)


def test_counts_take_little_of_the_drivers_memory():
    found = [(b"w%d" % (k % 30_000), "ab"[k // 30_000], k) for k in range(60_000)]
    tracemalloc.start()
    keys, counts = lid.tabled(((bytes(bytearray(w)), lang, n) for w, lang, n in found), ["a", "b"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == sorted({w for w, _, _ in found}) and counts[keys.index(b"w7")].tolist() == [7, 30_007]
    # An array for each word would take 200 bytes more.
    assert peak < 300 * len(keys)
