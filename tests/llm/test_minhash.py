import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import minhash
from edgeloom.llm.words import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(docs):
    """docs: (id, text), ids once. Returns id -> (n, component)."""
    root, sizes = by_hand_rows(docs)
    return {d: (sizes[k], root[d]) for k, (d, _) in enumerate(docs)}


def by_hand_rows(docs):
    """docs: (id, text), ids as often as you like. Returns id -> component, and the set's size of each row."""
    sets = {k: shingle_set(t) for k, (_, t) in enumerate(docs)}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    of = {}
    for d, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in of.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(docs[a][0]), find(docs[b][0])
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}, [len(sets[k]) for k in range(len(docs))]


def same(rows, docs):
    want = by_hand(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def edited(rng, words, share):
    return [w if rng.random() > share else "e%d" % rng.randrange(10**6) for w in words]


def test_estimate():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 500).astype(np.uint64)
        a, b = pool[:400], pool[100:]
        sig = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
        errors.append((sig[0] == sig[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = minhash.signatures(pool[:1], np.zeros(1, np.int64), 1)
    assert sorted((one[0] >> np.uint64(40)).tolist()) == list(range(minhash.REGISTERS))


def test_shingles_are_those_of_the_contract():
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e f a b c d e", "É é\xa0x y\x85z\x0bq", "one two three four"]
    for t in texts:
        assert len(minhash.shingles(t.encode(), WordHashes())) == len(shingle_set(t))
    assert not set(minhash.shingles(b"a b c d", WordHashes()).tolist()) & set(minhash.shingles(b"a b c d e", WordHashes()).tolist())


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    docs = []
    for group in range(12):
        words = ["g%dw%d" % (group, rng.randrange(300)) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            docs.append(" ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))))
    chain = ["c%d" % k for k in range(200)]
    docs += [" ".join(chain[k * 9 : k * 9 + 100]) for k in range(9)]
    passage = " ".join("p%d" % k for k in range(60))
    docs += [passage + " " + " ".join("q%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(40)]
    docs += ["", " \n", None, "one", "ONE", "one two", "one two", "x " * 3000, "x " * 7]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n long").withColumn("key", F.lit(0))
    same(minhash.near_dedup(df).collect(), docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    rows = minhash.near_dedup(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(0, 0, True), (1, 0, False), (1, 0, False)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert minhash.near_dedup(df.limit(0)).count() == 0


def test_testdata(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    same(minhash.near_dedup(df).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_one_id_with_several_texts(spark):
    t1, t2, t3 = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_dedup(df([(1, t1), (5, t1), (3, t2), (5, t2)])).collect()}
    assert got == {(1, 1), (5, 1), (3, 1)}
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_dedup(df([(2, t1), (2, t2), (2, ""), (2, None), (9, t3), (8, t2), (8, "a b")])).collect())
    assert got == [(2, 0, 2), (2, 0, 2), (2, 36, 2), (2, 36, 2), (8, 1, 2), (8, 36, 2), (9, 36, 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_repeated_ids(spark, seed):
    rng = random.Random(seed)
    docs = []
    for group in range(60):
        words = ["g%dw%d" % (group, rng.randrange(300)) for _ in range(rng.choice([0, 3, 40, 80]))]
        for _ in range(rng.choice([1, 2, 5])):
            docs.append((rng.randrange(120), " ".join(edited(rng, words, rng.choice([0, 0.02, 0.05])))))
    root, sizes = by_hand_rows(docs)
    rows = minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted((d, sizes[k], root[d], root[d] == d) for k, (d, _) in enumerate(docs))
