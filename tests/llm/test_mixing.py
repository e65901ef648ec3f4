import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgeloom.llm import mixing

DOCS = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    """sizes: by source in order. Shares the rest by weight again and again until none is above its limit."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    done, free, rest = {}, dict(w), float(sum(sizes.values()))
    while free:
        share = {s: rest * x / sum(free.values()) for s, x in free.items()}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = cap * sizes[s]
            rest -= done[s]
            del free[s]
    return done


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or got.tolist() != mixing.permuted(np.arange(n), n, 6).tolist()


def check(rows, docs, near):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    in_order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets_by_hand({s: sizes[s] for s in in_order})
    source = {d: s for d, _, s in docs}
    taken = defaultdict(int)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in docs)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(near * want[s], 1.5 * mixing.BLOCK_WORDS)


def test_targets_and_limits(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join("w%d" % x for x in rng.integers(0, 50, rng.integers(0, 90))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "dé", "z"], 400, p=[0.02, 0.05, 0.6, 0.13, 0.2]).tolist())]
    docs += [(1000, None, "a"), (1001, "", None), (1002, "one two\x0bthree", None), (1003, " \n", "empty source")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("x", "y")
    rows = mixing.mix(df).collect()
    check(rows, docs, 0.1)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_testdata(spark):
    df = spark.read.parquet(f"{DOCS}/documents.parquet")
    check(mixing.mix(df).collect(), [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()], 0.02)


def test_documents_of_the_mix(spark):
    words = " ".join(f"w{i}" for i in range(300))
    docs = [(i, f"{i}: {words}\n end", "s%d" % (i % 4), "x") for i in range(12)] + [(99, None, None, "x"), (3, f"3: {words}\n end", "s3", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string").selectExpr("*", "1 AS k1", "2 AS turn", "3 AS copy", "4 AS words")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(next(t for d, t, *_ in docs if d == r.doc_id)))
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0


def test_slots_are_distinct_and_shards_full(spark):
    parts = mixing.plan(spark.read.parquet(f"{DOCS}/documents.parquet"))
    slots = [(r.shard, r.slot) for r in parts["slots"].collect()]
    assert len(set(slots)) == len(slots)
    sizes = Counter(s for s, _ in slots)
    assert all(sizes[s] == mixing.SHARD_SLOTS for s in range(len(sizes) - 1))


def plain_mix(rows, seed=1):
    """rows: (row, source, size, k1, k2), fewer than a bucket of each source. Words taken of each row, by packing all
    words into a list of blocks, dealing the slots one by one, and counting."""
    sizes = Counter()
    for _, source, size, _, _ in rows:
        sizes[source] += size
    in_order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets_by_hand({s: sizes[s] for s in in_order})
    taken = Counter()
    for rank, source in enumerate(in_order):
        words = [row for row, s, size, k1, k2 in sorted(rows, key=lambda r: (r[3], r[4])) if s == source for _ in range(size)]
        blocks = [words[k : k + mixing.BLOCK_WORDS] for k in range(0, len(words), mixing.BLOCK_WORDS)]
        slots = min(int(np.floor(want[source] * len(blocks) / sizes[source] + 0.5)), 3 * len(blocks)) if words else 0
        for i in range(slots):
            turn, at = divmod(i, len(blocks))
            taken.update(blocks[mixing.permuted(np.array([at]), len(blocks), mixing._key(seed, rank, turn))[0]])
    return taken


def test_against_a_plain_mix(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join("w%d" % x for x in rng.integers(0, 9, rng.integers(0, 300)))
    docs = [(i, text(), s) for i, s in enumerate(rng.choice(["a", "b", "c"], 300, p=[0.05, 0.25, 0.7]).tolist())]
    docs += [(i, t, None) for i, t, _ in docs[:40]] + [(None, None, "a"), (500, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    keys = df.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")).collect()
    rows = [((d, s), s, len(WORD.findall(t or "")), k.k1, k.k2) for (d, t, s), k in zip(docs, keys)]
    want = plain_mix(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((d, size, want[d, s]) for (d, s), _, size, _, _ in rows)


def test_one_text_in_several_sources_and_equal_rows(spark):
    many, few = " ".join(f"a{k}" for k in range(640)), " ".join(f"b{k}" for k in range(640))
    docs = [(1, many, "x"), (1, many, "y"), (2, few, "x"), (2, few, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, weights=(1, 1)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == [(1, 640), (1, 640), (2, 640), (2, 640)]
    mixed = sorted((r.doc_id, r.source, r.text) for r in mixing.mixed_documents(df, weights=(1, 1)).collect())
    assert mixed == sorted((d, s, t) for d, t, s in docs)
    equal = spark.createDataFrame([(None, few, "x", k) for k in range(300)] + [(7, many, "y", 0)], "doc_id long, text string, source string, n long").repartition(5)
    for part in (equal, equal.coalesce(2)):
        out = mixing.mix(part).collect()
        assert len(out) == 301 and all(r.taken <= 3 * r.size for r in out)
    assert sorted(map(str, mixing.mix(equal).collect())) == sorted(map(str, mixing.mix(equal.coalesce(2)).collect()))
    taken = sum(r.taken for r in mixing.mix(equal).collect())
    assert sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(equal).collect()) == taken


def test_counts_of_a_shard_are_those_of_a_draw(spark):
    words = " ".join(["w"] * 6400)
    df = spark.createDataFrame([(k, words, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    counts = {(r.shard, r.rank): r.slots for r in mixing.shard_counts(mixing.plan(df)).collect()}
    shards = max(s for s, _ in counts)
    for rank, share in enumerate((5 / 8, 2 / 8, 1 / 8)):
        drawn = np.array([counts[s, rank] for s in range(shards)])
        spread = np.sqrt(mixing.SHARD_SLOTS * share * (1 - share))
        assert abs(drawn.mean() - mixing.SHARD_SLOTS * share) < spread and 0.5 * spread < drawn.std() < 1.6 * spread
