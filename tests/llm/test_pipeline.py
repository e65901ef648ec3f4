import hashlib
import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_line_dedup import by_hand as lines_by_hand
from test_minhash import by_hand as groups_by_hand

import corpus_pipeline
from edgeloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
WORDS = {"en": "the and of to with from house river stone garden window letter morning".split(), "fr": "le la les avec pour dans maison rivière pierre jardin fenêtre lettre matin".split()}


def corpus():
    rng = random.Random(8)
    text = lambda lang, n: "\n".join(" ".join(rng.choice(WORDS[lang]) + str(rng.randrange(50)) for _ in range(12)) for _ in range(n))
    docs = [(k, text("en" if k % 3 else "fr", rng.randint(1, 9)), "en" if k % 3 else "fr", f"s{k % 4}") for k in range(60)]
    docs += [(100 + k, docs[k][1], docs[k][2], "copy") for k in range(5)]
    docs += [(110 + k, docs[10 + k][1] + "\n" + text("en", 4), "en", "part") for k in range(5)]
    docs += [(120, None, "en", "s0"), (121, "", None, "s0"), (122, "12 !? 99", "en", "s0"), (123, "the house", None, None)]
    return [(d, t, lang, s, len(t or ""), 7) for d, t, lang, s in docs]


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "byte_bpe"]

    docs = steps["language_id"](spark, docs, "").cache()
    assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert {r.doc_id for r in docs.collect()} == {d for d, *_ in rows} - {120, 121, 122}
    assert {r.lang for r in docs.filter("doc_id = 123").collect()} == {"en"}

    before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    docs = steps["line_dedup"](spark, docs, "").cache()
    want = {d: t for d, t in lines_by_hand(before).items() if t.strip()}
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in want.items()}
    assert len(want) < len(before)

    groups = groups_by_hand(list(want.items()))
    docs = steps["minhash_dedup"](spark, docs, "").cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)

    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = steps["mixing"](spark, docs, "").cache()
    for r in docs.collect():
        assert r.extra == 7 and r.n_chars == len(r.text)
        assert all(part in texts[r.doc_id] for part in r.text.split("\n"))

    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want_rows = sorted((r.doc_id, len(i := enc.encode_ordinary(r.text)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps["byte_bpe"](spark, docs, "").collect()) == want_rows


def test_empty_and_repeated_rows(spark):
    rows = corpus()[:6]
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows + rows, SCHEMA)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, "").cache()
            if k < 4:
                assert len(docs.columns) == 6
        assert docs.count() >= 0


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.filter(F.col("n_tokens") > 0).count() == out.count() > 0


def test_no_text_of_a_kept_id_is_lost(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en", "s", 0, 1), (1, b, "en", "s", 0, 2), (1, b, "en", "s", 0, 3), (2, b, "en", "s", 0, 4), (3, c, "en", "s", 0, 5)]
    out = dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, a), (1, b), (3, c)]
