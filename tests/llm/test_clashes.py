"""Extra columns of any name do no harm, nor do tables in which everything is null."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from edgeloom.llm import byte_bpe, embedding_dedup, language_id, license_scan, line_dedup, minhash, mixing, pii, quality, toxicity

NAMES = list(dict.fromkeys("id key n rep u v i j k w x row line lines words host docs size rank target block taken start stop w1 w2 first covered raw at head type form surrogate numbers licences score root node part band bands items lo hi members vec cell copies severity grade held f1 f2 k1 k2 hash copy turn skip uses c0 c1 doc all at k fits class rep lead component of bound found before after __k1 __k2 __c1 __c2 __s1 __s2 __n __raw __some __new __t __f __spans __whole __row __rest __all __covered __part __first".split()))
#: What operators add; an input column of such a name gives way to it, but not in the stages of the pipeline.
OWN = "__entities __lines __removed __lang __score _lang_found lang_found score_found".split()
RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
LABELS = "doc_id long, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], LABELS)
    return {
        "minhash": minhash.near_dedup,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "license": license_scan.scan,
        "bpe": lambda d: byte_bpe.encode_decode(d, RANKS, P.PATTERN),
        "quality": quality.quality,
        "pii": lambda d: pii.pseudonymise(d, "k"),
        "mixing": mixing.mix,
        "mixed": mixing.mixed_documents,
        "language": lambda d: language_id.identify(d, PIECES),
        "lines": line_dedup.dedup_lines,
        "stage language": lambda d: corpus_pipeline.identify_language(spark, d, ""),
        "stage lines": lambda d: corpus_pipeline.dedup_lines(spark, d, ""),
        "stage minhash": lambda d: corpus_pipeline.dedup_documents(spark, d, ""),
        "stage mixing": lambda d: corpus_pipeline.mix_sources(spark, d, ""),
    }


ALL = "minhash,toxicity,license,bpe,quality,pii,mixing,mixed,language,lines,stage language,stage lines,stage minhash,stage mixing".split(",")


@pytest.mark.parametrize("name", ALL)
def test_names_and_nulls(spark, name):
    rows = [(1, "one two three\nfour five six\nseven eight a@b.com", "en", "s"), (2, None, None, None), (None, None, None, None), (None, "one two three", "en", None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = NAMES + (OWN if name.startswith("stage") or name == "mixed" else [])
    crowded = plain.selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES + OWN])
    f = operators(spark)[name]
    out = f(crowded)
    assert out.count() == f(plain).count()
    assert len(out.columns) == len(set(out.columns))
    if set(NAMES) <= set(out.columns):
        assert out.filter(" OR ".join(f"NOT `{n}` <=> '{n}'" for n in names)).count() == 0
    else:
        assert not name.startswith("stage") and name not in ("mixed", "pii", "lines")
    nothing = plain.filter("text IS NULL")
    assert f(nothing).count() in (0, 2)


def test_embeddings(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>").selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert embedding_dedup.embedding_dedup(df.filter("embedding IS NULL")).count() == 1
