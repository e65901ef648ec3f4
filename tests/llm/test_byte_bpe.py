import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from edgeloom.llm import byte_bpe

ENC = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ODD = ["", " ", "a", "don't  stop\n\n now's 12 !?", "a\x1c!\x1c b", "é　x  y", "퟿\U0001f600 ok", "x" * 3000]


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_pieces_encode_as_the_whole(limit):
    rng = random.Random(limit)
    alphabet = "ab1!' \n\t　\x1c\x85é日"
    for text in [*ODD, *("".join(rng.choice(alphabet) for _ in range(80)) for _ in range(300))]:
        pieces = list(byte_bpe.safe_pieces(text, limit))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_long_runs_and_texts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_RUN", 4)
    monkeypatch.setattr(byte_bpe, "MAX_CHARS", 50)
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "      ", "\n\n\n\n\n", "b1", ".", " \n \n \n"]) for _ in range(rng.randint(0, 60)))
        assert byte_bpe.encode(ENC, text) == ENC.encode_ordinary(text)


def test_query_columns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, None), (0, "", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = byte_bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    texts = {(i, t or "") for i, t, _ in rows}
    for r in got:
        text = next(t for i, t in texts if i == r.doc_id)
        ids = ENC.encode_ordinary(text)
        assert r.n_tokens == len(ids) and list(r.ids) == ids and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_decode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
