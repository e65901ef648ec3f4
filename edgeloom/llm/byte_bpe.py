"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every match of the split pattern is encoded separately. Texts longer than ``MAX_CHARS`` are first cut at
safe boundaries: between a non-space character and a following white-space character. No match of the
pattern holds a non-space character followed by white space, no match looks behind itself, and the one
look-ahead concerns white space only, so a match always ends at such a boundary and the pieces encode to
the same ids as the whole text. White-space runs longer than ``MAX_RUN`` are split by hand into the
matches the pattern would make, because the library's regular expression engine cannot take them.

Defined results: a null or empty text has no ids; its decoded bytes are empty; repeated rows give repeated
rows; an empty table gives an empty table; only the id and text columns are read, whatever others exist.
Bytes that aren't UTF-8 count as U+FFFD, as the library takes only Unicode text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MAX_CHARS = 1 << 17
MAX_RUN = 1 << 12

#: Unicode's White_Space, which the library's engine means by \s; Python's \s holds four more characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_SPACE_AHEAD = re.compile("(?<=[^%s])(?=[%s])" % (SPACE, SPACE))


@lru_cache(maxsize=8)
def long_space(least: int) -> re.Pattern:
    return re.compile("[%s]{%d,}" % (SPACE, least))


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One per worker process; the rank file is read where the worker runs."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = MAX_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut at safe boundaries only. A text without any
    stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = _SPACE_AHEAD.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text) if len(text) > MAX_CHARS else (text,):
        start = 0
        for run in long_space(MAX_RUN).finditer(piece) if len(piece) >= MAX_RUN else ():
            # The run's matches: all of it at the end of the text, else all but its last character, which
            # goes with what follows or stands alone. A piece ends before white space, so only at the end of
            # the text can a run end a piece.
            stop = run.end() if run.end() == len(piece) else run.end() - 1
            ids += enc.encode_ordinary(piece[start : run.start()])
            ids += enc._encode_single_piece(piece[run.start() : stop])
            start = stop
        ids += enc.encode_ordinary(piece[start:])
    return ids


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes; they need not be valid UTF-8 for arbitrary ids."""
    return enc.decode_bytes(ids)


def texts_of(column: pa.Array) -> Iterator[str]:
    for raw in pc.cast(column, pa.binary()).to_pylist():
        yield (raw or b"").decode("utf-8", "replace")


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: the id, n_tokens, ids (array of int) and decoded (binary) if ``with_ids``,
    and lowercase SHA-256 digests of the ids as little-endian unsigned 32-bit integers and of the decoded
    bytes. A map over Arrow batches: no shuffle, and a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, all_ids, raw, ids_sha, raw_sha = [], [], [], [], []
                for text in texts_of(part.column(1)):
                    ids = encode(enc, text)
                    back = decode(enc, ids)
                    packed = np.array(ids, dtype="<u4")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    raw_sha.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        all_ids.append(packed.astype(np.int32))
                        raw.append(back)
                out = {"id": part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(raw_sha, pa.string())}
                if with_ids:
                    out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(raw, pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    kind = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
