"""Quality rules: base rules on each text, and cross-document line frequency.

Base (words are runs of ``[^\\x20\\x09-\\x0D]``, compared as they are): word_chars, code points in words;
n_symbols, characters of ``#*$%&|<>``; n_dup_lines, lines with a word equal to an earlier line; n_repeat_words,
words that lie in a window of three words found twice or more in the text. A text fails with fewer than
``MIN_WORDS`` words or if n_repeat_words exceeds half of n_words.

Line frequency: lines are lower-cased in A-Z, white space within them becomes one space; hashes of those with
a word are counted once for each document of a host (the source column). A line goes if it occurs in more
documents of the host than both ``MIN_DOCS`` and ``SHARE`` of the host's documents; a document is rejected when
more than ``DEPLETED`` of its words go. ``cleaned`` gives the texts without these lines, ``quality`` the figures.

Defined results: a null or empty text has no words and fails, and stays as it is; a null host is a host; rows with
equal id count as one document, and each row with a null id as one of its own; repeated rows give repeated rows; an empty table gives an empty table; other columns are not
read, or carried along by ``cleaned``. Counts are summed before the shuffle; the lines of a hot host are dealt by host and line and salted where
they look up which lines go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace
from .words import WordHashes, line_hash

MIN_WORDS = 50
MIN_DOCS = 30
SHARE = 0.001
DEPLETED = 0.5
SALTS = 64

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(hashes) < 4:
        return 0
    window = (hashes[:-2] * _A + hashes[1:-1]) * _B + hashes[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def measure(text: bytes, hashes: WordHashes) -> tuple[tuple[int, ...], dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and words by hash of the normalised line."""
    words = text.split()
    shown = text.translate(None, SPACES)
    chars = len(shown) if shown.isascii() else len(shown.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    by_line: dict[int, int] = {}
    dup = 0
    for line in text.split(b"\n"):
        parts = line.lower().split()
        if parts:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            h = line_hash(b" ".join(parts))
            by_line[h] = by_line.get(h, 0) + len(parts)
    symbols = len(shown) - len(shown.translate(None, SYMBOLS))
    return (len(words), chars, symbols, dup, repeated_words(hashes.of(words))), by_line


def _measured(df: DataFrame) -> DataFrame:
    """row, id, host, text -> row, id, host, the base figures, lines (their hashes) and line_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, lines, words = [], [], []
                for text in pc.cast(part.column(3), pa.binary()).to_pylist():
                    numbers, by_line = measure(text or b"", hashes)
                    base.append(numbers)
                    lines.append(np.fromiter(by_line.keys(), np.int64, len(by_line)))
                    words.append(np.fromiter(by_line.values(), np.int64, len(by_line)))
                columns = list(zip(*base, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *[pa.array(c, pa.int64()) for c in columns], pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))],
                    names=["row", "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
                )

    kind = df.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return df.select("row", "id", "host", "text").mapInArrow(run, f"row bigint, id {kind}, host string, {counts}, lines array<bigint>, line_words array<bigint>")


def _assessed(rows: DataFrame, ws: Workspace, min_docs: int, share: float) -> DataFrame:
    """row, id, host, text -> a row each with the figures, removed_words, removed (the hashes of lines that go; null if
    none), base_failed and kept."""
    measured = ws.keep(_measured(rows), "measured")
    # A row without an id is a document of its own.
    document = [F.col("id"), F.when(F.col("id").isNull(), F.col("row")).alias("own")]
    hosts = measured.select("host", *document).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = measured.select("row", "id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "id", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    spread = lines.select("host", "line", *document).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    limit = F.col("n") > F.greatest(F.lit(float(min_docs)), F.col("docs") * F.lit(share))
    bad = spread.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).filter(limit).select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    bad = ws.keep(bad, "bad")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    # Copies for all salts compress to nothing on disk, so the planner would take the table for a tiny one.
    hit = salted.join(bad.hint("merge"), (F.col("line") == F.col("bad_line")) & (F.col("salt") == F.col("bad_salt")) & F.col("host").eqNullSafe(F.col("bad_host")))
    removed = hit.groupBy("row").agg(F.sum("words").alias("words"), F.collect_list("line").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.drop("lines", "line_words", "host").join(removed, "row", "left").withColumns({"removed_words": F.coalesce("words", F.lit(0).cast("long")), "base_failed": failed})
    return out.drop("words").withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= DEPLETED * F.col("n_words")))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row per row of ``df``: id (as doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words (in lines above the limit), kept."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"), df[host_col].cast("string").alias("host"), df[text_col].cast("string").alias("text"))
    out = _assessed(rows, Workspace(df.sparkSession, "quality"), min_docs, share)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def without_lines(text: bytes, gone: set[int]) -> bytes:
    """The text's lines but those whose normalised form has one of the hashes."""
    return b"\n".join(x for x in text.split(b"\n") if not (parts := x.lower().split()) or line_hash(b" ".join(parts)) not in gone)


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """The documents that are kept, with the columns of ``df``, their texts without the lines above the limit."""
    ws = Workspace(df.sparkSession, "cleaned")
    # As one column, so that no name of the input's meets another.
    whole = ws.keep(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[df[c] for c in df.columns]).alias("doc")), "whole")
    of = lambda c: F.col("doc").getField(c)
    rows = whole.select("row", of(id_col).alias("id"), of(host_col).cast("string").alias("host"), of(text_col).cast("string").alias("text"))
    verdict = ws.keep(_assessed(rows, ws, min_docs, share).filter("kept").select("row", "removed"), "verdict")
    kept = whole.join(verdict, "row").select(*[of(c).alias(f"c{k}") for k, c in enumerate(df.columns)], "removed")
    names, at = list(df.columns), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.binary()).to_pylist()
            texts = [t if gone is None else without_lines(t, set(gone)) for t, gone in zip(texts, batch.column(len(names)).to_pylist(), strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pc.cast(pa.array(texts, pa.binary()), batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, df.schema)
