"""Mixing sources to target weights.

The words of each source are packed into blocks of a fixed length; the number of slots of each source is its
target in blocks; the source counts of an output shard are a multinomial draw conditioned on those totals. They
are drawn by a keyed pseudorandom permutation that deals all slots over the shards, which gives exactly that
distribution (``shard_counts`` has them): free multinomial draws would miss the targets by their own spread and
could pass the limit of ``cap``. So every source comes to its target and reruns agree; a slot's running number within its source goes through a pseudorandom permutation of the
source's block numbers, a new one for each pass over the source; slots and blocks are joined by block number.

Targets: the weights repeat over the sources in code point order, null last; the sources share all words by
weight; none gets more than ``cap`` times its own words, and what it can't take is shared again by weight.
A slot number below ``cap`` times the number of blocks uses each block ``cap`` times at most, so no document
exceeds ``cap`` times its size.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source; repeated rows
are documents of their own, each numbered where it is first written, so as many rows come out of ``mix`` as go
in, also where id, text or both are equal in one or several sources; an empty table gives an empty table; other
columns are not read, or carried along by ``mixed_documents`` whatever their names. No task sees more than a
range of the sources, of the buckets of ``BUCKET_DOCS`` documents or so, or of equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.structure import sums_before
from ..plans.lineage import cut
from .tables import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
BUCKET_DOCS = 2048
CHUNK_SLOTS = 1 << 16

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: the constants of splitmix64


def _mixed(x: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint64(v) for v in _ODD)
    x = x + a
    x = (x ^ (x >> np.uint64(30))) * b
    x = (x ^ (x >> np.uint64(27))) * c
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at the places x: a four-round Feistel network over the
    next even number of bits, walked until the value falls below n."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(4, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out, todo = np.asarray(x, np.uint64).copy(), np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    """64 bits from whole numbers."""
    x = np.uint64(0)
    for part in parts:
        x = _mixed(np.array([x ^ np.uint64(part % (1 << 64))]))[0]
    return int(x)


def _targets(per_source: DataFrame, weights: tuple, cap: int) -> DataFrame:
    """per_source: source, source_size, ... -> with rank, weight and target. One row a source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sums_before(per_source, (F.col("source").asc_nulls_last(),), {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    # In the order of most / weight, the sources before some place are at their limit. The level is what
    # the words left over come to a unit of weight at the first place where no limit is passed.
    leveled = cut(sums_before(ranked.withColumn("bound", F.col("most") / F.col("weight")), ("bound", "rank"), {"most_before": F.col("most"), "weight_before": F.col("weight")}))
    total = leveled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total["size"]) - F.col("most_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    found = leveled.agg(F.max(F.when(level <= F.col("bound"), level))).first()[0]
    target = F.least(F.col("most"), F.lit(float("inf") if found is None else found) * F.col("weight"))
    return leveled.withColumn("target", target).drop("most", "bound", "most_before", "weight_before")


def _slots(sources: DataFrame, seed: int, slots_total: int) -> DataFrame:
    """shard, slot, rank and block of every slot. sources: rank, n_blocks, first_block, slots, first_slot."""
    chunks = sources.filter("slots > 0").select("rank", "n_blocks", "first_block", "slots", "first_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK_SLOTS}"))).alias("chunk"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                i = np.arange(r["chunk"] * CHUNK_SLOTS, min(r["slots"], (r["chunk"] + 1) * CHUNK_SLOTS), dtype=np.int64)
                block = np.empty(len(i), np.int64)
                for turn in np.unique(i // r["n_blocks"]).tolist():
                    of = i // r["n_blocks"] == turn
                    block[of] = permuted(i[of] % r["n_blocks"], r["n_blocks"], _key(seed, r["rank"], turn))
                at = permuted(r["first_slot"] + i, slots_total, seed)
                yield pa.RecordBatch.from_pydict({"shard": at // SHARD_SLOTS, "slot": at % SHARD_SLOTS, "rank": np.full(len(i), r["rank"], np.int64), "block": r["first_block"] + block})

    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, "rank", "chunk").mapInArrow(deal, "shard long, slot long, rank long, block long")


def _sized(docs: DataFrame, row: Column, id_: Column, text: Column, source: Column) -> DataFrame:
    """row (a number of its own for each row), part (where it was written), id, source, size, k1 and k2, together
    128 bits that stand for id and text and are never null."""
    text = text.cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row.alias("row"), F.spark_partition_id().alias("part"), id_.alias("id"), source.cast("string").alias("source"), size.alias("size"), F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))


def _copies(tagged: DataFrame, ws: Workspace) -> DataFrame:
    """row, copy: rows that are equal in source, id and text are numbered from 0, so that they are dealt like others
    and alike each time; a row that has no equal isn't in the table. They are counted by the part they were
    written in, and numbered part by part, so that no task sees all of them."""
    key = ["rank", "k1", "k2"]
    several = ws.keep(tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "several")
    equal = ws.keep(tagged.join(several, key, "left_semi").select(*key, "part", "row"), "equal")
    along = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = equal.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(*key, "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1
    placed = equal.withColumn("nth", nth).join(counted, [*key, "part"])
    return placed.select("row", (F.col("before") + F.col("nth")).alias("copy"))


def _plan(sized: DataFrame, ws: Workspace, seed: int, weights: tuple, cap: int) -> dict[str, DataFrame]:
    """fragments (row, id, size, source_size, target, block, skip, words: the words of a document that lie in a
    block), slots (shard, slot, rank, block) and sources."""
    sized = ws.keep(sized, "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = ws.keep(_targets(per_source, weights, cap), "targets")
    to_rank = targets.select(F.col("source").alias("of"), "rank", "source_size", "n_docs", "target")
    tagged = sized.join(to_rank, sized["source"].eqNullSafe(to_rank["of"])).drop("source", "of")
    tagged = ws.keep(tagged, "tagged")
    numbered = tagged.join(ws.keep(_copies(tagged, ws), "copies"), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))
    # Buckets of some thousand documents each, in which offsets are running sums.
    bucket = F.pmod(F.xxhash64("k1", "copy", F.lit(seed)), F.expr(f"(n_docs + {BUCKET_DOCS - 1}) div {BUCKET_DOCS}"))
    within = Window.partitionBy("rank", "bucket").orderBy("k1", "k2", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = ws.keep(numbered.withColumn("bucket", bucket).select("row", "id", "size", "rank", "source_size", "target", "bucket", (F.sum("size").over(within) - F.col("size")).alias("start")), "placed")
    buckets = placed.groupBy("rank", "bucket").agg(F.expr(f"(sum(size) + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}").alias("blocks"))
    # Blocks are numbered on from bucket to bucket and from source to source.
    buckets = ws.keep(sums_before(buckets, ("rank", "bucket"), {"at": F.col("blocks")}), "buckets")
    sources = targets.join(buckets.groupBy("rank").agg(F.sum("blocks").alias("n_blocks"), F.min("at").alias("first_block")), "rank")
    in_blocks = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(in_blocks, F.col("n_blocks") * F.lit(cap))).otherwise(F.lit(0).cast("long"))
    sources = ws.keep(sums_before(sources.withColumn("slots", slots), ("rank",), {"first_slot": F.col("slots")}), "sources")
    slots_total = sources.agg(F.sum("slots")).first()[0] or 0
    # The blocks that a document's words fall into. One without words gets a number of its own below 0.
    own = placed.join(buckets.select("rank", "bucket", "at"), ["rank", "bucket"])
    spread = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}"))).otherwise(F.array(F.lit(-1).cast("long")))
    spread = own.select("row", "id", "size", "source_size", "target", "start", "at", F.explode(spread).alias("n"))
    begin, some = F.greatest(F.col("n") * BLOCK_WORDS, "start"), F.col("n") >= 0
    block = F.when(some, F.col("at") + F.col("n")).otherwise(-1 - F.col("row"))
    words = F.when(some, F.least((F.col("n") + 1) * BLOCK_WORDS, F.col("start") + F.col("size")) - begin).otherwise(F.lit(0).cast("long"))
    fragments = spread.select("row", "id", "size", "source_size", "target", block.alias("block"), F.when(some, begin - F.col("start")).otherwise(F.lit(0).cast("long")).alias("skip"), words.alias("words"))
    return {"fragments": fragments, "slots": _slots(sources, seed, slots_total), "sources": sources}


def plan(docs: DataFrame, seed: int = 1, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, DataFrame]:
    """The tables of ``_plan``; ``row`` numbers the rows of ``docs`` in no defined order."""
    ws = Workspace(docs.sparkSession, "mix")
    return _plan(_sized(docs, F.monotonically_increasing_id(), docs[id_col], docs[text_col], docs[source_col]), ws, seed, weights, cap)


def shard_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """shard, rank, slots: the counts of the sources drawn for each output shard."""
    return parts["slots"].groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("slots"))


def _with_uses(parts: dict[str, DataFrame]) -> DataFrame:
    uses = parts["slots"].groupBy("block").agg(F.count(F.lit(1)).alias("uses"))
    # The planner guesses the slots' size from the few rows they are made of, so the join is named.
    return parts["fragments"].join(uses.hint("merge"), "block", "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the id (as doc_id), size, source_size, target, taken (words the mix takes,
    repeats counted)."""
    used = _with_uses(plan(docs, **options))
    taken = used.groupBy("row", "id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The stretches of the text that hold the words [skip, skip + words) of each span, adjoining spans
    together, otherwise separated by a line end."""
    bounds = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    merged: list[list[int]] = []
    for skip, words in spans:
        if merged and merged[-1][1] == skip:
            merged[-1][1] += words
        else:
            merged.append([skip, skip + words])
    return b"\n".join(text[bounds[a][0] : bounds[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, seed: int = 1, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``: for each of the passes 1..cap one
    row for each document of which some block is used so often, with the words of those blocks. A document
    that the pass takes whole keeps its text as it is."""
    ws = Workspace(docs.sparkSession, "mix")
    # As one column, so that no name of the input's meets another.
    whole = ws.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "whole")
    of = lambda c: F.col("doc").getField(c)
    used = _with_uses(_plan(_sized(whole, F.col("row"), of(id_col), of(text_col), of(source_col)), ws, seed, weights, cap)).filter("uses > 0")
    passes = used.select("row", "size", "skip", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))).alias("turn"))
    spans = passes.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("spans"), (F.sum("words") == F.max("size")).alias("all"))
    taken = whole.join(spans, "row").select(*[of(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], F.when(~F.col("all"), F.col("spans")).alias("spans"))
    names, at = list(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.binary()).to_pylist()
            texts = [t if s is None else cut_words(t, [(x["skip"], x["words"]) for x in s]) for t, s in zip(texts, batch.column(len(names)).to_pylist(), strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pc.cast(pa.array(texts, pa.binary()), batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return taken.mapInArrow(run, docs.schema)
