"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Texts are lower-cased in A-Z and split at ASCII white space. A document's set holds its distinct shingles of
five words; with fewer words, the whole sequence. Two documents are linked if 100 * intersection >= 75 * union;
a component is what links reach, and its smallest id is kept.

1. One pass over the texts: sets as 64-bit hashes, a 128-bit fingerprint of the set, and a SuperMinHash signature
   of 128 registers. Each element draws a random permutation of the registers; at rank j it offers j plus a
   random fraction to the register of that rank. All elements of many documents go through rank j together, and
   a document stops once each of its registers has a value below the next rank, as later offers can't be less.
2. Rows with equal sets are one class, which goes on under a number of its own; classes that an id is in are linked.
3. 32 bands of 4 registers. A pair at 0.75 shares no band once in 200,000 times. Each member of a bucket is paired
   with the bucket's first class, so a group of n copies makes n pairs. Pairs whose signatures agree in less
   than ``LEAST_AGREEMENT`` (a pair at 0.75 does once in 200,000 times) go, the best one of each document is
   verified on the full sets, and links are grouped.
4. What one leader can't show: buckets that still hold more than one component compare all signatures across
   components, in blocks of ``BLOCK`` members and ``BLOCK_ITEMS`` shingles at most on average, and verify the pairs that
   agree on the full sets in the same place; only links that join components leave it. So no bucket is capped, and
   none emits its pairs.

Defined results: a null or empty text, or one without words, has an empty set and is its own component; a null
id links with nothing; rows with equal ids are one document that has the links of all of them, whatever their texts,
and each gives a row with its own set's size; an empty table gives an empty table; only the id and text columns are read, whatever others exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import grouped
from .components import Forest, components
from .tables import Workspace
from .words import WordHashes

SHINGLE = 5
REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
LEAST_AGREEMENT = 0.58
BLOCK = 256
BLOCK_ITEMS = 1 << 19
BATCH = 1 << 17

_K = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: the constants of splitmix64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_K[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_K[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return words
    n = min(SHINGLE, len(words))
    rolled = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(_K[0]) + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(rolled + np.uint64(n)))


def signatures(values: np.ndarray, doc: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """values: hashes of distinct elements, doc: the document of each, in order. Returns docs x m registers;
    those of a document without elements stay at the largest number."""
    registers = np.full(docs * m, _FULL, np.uint64)
    left, perm = None, None
    for j in range(m):
        drawn = mixed(values + np.uint64(((j + 1) * _K[0]) & 0xFFFFFFFFFFFFFFFF))
        swap = (drawn & np.uint64(0xFFFFFF)) % np.uint64(m - j) + np.uint64(j)
        offer = (drawn >> np.uint64(24)) | np.uint64(j << 40)
        if j == 0:
            to = swap
        else:
            at = np.arange(len(values))
            to = perm[at, swap].astype(np.uint64)
            perm[at, swap] = perm[at, j]
        place = doc * m + to.astype(np.int64)
        if j:
            better = registers[place] > offer
            place, offer = place[better], offer[better]
        np.minimum.at(registers, place, offer)
        if j < 8 or j % 8 == 0:
            open_docs = (registers.reshape(docs, m) >= np.uint64((j + 1) << 40)).any(axis=1)
            left = open_docs[doc]
            if not left.any():
                break
            if j == 0:
                values, doc, swap = values[left], doc[left], swap[left]
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(values), m)).copy()
                perm[np.arange(len(values)), swap] = 0
            elif not left.all():
                values, doc, perm = values[left], doc[left], perm[left]
    return registers.reshape(docs, m)


def lanes(registers: np.ndarray) -> np.ndarray:
    """16 bits of each register, four to a signed 64-bit number: a band's key, and all of them the signature."""
    return np.ascontiguousarray((mixed(registers) >> np.uint64(48)).astype(np.uint16)).view(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def _sketches(texts: DataFrame) -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint), bands; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            signed = lanes(signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
            pairs = [_fingerprint(s) for s in sets]
            bands = [signed[k] if n else None for k, n in enumerate(sizes)]
            return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": sizes, "f1": pa.array([p[0] for p in pairs], pa.int64()), "f2": pa.array([p[1] for p in pairs], pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

        for batch in batches:
            ids, sets, held = [], [], 0
            texts = pc.cast(batch.column(1), pa.binary())
            for id_, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = shingles(text.as_py() or b"", hashes)
                ids.append(id_)
                sets.append(found)
                held += len(found)
                if held >= BATCH or len(ids) >= 2048:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return texts.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def _fingerprint(found: np.ndarray) -> tuple:
    """128 bits of a set, as two signed numbers; nulls for an empty one."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()) if len(found) else (None, None)


def _sets(texts: DataFrame) -> DataFrame:
    """id, f1, f2 (fingerprint), items: the sorted distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t or b"", hashes).view(np.int64) for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
                prints = [_fingerprint(x) for x in found]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "f1": pa.array([p[0] for p in prints], pa.int64()), "f2": pa.array([p[1] for p in prints], pa.int64()), "items": pa.array(found, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "id long, f1 long, f2 long, items array<long>")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb, sa, sb -> a, b, share, of the pairs that may reach 0.75."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sa, sb = (part.column(k).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                na, nb = (part.column(k).to_numpy() for k in (2, 3))
                share = (sa == sb).mean(axis=1)
                good = (share >= LEAST_AGREEMENT) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))
                yield pa.RecordBatch.from_pydict({"a": part.column(0).to_numpy()[good], "b": part.column(1).to_numpy()[good], "share": share[good]})

    return pairs.mapInArrow(run, "a long, b long, share double")


def _open_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two documents of a block pair that differ in root and may reach 0.75, and share no earlier
    band: of any two that may, one group of all has them."""
    roots, sizes, part = (table.column(k).to_numpy() for k in ("root", "n", "part"))
    signed = np.concatenate([c.flatten().to_numpy() for c in table.column("bands").chunks]).reshape(-1, BANDS)
    short = signed.view(np.uint16)
    i, j, band = (table.column(k)[0].as_py() for k in ("i", "j", "band"))
    first, second = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
    for at in range(0, len(first), 64) if len(second) else ():
        x = first[at : at + 64]
        share = np.zeros((len(x), len(second)), np.uint8)
        for lane in range(REGISTERS):
            share += short[x, lane][:, None] == short[second, lane][None, :]
        good = share >= LEAST_AGREEMENT * REGISTERS
        good &= roots[x][:, None] != roots[second][None, :]
        good &= 4 * np.minimum(sizes[x][:, None], sizes[second][None, :]) >= 3 * np.maximum(sizes[x][:, None], sizes[second][None, :])
        p, q = np.nonzero(good)
        here = (signed[x[p]] == signed[second[q]]).argmax(axis=1) == band
        yield x[p[here]], second[q[here]]


def _needed(rows: DataFrame) -> DataFrame:
    """Of key, i, j, part, band, id, root, n, bands, the rows that are in an open pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            some = np.zeros(table.num_rows, bool)
            for p, q in _open_pairs(table):
                some[p] = some[q] = True
            yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    columns = ["key", "i", "j", "part", "band", "id", "root", "n", "bands"]
    return rows.select(*columns).mapInArrow(run, rows.select(*columns).schema)


def _linked(rows: DataFrame) -> DataFrame:
    """Of the same columns and items, the full sets: u, v, links that join the components of a group. A pair
    already joined by others isn't looked at; so there are fewer links than documents."""

    def links(table: pa.Table) -> Iterator[tuple[int, int]]:
        ids, roots, sizes = (table.column(k).to_numpy() for k in ("id", "root", "n"))
        chunks = table.column("items").combine_chunks()
        items, ends = np.unique(chunks.flatten().to_numpy(), return_inverse=True)[1], np.cumsum(sizes)
        held = np.zeros(items.max(initial=0) + 1, bool)
        forest = Forest()
        for p, q in _open_pairs(table):
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            for x, others in zip(*(lambda u, at: (u, np.split(q, at[1:])))(*np.unique(p, return_index=True)), strict=True):
                others = np.array([o for o in others if forest.find(int(roots[o])) != forest.find(int(roots[x]))], np.int64)
                if not len(others):
                    continue
                own = items[ends[x] - sizes[x] : ends[x]]
                held[own] = True
                for o in others:
                    both = int(held[items[ends[o] - sizes[o] : ends[o]]].sum())
                    if 100 * both >= 75 * (sizes[x] + sizes[o] - both) and forest.find(int(roots[o])) != forest.find(int(roots[x])):
                        forest.union(int(roots[o]), int(roots[x]))
                        yield int(ids[x]), int(ids[o])
                held[own] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            found = list(links(table))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return rows.select("key", "i", "j", "part", "band", "id", "root", "n", "bands", "items").mapInArrow(run, "u long, v long")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each b, the pair that agrees most, the smallest a of several."""
    top = pairs.groupBy("b").agg(F.max(F.struct("share", F.bitwise_not("a").alias("a"))).alias("top"))
    return top.select(F.bitwise_not("top.a").alias("a"), "b")


class Dedup:
    """The steps of one run, with the tables they leave in the workspace."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str) -> None:
        self.ws = Workspace(df.sparkSession, "minhash")
        self.texts = _texts(df, id_col, text_col)
        self.sketches = self.ws.keep(_sketches(self.texts), "sketches")
        known = self.sketches.filter("n > 0 and id is not null")
        # Numbered where they are written; from here on a class is its number.
        self.classes = self.ws.keep(known.groupBy("f1", "f2").agg(F.min("id").alias("rep")).withColumn("class", F.monotonically_increasing_id()), "classes")
        of = self.classes.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep", "class")
        joined = known.join(of, (known["f1"] == of["c1"]) & (known["f2"] == of["c2"]))
        self.members = self.ws.keep(joined.select("id", "n", "class"), "members")
        self.reps = self.ws.keep(joined.filter("id = rep").select(F.col("class").alias("id"), "rep", "n", "f1", "f2", "bands").dropDuplicates(["id"]), "reps")

    def shared_ids(self) -> DataFrame:
        """u, v: classes that hold the same id, each with the first of them."""
        several = self.members.groupBy("id").agg(F.min("class").alias("lead"), F.max("class").alias("last")).filter("lead < last")
        several = self.ws.keep(several.select("id", "lead"), "shared-ids")
        return self.members.join(several, "id").filter("class <> lead").select(F.col("lead").alias("u"), F.col("class").alias("v")).distinct()

    def buckets(self) -> DataFrame:
        """key, band, id, lead: the members of the buckets of two or more, and the first class of each."""
        members = self.reps.select("id", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "band", "id")
        leads = members.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        leads = self.ws.keep(leads, "leads")
        return self.ws.keep(members.join(leads, "key"), "buckets")

    def sets_of(self, ids: DataFrame, name: str) -> DataFrame:
        """id, items: the set of each class, made again from the text of a row that is in it."""
        wanted = self.reps.join(ids.select("id").distinct(), "id", "left_semi")
        wanted = self.ws.keep(wanted.select(F.col("id").alias("class"), "rep", F.col("f1").alias("g1"), F.col("f2").alias("g2")), f"ids-{name}")
        made = _sets(self.texts.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi"))
        own = made.join(wanted, (F.col("id") == F.col("rep")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")))
        return self.ws.keep(own.select(F.col("class").alias("id"), "items").dropDuplicates(["id"]), f"sets-{name}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b -> u, v, those whose full sets are linked."""
        pairs = self.ws.keep(pairs, "pairs")
        sets = self.sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "pairs")
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("xa"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("xb"))
        both = F.size(F.array_intersect("xa", "xb"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("xa") + F.size("xb")).alias("sum"))
        links = self.ws.keep(joined.filter("100L * both >= 75L * (sum - both)").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        self.ws.drop("sets-pairs", "ids-pairs", "pairs")
        return links

    def across(self, buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """u, v: links between components that share a bucket."""
        rooted = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("root"))
        rooted = self.ws.keep(rooted.join(self.reps.select("id", "n"), "id"), "rooted")
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("items")).filter("lo < hi")
        several = self.ws.keep(several.select("key", F.expr(f"greatest((members + {BLOCK - 1}) div {BLOCK}, (items + {BLOCK_ITEMS - 1}) div {BLOCK_ITEMS})").alias("parts")), "several")
        rows = rooted.join(several, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.select("key", "band", "id", "root", "n", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        rows = rows.join(self.reps.select("id", "bands"), "id")
        n = int(self.ws.spark.conf.get("spark.sql.shuffle.partitions"))
        together = lambda df: df.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        needed = self.ws.keep(_needed(together(rows)), "needed")
        sets = self.sets_of(needed, "needed")
        links = self.ws.keep(_linked(together(needed.join(sets, "id"))), "links-across")
        self.ws.drop("rooted", "several", "needed", "sets-needed", "ids-needed")
        return links

    def run(self) -> DataFrame:
        buckets = self.buckets()
        sigs = self.reps.select("id", "n", "bands")
        stars = buckets.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        stars = stars.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("sb")), "b")
        links = self.verified(_best(_agreeing(stars.select("a", "b", "na", "nb", "sa", "sb"))))
        links = links.union(self.ws.keep(self.shared_ids(), "links-shared"))
        roots = self.ws.keep(components(links, self.ws, "stars"), "roots")
        more = self.across(buckets, roots)
        if more.isEmpty():
            return roots
        return components(links.union(more), self.ws, "all")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id (as doc_id), n_shingles, component_id, kept."""
    work = Dedup(df, id_col, text_col)
    roots = work.run()
    rooted = work.classes.join(roots, work.classes["class"] == roots["node"], "left").select("class", "rep", F.coalesce("root", "class").alias("root"))
    rooted = work.ws.keep(rooted, "classes-rooted")
    least = work.ws.keep(rooted.groupBy("root").agg(F.min("rep").alias("component")), "components-least")
    named = work.ws.keep(rooted.join(least, "root").select("class", "component"), "classes-named")
    some = work.members.join(named, "class").select("id", "n", "component")
    # A row without words has the component of the others of its id, if there are any.
    none = work.sketches.filter("n = 0 or id is null").select("id", "n")
    own = work.ws.keep(some.join(none.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component").alias("component")), "of-empty")
    none = none.join(own, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return some.union(none).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
