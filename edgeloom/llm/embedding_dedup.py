"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept of a group.

Equal vectors are one class, whose smallest id goes on with the number of copies. k-means on the unit sphere is
fitted on about ``SAMPLE`` vectors (the documented bound; all vectors are assigned and compared). There is a cell for
``PER_CELL`` vectors at any size: beyond ``LEVEL`` centres, what is left of a vector without its centre is assigned
to centres of a further level, and so on, and a cell is a centre of each; the model is a table of ``LEVEL`` centres a
level. Each vector enters the ``PROBES`` nearest cells, four times as many with each further level; a pair is compared in every cell that both enter, and its
link counts in the first of these. A pair that shares no cell is not found: the tests and the README have the
measured recall for numbers of cells from one to a million. With ``exact`` each vector enters every cell in which
a vector linked with it might have its nearest centres, by its distance from the planes between the centres; then no
link is lost, and the pairs compared may come near all there are if the vectors have no clusters.

Whatever a cell's size, it is compared whole, in blocks of ``BLOCK`` vectors dealt over tasks, and a block emits one
row per vector and not per pair. As n_links is a number of links, a group of n different vectors that are all linked
costs n squared cosines.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
as do those with a null id; vectors of different lengths don't link; n_links counts rows, so equal rows count
as links of each other; an empty table gives an empty table; only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import grouped
from .components import components
from .tables import Workspace

THRESHOLD = 0.9
SAMPLE = 20_000
VALUES = 1 << 22
PER_CELL = 256
LEVEL = 1024
PROBES = 8
ROUNDS = 8
BLOCK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of unit length; an empty cell takes the vector farthest from its own centre."""
    rng = np.random.default_rng(seed)
    x = unit(x)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        best, near = nearest(x, centres, 1)
        cell = best[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        empty = np.nonzero(np.bincount(cell, minlength=k) == 0)[0]
        sums[empty] = x[np.argsort(near[:, 0], kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the nearest centres and the cosines, of centres of unit length."""
    probes = min(probes, len(centres))
    cells, cosines = [], []
    for at in range(0, len(x), 4096):
        c = x[at : at + 4096] @ centres.T
        top = np.argpartition(-c, probes - 1, axis=1)[:, :probes]
        cells.append(top)
        cosines.append(np.take_along_axis(c, top, axis=1))
    return np.concatenate(cells), np.concatenate(cosines)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, of all rows from all centres."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 2) -> np.ndarray:
    """Centres by squared distance; an empty cell keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([distances(x[at : at + 4096], centres).argmin(axis=1) for at in range(0, len(x), 4096)])
        sums, count = np.zeros_like(centres), np.bincount(cell, minlength=k)
        np.add.at(sums, cell, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def levels_of(x: np.ndarray, cells: int, most: int | None = None) -> list[np.ndarray]:
    """Centres of each level, fitted on the sample x: ``cells`` cells or somewhat more in all."""
    x, out, most = unit(x), [], min(most or LEVEL, len(x))
    while cells > 1 or not out:
        k = max(1, min(most, cells))
        out.append(kmeans(x, k) if out else spherical_kmeans(x, k))
        best = np.concatenate([distances(x[at : at + 4096], out[-1]).argmin(axis=1) for at in range(0, len(x), 4096)])
        x, cells = x - out[-1][best], -(-cells // k) if k > 1 else 1
    return out


def probes_of(levels: list[np.ndarray]) -> int:
    return PROBES * 4 ** (len(levels) - 1)


def cells_of(x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The numbers of the nearest cells of unit vectors, sorted: on each level the best few of all that go on from
    the best of the level before."""
    number, left, probes = np.zeros((len(x), 1), np.int64), x[:, None, :], probes_of(levels)
    for k, centres in enumerate(levels):
        keep = probes if k == len(levels) - 1 else 2 * probes
        off = np.stack([distances(left[:, b], centres) for b in range(left.shape[1])], axis=1).reshape(len(x), -1)
        number = (number[:, :, None] * len(centres) + np.arange(len(centres))[None, None, :]).reshape(len(x), -1)
        if off.shape[1] > keep:
            best = np.argpartition(off, keep - 1, axis=1)[:, :keep]
            number = np.take_along_axis(number, best, axis=1)
        else:
            best = np.broadcast_to(np.arange(off.shape[1]), off.shape)
        if k < len(levels) - 1:
            left = np.take_along_axis(left, (best // len(centres))[:, :, None], axis=1) - centres[best % len(centres)]
    return np.sort(number, axis=1)


def reach_of(x: np.ndarray, levels: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: row and cell of every cell in which a vector linked with the row's might have its nearest
    centres; and the row's own cell. A vector within that distance of the row's can be nearer to another centre than
    to the row's own only if the plane between both centres is within that distance."""
    most = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    row, cell, left = np.arange(len(x)), np.zeros(len(x), np.int64), x
    own, own_left = np.zeros(len(x), np.int64), x
    for centres in levels:
        d = distances(own_left, centres).argmin(axis=1)
        own, own_left = own * len(centres) + d, own_left - centres[d]
        rows, cells, rest = [], [], []
        for at in range(0, len(row), 2048):
            part = left[at : at + 2048]
            d = distances(part, centres)
            best = d.argmin(axis=1)
            apart = np.sqrt(np.maximum(distances(centres[best], centres), 0))
            p, q = np.nonzero((d - d[np.arange(len(part)), best][:, None]) / 2 <= most * apart + 1e-9)
            rows.append(row[at + p])
            cells.append(cell[at + p] * len(centres) + q)
            rest.append(part[p] - centres[q])
        row, cell, left = (np.concatenate(v) for v in (rows, cells, rest))
    return row, cell, own


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assigned(reps: DataFrame, centres: dict[int, list[np.ndarray]], threshold: float | None) -> DataFrame:
    """A row for each vector and cell it enters: cell (of all lengths, numbered on), rep, copies, cells (all of them;
    with a threshold, for all links, the own one alone), vec."""
    starts, count = {}, 0
    for dim, levels in sorted(centres.items()):
        starts[dim] = count
        count += math.prod(map(len, levels))
    shared = reps.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                levels = shared.value[dim]
                most = max(16, min(2048, VALUES // (2 * probes_of(levels) * (dim + LEVEL * (len(levels) > 1)))))
                for at in range(0, part.num_rows, most):
                    some = part.slice(at, most)
                    x = unit(_matrix(some.column(2)))
                    if threshold is None:
                        cells = cells_of(x, shared.value[dim]) + starts[dim]
                        row, cell = np.repeat(np.arange(len(x)), cells.shape[1]), cells.ravel()
                    else:
                        row, cell, own = reach_of(x, shared.value[dim], threshold)
                        cell, cells = cell + starts[dim], own[:, None] + starts[dim]
                    for lo in range(0, len(row), 1 << 14):
                        r = row[lo : lo + (1 << 14)]
                        again = some.take(pa.array(r))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + (1 << 14)], pa.int64()), again.column(0), again.column(1), pa.array(list(cells[r]), pa.list_(pa.int64())), again.column(2)], names=["cell", "rep", "copies", "cells", "vec"])

    return reps.select("rep", "copies", "vec", F.size("vec").alias("dim")).mapInArrow(run, "cell long, rep long, copies long, cells array<long>, vec array<double>")


def _compare(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    good = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), 512):
        good[at : at + 512] = a[at : at + 512] @ b.T / (na[at : at + 512, None] * nb[None, :]) >= threshold
    return good


def _linked(rows: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """rows: cell, i, j, part, rep, copies, cells, vec, with those of one block pair together -> rep, links,
    root: what the block pair adds to the links of a vector, and the smallest vector that it reaches there. A link
    counts in the first cell that both enter; if ``exact``, for either in the other's own cell, which both enter."""

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, cell = (table.column(k)[0].as_py() for k in ("i", "j", "cell"))
        part, rep, copies = (table.column(k).to_numpy() for k in ("part", "rep", "copies"))
        cells, x = (_matrix(table.column(k).chunk(0)) for k in ("cells", "vec"))
        p, q = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
        if not len(p) or not len(q):
            return
        good = _compare(x[p], x[q], threshold)
        if i == j:
            np.fill_diagonal(good, False)
        links = np.zeros(len(rep), np.int64)
        for at in range(0, len(p), 128):
            a, b = np.nonzero(good[at : at + 128])
            a, b = p[a + at], q[b]
            if exact:
                np.add.at(links, a, copies[b] * (cells[b, 0] == cell))
                if i != j:
                    np.add.at(links, b, copies[a] * (cells[a, 0] == cell))
                continue
            shared = (cells[a][:, :, None] == cells[b][:, None, :]).any(axis=2)
            first = np.where(shared, cells[a], np.inf).min(axis=1) == cell
            a, b = a[first], b[first]
            np.add.at(links, a, copies[b])
            if i != j:
                np.add.at(links, b, copies[a])
        root = rep.copy()
        while True:
            before = root.copy()
            root[p] = np.minimum(root[p], np.where(good, root[q][None, :], np.iinfo(np.int64).max).min(axis=1))
            root[q] = np.minimum(root[q], np.where(good, root[p][:, None], np.iinfo(np.int64).max).min(axis=0))
            if (root == before).all():
                break
        some = (links > 0) | (root != rep)
        yield pa.RecordBatch.from_pydict({"rep": rep[some], "links": links[some], "root": root[some]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            yield from group(table.combine_chunks())

    return rows.select("cell", "i", "j", "part", "rep", "copies", "cells", "vec").mapInArrow(run, "rep long, links long, root long")


def fit(reps: DataFrame) -> dict[int, list[np.ndarray]]:
    """Centres of all levels by length of vectors, from a bounded sample."""
    centres = {}
    for r in reps.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        most = max(1, min(SAMPLE, VALUES // r["dim"]))
        part = reps.filter(F.size("vec") == r["dim"])
        if r["n"] > most:
            part = part.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < F.lit(-(-(most << 20) // r["n"])))
        x = np.array([row["vec"] for row in part.select("vec").toLocalIterator()], np.float64).reshape(-1, r["dim"])
        centres[r["dim"]] = levels_of(x, max(1, r["n"] // PER_CELL)) if len(x) else [np.eye(1, r["dim"])]
    return centres


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """One row per row of ``df``: id (as vec_id), n_links, component_id, kept. If ``exact``, with all links."""
    ws = Workspace(df.sparkSession, "vectors")
    vec = df[vec_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("id"), vec.alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    # Two hashes of the vector from different seeds; one that goes on from the other would add nothing to it.
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    keys = ws.keep(rows.select("id", "sound", "h1", "h2"), "keys")
    classes = ws.keep(keys.filter("sound").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    first = classes.withColumnsRenamed({"h1": "g1", "h2": "g2"})
    vecs = rows.filter("sound").join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("id") == F.col("rep")))
    reps = ws.keep(vecs.select("rep", "copies", "vec", "h1", "h2").dropDuplicates(["h1", "h2"]).select("rep", "copies", "vec"), "reps")
    assigned = ws.keep(_assigned(reps, fit(reps), threshold if exact else None), "assigned")
    sizes = ws.keep(assigned.groupBy("cell").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    blocks = assigned.join(sizes, "cell").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = blocks.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "copies", "cells", "vec")
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    linked = ws.keep(_linked(blocks.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j"), threshold, exact), "linked")
    ws.drop("assigned")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")), ws)
    known = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = ws.keep(known.select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "known")
    some = keys.filter("sound").join(known, ["h1", "h2"]).select("id", "n_links", "root")
    out = some.union(keys.filter("not sound").select("id", F.lit(0).cast("long"), F.col("id").alias("root")))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
