"""Products and merges tile by tile: what meets in a tile of the result is added up in one task, so that only cells of
the inputs are shuffled, and neither products nor partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 21
#: Products in a tile beyond which its keys are dealt over several tasks.
HEAVY = 1 << 27
#: Keys in a piece of a row; places in it are short.
KEYS = 4096
#: Products a dense matrix product makes in the time of one by index.
DENSE = 80


def start(c: str, tile: int) -> Column:
    """The number at which the tile of c begins; null for null."""
    return F.col(c).cast("long") - F.pmod(F.col(c).cast("long"), F.lit(tile).cast("long"))


def place(c: str, tile: int) -> Column:
    return F.pmod(F.col(c).cast("long"), F.lit(tile).cast("long"))


def outer(ln: np.ndarray, ro: np.ndarray, rn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of ln left elements, one after the other, and of rn right ones from ro: the places of both in each pair of
    a group, some 2 million at a time."""
    reps, first = np.repeat(rn, ln), np.repeat(ro, ln)
    ends = np.cumsum(reps)
    cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK, (ends[-1] if len(ends) else 0) + BLOCK, BLOCK), "left") + 1)
    s = 0
    for e in np.minimum(cuts, len(reps)):
        r = reps[s:e]
        yield np.repeat(np.arange(s, e), r), np.arange(r.sum()) + np.repeat(first[s:e] - (np.cumsum(r) - r), r)
        s = e


class Tile:
    """Sums of products for the places (row, column) of one tile. Rows of layer n begin at n * tile."""

    def __init__(self, tile: int, whole: bool):
        self.tile, self.number, self.reach, self.near = tile, np.int64 if whole else np.float64, 0, None
        self.sums, self.seen, self.known = np.zeros(0, self.number), np.zeros(0, bool), None

    def add(self, ln, i, v, v_ok, rn, j, w, w_ok) -> None:
        """Groups of cells (i, v) and (j, w) that share a key; v_ok, w_ok: where there is a number, None if everywhere."""
        if not len(i) or not len(j):
            return
        size = -(-(int(i.max()) + 1) // self.tile) * self.tile * self.tile
        if size > len(self.sums):
            grow = lambda x: None if x is None else np.concatenate([x, np.zeros(size - len(x), x.dtype)])
            self.sums, self.seen, self.known, self.near = map(grow, (self.sums, self.seen, self.known, self.near))
        every = v_ok is None and w_ok is None
        if not every and self.known is None:
            self.known = self.seen.copy()
        if self.number is np.int64:
            top = [max(-int(c.min()), int(c.max())) for c in (v, w)]
            self.reach += top[0] * top[1] * max(len(i), len(j))
            if self.near is None and self.reach >= 1 << 63:
                self.near = self.sums.astype(np.float64)
            exact = top[0] * top[1] * len(ln) * 4 < 1 << 53 and self.near is None
        else:
            exact = bool(np.isfinite(v).all() and np.isfinite(w).all())
        rows, cols = int(i.max()) + 1, int(j.max()) + 1
        if every and exact and int(ln @ rn) * DENSE > rows * cols * len(ln):
            return self.add_dense(ln, i, v, rn, j, w, rows, cols)
        base, j = i * self.tile, j.astype(np.int64)
        for a, b in outer(ln, np.cumsum(rn) - rn, rn):
            at, x, y = base[a] + j[b], v[a], w[b]
            np.add.at(self.sums, at, x * y)
            self.seen[at] = True
            if self.near is not None:
                np.add.at(self.near, at, x.astype(np.float64) * y)
            if self.known is not None:
                ok = np.ones(len(at), bool)
                for side, where in ((v_ok, a), (w_ok, b)):
                    if side is not None:
                        ok &= side[where]
                self.known[at[ok]] = True

    def add_dense(self, ln, i, v, rn, j, w, rows, cols) -> None:
        """Small matrices, a thousand keys at a time."""
        ends_l, ends_r = np.cumsum(ln), np.cumsum(rn)
        for s in range(0, len(ln), 1024):
            n = min(1024, len(ln) - s)
            l = slice(ends_l[s] - ln[s], ends_l[s + n - 1])  # noqa: E741
            r = slice(ends_r[s] - rn[s], ends_r[s + n - 1])
            m, x = np.zeros((n, rows)), np.zeros((n, cols))
            hit_m, hit_x = np.zeros((n, rows), np.float32), np.zeros((n, cols), np.float32)
            for to, hit, k, at, value in ((m, hit_m, ln, i[l], v[l]), (x, hit_x, rn, j[r], w[r])):
                k = np.repeat(np.arange(n), k[s : s + n])
                np.add.at(to, (k, at), value)
                hit[k, at] = 1
            hits = hit_m.T @ hit_x > 0
            for to, new in ((self.sums, (m.T @ x).astype(self.number)), (self.seen, hits), (self.known, hits)):
                if to is not None:
                    to.reshape(-1, self.tile)[:rows, :cols] += new

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the cells that a product reaches: row, column, the sum over the layers, and how many layers have one (0:
        products were null)."""
        if self.near is not None and (np.abs(self.near) >= 2.0**63 * (1 - 1e-12)).any():
            raise OverflowError("a sum of products passes the range of long")
        of = lambda x: x.reshape(-1, self.tile * self.tile)
        at = np.flatnonzero(of(self.seen).any(axis=0))
        layers = of(self.seen if self.known is None else self.known)[:, at].sum(axis=0)
        return at // self.tile, at % self.tile, of(self.sums)[:, at].sum(axis=0), layers


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Lengths, elements, and which aren't null if some are."""
    flat = column.flatten()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not flat.null_count:
        return lengths, flat.to_numpy(zero_copy_only=False), None
    zero = pa.scalar(0, flat.type)
    return lengths, flat.fill_null(zero).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)


def _packed(df: DataFrame, by: str, value: Column, tile: int, t: str, at: str, c: str, layer: Column | None = None, layers: int = 1) -> DataFrame:
    """One row for each key and tile: the places in the tile and the numbers."""
    where = place(by, tile) if layer is None else place(by, tile) + layer * tile
    # Null rows have a tile of their own.
    cells = df.select("k", start(by, tile).alias(t), F.coalesce(where, F.lit(0)).cast("int" if tile * layers > 1 << 15 else "short").alias("o"), value.alias("c"))
    packs = cells.filter("k is not null").groupBy("k", t).agg(F.collect_list(F.struct("o", "c")).alias("cells"))
    return packs.select("k", t, F.col("cells")["o"].alias(at), F.col("cells")["c"].alias(c))


def products(a: DataFrame, x: DataFrame, tile: int, whole: bool, layer: Column | None = None, layers: int = 1, heavy: int | None = None) -> DataFrame:
    """(i, j, val, layers): the sums of products of A (i, k, v) and X (k, j, w). Each key's cells of a tile of rows and of
    a tile of columns go, packed, to the task of that tile of the result, which adds up their products; it holds
    tile * tile sums, whatever the size of the whole. Sides that are dealt by k already are shuffled no more before. Tiles of more than ``heavy`` products are made by several
    tasks, by keys, and these results are summed. ``layer``, below ``layers``: rows of A with several come to one sum over them."""
    kind = "bigint" if whole else "double"
    left = _packed(a, "i", F.col("v").cast(kind), tile, "ti", "li", "lv", layer, layers)
    right = _packed(x, "j", F.col("w").cast(kind), tile, "tj", "rj", "rw")
    joined = left.join(right, "k")
    most = HEAVY if heavy is None else heavy
    counts = joined.groupBy("ti", "tj").agg(F.sum(F.size("lv").cast("long") * F.size("rw")).alias("n"))
    dealt = counts.filter(F.col("n") > most).select(F.col("ti").alias("hi"), F.col("tj").alias("hj"), F.ceil(F.col("n") / most).alias("parts"))
    is_heavy = F.col("ti").eqNullSafe(F.col("hi")) & F.col("tj").eqNullSafe(F.col("hj"))

    def multiplied(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Tile(tile, whole)
        for b in batches:
            (ln, i, _), (_, v, v_ok), (rn, j, _), (_, w, w_ok) = (_lists(b.column(c)) for c in ("li", "lv", "rj", "rw"))
            out.add(ln, i.astype(np.int64), v, v_ok, rn, j, w, w_ok)
        i, j, val, layers = out.result()
        for s in range(0, len(i), BLOCK):
            e = slice(s, s + BLOCK)
            ids = [pa.nulls(len(o[e]), pa.int64()) if t.as_py() is None else pa.array(o[e] + t.as_py(), pa.int64()) for t, o in ((key[0], i), (key[1], j))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(val[e], mask=layers[e] == 0), pa.array(layers[e], pa.int64())], ["i", "j", "val", "layers"])

    shape, cells = f"i long, j long, val {kind}, layers long", ("li", "lv", "rj", "rw")
    light = joined.join(F.broadcast(dealt), is_heavy, "left_anti").select("ti", "tj", *cells)
    split = joined.join(F.broadcast(dealt), is_heavy).select("ti", "tj", F.pmod(F.xxhash64("k"), "parts").alias("part"), *cells)
    light = light.groupBy("ti", "tj").applyInArrow(multiplied, shape)
    split = split.groupBy("ti", "tj", "part").applyInArrow(multiplied, shape)
    return light.unionByName(split.groupBy("i", "j").agg(F.sum("val").cast(kind).alias("val"), F.max("layers").alias("layers")))


class Steps:
    """Steps of the merges of all rows with all columns of a tile, and which of them meet. Pieces of rows and columns
    come by falling keys, so that each one's last key is known before its smaller ones come."""

    def __init__(self, tile: int):
        self.steps, self.both = np.zeros((tile, tile), np.int64), np.zeros((tile, tile), np.int64)
        self.seen = np.zeros(tile, bool), np.zeros(tile, bool)

    def add(self, row: tuple[np.ndarray, np.ndarray], col: tuple[np.ndarray, np.ndarray]) -> None:
        """Places in the tile and keys in a range of KEYS keys, of rows and of columns."""
        last = []
        for (at, k), seen in zip((row, col), self.seen, strict=True):
            top = np.full(len(seen), -1, np.int64)
            np.maximum.at(top, at, k)
            # Those that have larger keys elsewhere take all keys of this range.
            last.append(np.where(seen, KEYS, top))
        for (at, k), limit, steps in ((row, last[1], self.steps), (col, last[0], self.steps.T)):
            limits, which = np.unique(limit, return_inverse=True)
            upto = np.zeros((len(steps), len(limits) + 1), np.int64)
            np.add.at(upto, (at, np.searchsorted(limits, k, "left")), 1)
            steps += np.cumsum(upto, axis=1)[:, which]
        for (at, _), seen in zip((row, col), self.seen, strict=True):
            seen[at] = True
        shared = np.intersect1d(row[1], col[1])
        (at, k), (to, m) = ((x[0][ok], x[1][ok]) for x in (row, col) for ok in [np.isin(x[1], shared)])
        a, b = np.argsort(k, kind="stable"), np.argsort(m, kind="stable")
        at, to = at[a], to[b]
        n, o = (np.diff(np.searchsorted(x, shared, "left"), append=len(x)) for x in (k[a], m[b]))
        flat = self.both.reshape(-1)
        for x, y in outer(n, np.cumsum(o) - o, o):
            np.add.at(flat, at[x] * len(self.both) + to[y], 1)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.both)
        return i, j, (self.steps - self.both)[i, j]


def _pieces(df: DataFrame, by: str, tile: int) -> DataFrame:
    """(t, piece, o, ks): the keys of each row, in pieces of KEYS."""
    cells = df.filter(f"{by} is not null and k is not null").groupBy(by, start("k", KEYS).alias("piece")).agg(F.collect_list(place("k", KEYS).cast("short")).alias("ks"))
    return cells.select(start(by, tile).alias("t"), "piece", place(by, tile).cast("int").alias("o"), "ks")


def merges(rows: DataFrame, cols: DataFrame, tile: int) -> DataFrame:
    """rows (i, k) and cols (j, k), distinct -> (i, j, steps). The rows and columns of tiles that have a range of keys in
    common go, in pieces, to one task for each pair of tiles, which holds tile * tile counts."""
    left, right = _pieces(rows, "i", tile), _pieces(cols, "j", tile)
    meet = left.select(F.col("t").alias("ti"), "piece").distinct().join(right.select(F.col("t").alias("tj"), "piece").distinct(), "piece").select("ti", "tj").distinct()
    sides = [p.join(meet, p["t"] == meet[to]).select("ti", "tj", "piece", F.lit(n).alias("side"), "o", "ks") for n, (p, to) in enumerate(((left, "ti"), (right, "tj")))]
    both = sides[0].unionByName(sides[1]).repartition("ti", "tj").sortWithinPartitions("ti", "tj", F.desc("piece"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The records of a piece that are in one batch."""
        for b in batches:
            ti, tj, piece, side, o = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ti", "tj", "piece", "side", "o"))
            n, ks, _ = _lists(b.column("ks"))
            ends = np.cumsum(n)
            cuts = np.flatnonzero((np.diff(ti) != 0) | (np.diff(tj) != 0) | (np.diff(piece) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ti)], strict=True):
                if s < e:
                    of, at = np.repeat(side[s:e], n[s:e]), np.repeat(o[s:e].astype(np.int64), n[s:e])
                    yield (int(ti[s]), int(tj[s])), int(piece[s]), of, at, ks[ends[s] - n[s] : ends[e - 1]].astype(np.int64)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ti, tj), group in groupby(records(batches), key=lambda r: r[0]):
            out = Steps(tile)
            for _, parts in groupby(group, key=lambda r: r[1]):
                of, at, k = (np.concatenate(x) for x in zip(*(r[2:] for r in parts), strict=True))
                out.add(*((at[of == n], k[of == n]) for n in (0, 1)))
            i, j, steps = out.result()
            for s in range(0, len(i), BLOCK):
                e = slice(s, s + BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(i[e] + ti), pa.array(j[e] + tj), pa.array(steps[e])], ["i", "j", "steps"])

    return both.mapInArrow(merged, "i long, j long, steps long")
