"""Connected components by union-find grouping in partitions and contraction between them.

Each round first replaces the edges of every partition by a spanning forest (union-find), then contracts each
node into the neighbour that comes first, in odd rounds by number and in even ones in a hashed order drawn anew;
the edges between contracted nodes go on to the next round. The forests are stars around their smallest nodes,
which an odd round contracts at once; an even round contracts a constant share of nodes whatever the shape of the
graph, so chains need a logarithmic number of rounds. Nothing is gathered on the driver; every
round is a written table. Joins are between written tables, so adaptive execution may split hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


class Forest:
    """Union-find over 64-bit numbers; the smallest of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = list(self.parent)
        return np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)


MOST_EDGES = 1 << 20


def _forests(edges: DataFrame) -> DataFrame:
    """(u, v) -> the edges of spanning forests, one for each ``MOST_EDGES`` edges of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> pa.RecordBatch:
            nodes, roots = forest.edges()
            return pa.RecordBatch.from_pydict({"u": nodes, "v": roots})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(a, b)
            if len(forest.parent) >= MOST_EDGES:
                yield out()
                forest = Forest()
        yield out()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """edges (u long, v long), without nulls -> node, root for every node of an edge: the smallest node that
    can be reached. Loops and repeated edges do no harm."""
    edges = ws.keep(_forests(edges.select("u", "v").filter("u <> v")), f"{name}-0")
    first, parents, turn = edges, [], 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The neighbour that comes first in this round's order, or the node itself. The hashed order is that of
        # a map that is one to one for 64 bits, so that its smallest value names the node.
        there, back = (lambda c, t: c, lambda c, t: c) if turn % 2 else (_scrambled, _unscrambled)
        best = both.groupBy("u").agg(F.min(there(F.col("v"), turn)).alias("w")).select("u", F.least("w", there(F.col("u"), turn)).alias("w"))
        best = ws.keep(best.select("u", back(F.col("w"), turn).alias("p")), f"{name}-parents-{turn}")
        parents.append(best)
        by_u = edges.join(best, "u").select(F.col("v"), F.col("p").alias("a"))
        ends = by_u.join(best.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("p").alias("v"))
        edges = ws.keep(_forests(ends.filter("u <> v").distinct()), f"{name}-{turn}")
    if not parents:
        return first.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # A node's label: its parent, the parent's in the next round, and so on; a node that has no edge in a
    # round is its own parent.
    label = parents[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for best in parents[1:]:
        up = best.withColumnsRenamed({"u": "root", "p": "up"})
        label = label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    label = ws.keep(label, f"{name}-labels")
    least = ws.keep(label.groupBy("root").agg(F.min("node").alias("least")), f"{name}-least")
    return label.join(least, "root").select("node", F.col("least").alias("root"))


def _scrambled(c, turn: int):
    """A one-to-one map of 64-bit numbers that _unscrambled undoes: xor of a key with the halves swapped and
    mixed three times."""
    return _feistel(c, [turn * 3 + k for k in range(3)])


def _unscrambled(c, turn: int):
    return _feistel(c, [turn * 3 + k for k in reversed(range(3))], back=True)


def _feistel(c, keys: list[int], back: bool = False):
    low = F.lit(0xFFFFFFFF)
    left, right = F.shiftrightunsigned(c, 32), c.bitwiseAND(low)
    if back:
        left, right = right, left
    for k in keys:
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)).bitwiseAND(low))
    if back:
        left, right = right, left
    return F.shiftleft(left, 32).bitwiseOR(right)
