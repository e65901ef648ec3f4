"""Synthetic graphs and features; the same seed gives the same tables whatever the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (1000, 5000, 10000, 20000)
PROBABILITIES = (0.001, 0.01, 0.5)
ATTACHED = 5
WIDTH = 10
PRIME = 1_000_003


def grid(spark: SparkSession, sizes=SIZES, probabilities=PROBABILITIES, replicates: int = 1, erdos_renyi: bool = False, scale_free: bool = True) -> DataFrame:
    """Parameters of graphs: graph_id, name, type, num_nodes, edge_prob (null for scale-free ones), replicate."""
    rows = []
    if erdos_renyi:
        rows += [(f"Erdos-Renyi_{n}_p_{p}_graph_{r}", "erdos-renyi", n, p, r) for n in sizes for p in probabilities for r in range(replicates)]
    if scale_free:
        rows += [(f"Scale-Free_{n}_graph_{r}", "scale-free", n, None, r) for n in sizes for r in range(replicates)]
    rows = [(str(k), *row) for k, row in enumerate(rows)]
    return spark.createDataFrame(rows, "graph_id string, name string, family string, num_nodes bigint, edge_prob double, replicate int").withColumn("type", F.lit("synthetic"))


def both_ways(pairs: DataFrame) -> DataFrame:
    edge = pairs.withColumn("v", F.lit(1.0).cast("float"))
    return edge.unionByName(edge.select(F.col("k").alias("i"), F.col("i").alias("k"), "v"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42, portable: bool = False) -> DataFrame:
    """Each pair i < k with probability p, decided by a hash of the pair: (i, k, v = 1), both directions. The portable
    hash is a linear one that any SQL engine can repeat, for tests. Looks at every pair."""
    pairs = spark.range(n - 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("k")) if n > 1 else spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("k"))
    if portable:
        drawn = (F.col("i") * 73856093 + F.col("k") * 19349663 + seed) % PRIME < p * PRIME
    else:
        drawn = F.pmod(F.xxhash64("i", "k", F.lit(seed)), F.lit(1 << 53)) < p * (1 << 53)
    return both_ways(pairs.filter(drawn))


def erdos_renyi_sparse(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """The same distribution in time proportional to the edges: each row skips from one neighbour to the next by
    geometric steps (Batagelj and Brandes 2005)."""

    def skip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found_i, found_k = [], []
            for i in frame["id"].tolist():
                rng, k = np.random.default_rng((seed, i)), i
                while p > 0:
                    k += int(rng.geometric(p)) if p < 1 else 1
                    if k >= n:
                        break
                    found_i.append(i)
                    found_k.append(k)
            yield pd.DataFrame({"i": found_i, "k": found_k}, dtype="int64")

    return both_ways(spark.range(n).mapInPandas(skip, "i long, k long"))


def attached(n: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Preferential attachment from a star of m + 1 nodes: each new node takes m different ones, chosen in
    proportion to their degrees. m (n - m) edges."""
    rng = np.random.default_rng(seed)
    ends = np.empty(2 * m * (n - m), np.int64)
    ends[: 2 * m : 2], ends[1 : 2 * m : 2] = 0, np.arange(1, m + 1)
    used = 2 * m
    for node in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(int(ends[rng.integers(used)]))
        for other in sorted(chosen):
            ends[used : used + 2] = node, other
            used += 2
    return ends[0::2], ends[1::2]


def scale_free(graphs: DataFrame, m: int = ATTACHED, seed: int = 42) -> DataFrame:
    """graphs (graph_id, num_nodes) -> (graph_id, i, k, v), both directions. A graph grows step by step, so each is
    made in one task, and many side by side."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.itertuples():
            key = np.frombuffer(str(row.graph_id).encode().ljust(8, b"\0")[:8], "<u4").tolist()
            a, b = attached(int(row.num_nodes), m, int(np.random.SeedSequence([seed, *key]).generate_state(1)[0]))
            out.append(pd.DataFrame({"graph_id": row.graph_id, "i": np.concatenate([a, b]), "k": np.concatenate([b, a])}))
        return pd.concat(out)

    return graphs.filter(F.col("num_nodes") > m).groupBy("graph_id").applyInPandas(lambda f: make(f), "graph_id string, i long, k long").withColumn("v", F.lit(1.0).cast("float"))


def random_features(nodes: DataFrame, width: int = WIDTH, seed: int = 42, node: str = "node", portable: int | None = None) -> DataFrame:
    """(k, j, w): numbers in [0, 1) from a hash of node and place. With ``portable``, whole multiples of its inverse
    from a linear hash that any SQL engine can repeat, for tests."""
    cells = nodes.select(F.col(node).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    if portable:
        drawn = (F.col("k") * 73856093 + F.col("j") * 19349663 + seed) % PRIME % portable
        return cells.withColumn("w", (drawn / F.lit(float(portable))).cast("float"))
    return cells.withColumn("w", (F.pmod(F.xxhash64("k", "j", F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))).cast("float"))
