"""Partitioning of graphs: clusters grown breadth first within a budget of edges, or by the Fiedler vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import require_clusters
from .stats import degrees, edge_density

THRESHOLD = 0.5


def bfs_hop(edges: DataFrame, frontier: DataFrame, degree: DataFrame, budget: int, threshold: float, spent: int = 0) -> DataFrame:
    """edges (i, k, weight), frontier (node) -> (node, expanded): the frontier's nodes are taken in the order of
    falling degree, then number, and expanded while those before them have fewer edges than the budget; claimed,
    expanded = false, are the neighbours of these over edges heavier than the threshold, without the frontier."""
    # Each node that counts has an edge at least, so the first ``budget`` use the budget up: those are found by a
    # distributed top-k, and only they go through the running sum.
    order = Window.orderBy(F.desc("degree"), "node").rowsBetween(Window.unboundedPreceding, -1)
    first = frontier.join(degree.filter("degree > 0"), "node").orderBy(F.desc("degree"), "node").limit(budget)
    ranked = first.withColumn("before", F.coalesce(F.sum("degree").over(order), F.lit(0)) + spent)
    expanded = ranked.filter(F.col("before") < budget).select("node")
    near = edges.filter(F.col("weight") > threshold).join(expanded.withColumnRenamed("node", "i"), "i", "left_semi")
    claimed = near.select(F.col("k").alias("node")).distinct().join(frontier, "node", "left_anti")
    return expanded.withColumn("expanded", F.lit(True)).unionByName(claimed.withColumn("expanded", F.lit(False)))


def grow_clusters(a: DataFrame, nodes: int, budget: int, clusters: int, threshold: float = THRESHOLD) -> DataFrame:
    """(node, cluster): up to ``clusters`` clusters of a symmetric graph, each from the unassigned node of the highest
    degree (the lowest number of several), grown breadth first over unassigned neighbours until ``budget`` edges
    are used up or nothing is left. Nodes that none reaches have the cluster null."""
    a = cut(a)
    degree = cut(degrees(a))
    edges = cut(edge_density(a, nodes, degree).filter(F.col("weight") > threshold).select("i", "k", "weight"))
    taken = cut(degree.select("node", F.lit(None).cast("int").alias("cluster")).limit(0))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for cluster in range(clusters):
        frontier, spent = cut(next_seed(degree, taken)), 0
        if frontier.isEmpty():
            break
        while True:
            # A union has the parts of both; without a bound they would grow with the levels.
            both = taken.unionByName(frontier.select("node", F.lit(cluster).alias("cluster")))
            taken = cut(both.coalesce(parts))
            hop = bfs_hop(edges, frontier, degree, budget, threshold, spent)
            found = hop.filter("not expanded").join(taken, "node", "left_anti").withColumn("degree", F.lit(None).cast("long"))
            hop = cut(hop.filter("expanded").join(degree, "node").unionByName(found))
            told = hop.agg(F.sum("degree").alias("spent"), F.count_if(~F.col("expanded")).alias("found")).first()
            spent += told["spent"] or 0
            if spent >= budget or not told["found"]:
                break
            frontier = hop.filter("not expanded").select("node")
    return degree.select("node").join(taken, "node", "left")


def next_seed(degree: DataFrame, taken: DataFrame) -> DataFrame:
    """(node): of those not taken, the node of the highest degree, the lowest number of several; or no row."""
    return degree.join(taken, "node", "left_anti").orderBy(F.desc("degree"), "node").limit(1).select("node")


def covering(assignments: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of fewer than ``least`` nodes, and nodes without one, become one cluster of their own, -1."""
    sizes = assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    kept = sizes.filter((F.col("size") >= least) & F.col("cluster").isNotNull()).select("cluster", F.lit(True).alias("kept"))
    return assignments.join(kept, "cluster", "left").select("node", F.when(F.col("kept"), F.col("cluster")).otherwise(F.lit(-1)).alias("cluster"))


def clusters_of(a: DataFrame, nodes: int, budget: int, clusters: int, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters that cover all nodes; raises if there is no node."""
    return require_clusters(covering(grow_clusters(a, nodes, budget, clusters, threshold)))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def submatrices(a: DataFrame, assignments: DataFrame) -> DataFrame:
    """The cells of each cluster's rows: (cluster, i, k, v). Columns are those that its rows have."""
    return a.join(assignments.select(F.col("node").alias("i"), "cluster"), "i").select("cluster", "i", "k", "v")


def subfeatures(a: DataFrame, x: DataFrame, assignments: DataFrame) -> DataFrame:
    """The features that each cluster needs, of its nodes and their neighbours: (cluster, k, j, w)."""
    cells = submatrices(a, assignments)
    needed = cells.select("cluster", "k").union(assignments.select("cluster", F.col("node").alias("k"))).distinct()
    return needed.join(x, "k").select("cluster", "k", "j", "w")


def split_by(scores: DataFrame, threshold: float, score: str = "f") -> DataFrame:
    """part = 1 above the threshold, 0 otherwise."""
    return scores.withColumn("part", F.when(F.col(score) > threshold, 1).otherwise(0))


def fiedler(a: DataFrame, tolerance: float = 1e-8, steps: int = 24, restarts: int = 40, seed: int = 1) -> DataFrame | None:
    """(node, f): the eigenvector to the second smallest eigenvalue of the normalised Laplacian L of a symmetric graph,
    of unit length, its first entry that isn't 0 positive; null for fewer than two nodes. Lanczos steps on 2I - L
    without its known first eigenvector, each a join and a sum over the edges, with the basis as an array beside
    each node; after ``steps`` it starts again from the best vector. It ends when |(2I - L) f - value f| is at most
    ``tolerance``, and raises if it isn't after all restarts. The driver holds a matrix of ``steps`` squared."""
    degree = cut(a.groupBy("i").agg(F.sum("v").cast("double").alias("d")).filter("d > 0"))
    n = degree.count()
    if n < 2:
        return None
    scaled = a.join(degree, "i").join(degree.withColumnsRenamed({"i": "k", "d": "dk"}), "k")
    scaled = cut(scaled.groupBy("i", "k").agg((F.sum("v") / F.sqrt(F.first("d") * F.first("dk"))).alias("m")))
    total = degree.agg(F.sum("d")).first()[0]
    start = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20) - 0.5
    first = degree.select(F.col("i").alias("node"), F.sqrt(F.col("d") / total).alias("u"), start.alias("f"))
    for _ in range(restarts):
        basis, h = cut(first.select("node", F.array("u").alias("q"), F.col("f").alias("y"))), np.zeros((steps + 2, steps + 2))
        for step in range(steps + 1):
            y = F.col("y")
            # Twice, as once leaves rounding errors of the size of what was taken away.
            for _ in range(2):
                dots = basis.agg(*[F.sum(y * F.get("q", F.lit(k))).alias(str(k)) for k in range(step + 1)], F.sum(y * y).alias("own")).first()
                for k in range(step + 1):
                    y = y - F.get("q", F.lit(k)) * F.lit(dots[k])
                    h[k, step] += dots[k]
            norm = max(0.0, dots["own"] - sum(d * d for d in dots[:-1])) ** 0.5
            # Row and column 0 are those of the known eigenvector.
            values, vectors = np.linalg.eigh((h[1 : step + 1, 1 : step + 1] + h[1 : step + 1, 1 : step + 1].T) / 2) if step else (None, np.ones((1, 1)))
            done = norm < 1e-12 or step and norm * abs(vectors[-1, -1]) <= tolerance
            if done or step == steps:
                break
            h[step + 1, step] = norm
            grown = basis.select("node", F.array_append("q", y / F.lit(norm)).alias("q"))
            last = grown.select(F.col("node").alias("k"), F.element_at("q", -1).alias("x"))
            product = scaled.join(last, "k").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("m") * F.col("x")).alias("s"))
            basis = cut(grown.join(product, "node", "left").select("node", "q", (F.element_at("q", -1) + F.coalesce("s", F.lit(0.0))).alias("y")))
        parts = [F.get("q", F.lit(k + 1)) * F.lit(float(x)) for k, x in enumerate(vectors[:, -1])] if step else [y]
        first = cut(basis.select("node", F.get("q", F.lit(0)).alias("u"), sum(parts[1:], parts[0]).alias("f")))
        if done:
            lead = first.filter("abs(f) > 1e-9").orderBy("node").limit(1).first()
            length = first.agg(F.sqrt(F.sum(F.col("f") * F.col("f")))).first()[0]
            return first.select("node", (F.col("f") / F.lit(length if lead is None or lead["f"] > 0 else -length)).alias("f"))
    raise ArithmeticError(f"no eigenvector within {tolerance} after {restarts} x {steps} steps")
