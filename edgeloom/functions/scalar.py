"""Scalar functions: rounding to half precision, sizing arithmetic, labels, fallbacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _half(values: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series(values.to_numpy(np.float64).astype(np.float16).astype(np.float64))


def to_half(c: str | Column) -> Column:
    """The nearest number of half precision; there is no JVM function for it."""
    return _half(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"))


def truncated(c: Column) -> Column:
    """Towards zero."""
    return c.cast("bigint")


def sparsity(nnz: Column, rows: Column, cols: Column) -> Column:
    """The share of cells that are not stored; null if there are none at all."""
    return 1 - F.try_divide(nnz, rows * cols)


def sparsity_of_edges(edges: Column, nodes: Column) -> Column:
    """The same with each undirected edge counted once."""
    return 1 - F.try_divide(edges, nodes * nodes)


def matrix_label(nodes: Column, share: Column, stem: Column) -> Column:
    return F.format_string("%d_p_%.2f_%s", nodes, share, stem)


def graph_label(index: Column, nodes: Column, share: Column, name: Column) -> Column:
    return F.concat(index, F.lit(" (n="), nodes.cast("string"), F.lit(" p="), F.coalesce(share.cast("string"), F.lit("N/A")), F.lit(")\n"), name)


def number_first(c: Column) -> list[Column]:
    """Sort columns: numbers by value before other strings."""
    return [c.try_cast("bigint").asc_nulls_last(), c.asc()]


def first_parts(c: Column) -> tuple[Column, Column]:
    """The two words of a range's name: range and graph."""
    words = F.split(F.trim(c), r"\s+")
    return F.get(words, F.lit(0)), F.get(words, F.lit(1))


def cluster_limits(nodes: Column, edges: Column, width: Column, free: Column) -> dict[str, Column]:
    """How many clusters, and how large, so that one fits: 80 % of ``free`` bytes less 4 a node and 12 an edge,
    at 12 + 4 width bytes an edge; no cluster beyond a fifth of the edges; at most 32 clusters and one for each 10
    nodes, unless more are needed. Null where a cluster could hold no edge."""
    base = nodes * 4 + edges * 12
    each = width * 4 + 12
    room = truncated((free * F.lit(0.8) - base) / each)
    most = F.least(room, truncated(edges * F.lit(0.2)))
    most = F.when(most > 0, most)
    least_clusters = truncated(F.floor(edges / most)) + 1
    most_clusters = F.least(truncated(F.floor(nodes / 10)), F.lit(32).cast("bigint"))
    number = F.greatest(least_clusters, F.least(most_clusters, truncated(F.sqrt(edges / most))))
    number = F.when(most.isNotNull(), number)
    return {"max_edges_per_cluster": most, "num_clusters": number, "memory_per_cluster": most * each, "total_memory_needed": base + number * most * each}


def optimal_clusters(avg_degree: Column, density: Column, memory: Column, units: Column, unit_threads: int = 1024) -> dict[str, Column]:
    """Targets from processing units and memory: 32 blocks of up to 256 threads a unit."""
    threads = min(256, unit_threads)
    at_once = units * (32 * threads)
    edges = F.least(memory * F.lit(0.8) / 12 / 10, at_once * avg_degree, avg_degree * F.sqrt(density * at_once))
    return {"target_edges_per_cluster": truncated(edges), "num_clusters": F.greatest(F.lit(2).cast("bigint"), truncated(avg_degree * density * units)), "threads_per_block": F.lit(threads).cast("bigint"), "max_concurrent_threads": truncated(at_once)}


def multiply_memory(a_nnz: Column, a_rows: Column, x_nnz: Column, x_rows: Column, width: Column) -> Column:
    """Bytes of two row-compressed matrices of 4-byte numbers and the full result."""
    return (a_nnz + x_nnz) * 8 + (a_rows + 1 + x_rows + 1) * 4 + a_rows * width * 4
