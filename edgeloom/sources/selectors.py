"""Which graphs a pattern names: ``all``, numbers, ranges and lists of both, or parts of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalogue import contains_any


def number_ranges(pattern: str) -> list[tuple[int, int]]:
    """``0-2,5`` -> [(0, 2), (5, 5)]."""
    out = []
    for part in pattern.split(","):
        low, _, high = part.strip().partition("-")
        out.append((int(low), int(high or low)))
    return out


def select_numbers(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    """Rows whose number the pattern names; no pattern names none."""
    if pattern == "all":
        return df
    wanted: Column = F.lit(False)
    for low, high in number_ranges(pattern) if pattern else ():
        wanted = wanted | F.col(column).between(low, high)
    return df.where(wanted)


def select_names(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    """Rows whose name holds one of the comma-separated parts."""
    return contains_any(df, column, pattern)


def select(graphs: DataFrame, synthetic: str | None = None, matrices: str | None = None, networks: str | None = None) -> DataFrame:
    """graphs (graph_id, name, type): synthetic ones by number, matrices and networks by name, one after another."""
    if synthetic is matrices is networks is None:
        raise ValueError("no graphs are named")
    kind = lambda t: graphs.where(F.col("type") == t)
    numbered = select_numbers(kind("synthetic").withColumn("__n", F.col("graph_id").try_cast("long")), "__n", synthetic).drop("__n")
    return numbered.unionByName(select_names(kind("matrix"), "name", matrices)).unionByName(select_names(kind("snap"), "name", networks))
