"""Table shapes, and checks of inputs that raise before a query is built on them.

A matrix or weighted graph is a table of cells (i, k, v); a feature matrix is long, (k, j, w), or wide, (k, x). Several
of either share a table with graph_id before these. Cells that are missing are zero; stored zeros count as cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _LONG, _INT, _DOUBLE, _FLOAT, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


METRIC_TREE = T.MapType(_STRING, T.MapType(_STRING, _table(value=_DOUBLE, unit=_STRING)))

GRAPHS = _table(graph_id=_STRING, name=_STRING, type=_STRING, num_nodes=_LONG, sparsity=_DOUBLE)
EDGES = _table(graph_id=_STRING, i=_LONG, k=_LONG, v=_FLOAT)
FEATURES = _table(graph_id=_STRING, k=_LONG, j=_INT, w=_FLOAT)
FEATURES_WIDE = _table(graph_id=_STRING, k=_LONG, x=T.ArrayType(_FLOAT))
ASSIGNMENTS = _table(graph_id=_STRING, node=_LONG, cluster=_INT)
CATALOGUE = _table(id=_INT, name=_STRING, group=_STRING, rows=_LONG, cols=_LONG, nnz=_LONG, sparsity=_DOUBLE, kind=_STRING, is2d3d=_BOOL, isSPD=_BOOL)
RESULTS = _table(method=_STRING, graph_idx=_STRING, graph_name=_STRING, graph_type=_STRING, date=_STRING, num_nodes=_LONG, sparsity=_DOUBLE, is_correct=_BOOL, metrics=METRIC_TREE)
RESULTS_FLAT = _table(graph_index=_STRING, graph_name=_STRING, graph_type=_STRING, method=_STRING, time_seconds=_DOUBLE, date=_STRING, num_nodes=_LONG, sparsity=_DOUBLE, memory_peak_mb=_DOUBLE, time_std=_DOUBLE)
METRIC_SAMPLES = _table(method=_STRING, graph_idx=_STRING, range=_STRING, metric=_STRING, action_id=_INT, value=_DOUBLE, value_str=_STRING, unit=_STRING)


class ShapeError(ValueError):
    pass


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ShapeError(f"columns {missing} are missing; there are {df.columns}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if two rows share a key. Reads the table."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ShapeError(f"{keys} isn't unique")
    return df


def require_multipliable(a_cols: int, x_rows: int) -> None:
    if a_cols != x_rows:
        raise ShapeError(f"{a_cols} columns don't match {x_rows} rows")


def require_square(rows: int, cols: int) -> None:
    if rows != cols:
        raise ShapeError(f"{rows} x {cols} isn't square")


def require_clusters(assignments: DataFrame) -> DataFrame:
    if assignments.filter(F.col("cluster").isNotNull()).isEmpty():
        raise ShapeError("no node has a cluster")
    return assignments
