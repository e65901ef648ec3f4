"""Running methods over many graphs, with a row of the results store for each method and graph."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import RESULTS
from .multiply import multiply_graphs
from .verify import ATOL, RTOL, differences


def run_methods(graphs: DataFrame, edges: DataFrame, features: DataFrame, methods: list[str], date: str | None = None, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """graphs (graph_id, name, type, num_nodes, sparsity), edges (graph_id, i, k, v), features (graph_id, k, j, w) ->
    rows of the results store: whether each graph's product agrees with that of the first method, and as metrics
    its cells and the seconds of the method, which makes the products of all graphs in one job."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    edges, features, out, expected = cut(edges), cut(features), None, None
    for method in methods:
        start = time.perf_counter()
        made = cut(multiply_graphs(edges, features, method))
        seconds = time.perf_counter() - start
        expected = made if expected is None else expected
        close = differences(expected, made, rtol, atol, ("graph_id", "i", "j")).groupBy("graph_id").agg(F.bool_and("close").alias("close"))
        cells = made.groupBy("graph_id").agg(F.count(F.lit(1)).alias("cells"))
        known = graphs.join(close, "graph_id", "left").join(cells, "graph_id", "left")
        metric = lambda value, unit: F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"))
        main = F.create_map(F.lit("cells"), metric(F.coalesce("cells", F.lit(0)), "cell"), F.lit("time_all_graphs"), metric(F.lit(seconds), "s"))
        rows = known.select(F.lit(method).alias("method"), F.col("graph_id").alias("graph_idx"), F.col("name").alias("graph_name"), F.col("type").alias("graph_type"), F.lit(date).alias("date"), F.col("num_nodes").cast("long").alias("num_nodes"), "sparsity", F.coalesce("close", F.lit(True)).alias("is_correct"), F.create_map(F.lit("main"), main).alias("metrics"))
        out = rows if out is None else out.unionByName(rows)
    return graphs.sparkSession.createDataFrame([], RESULTS) if out is None else out
