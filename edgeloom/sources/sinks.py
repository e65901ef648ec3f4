"""Writers of graphs, features, results and Matrix-Market text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns


def save_edges(edges: DataFrame, path: str) -> None:
    """Parquet, a folder for each graph; what was there is replaced."""
    require_columns(edges, "graph_id", "i", "k", "v").repartition("graph_id").write.mode("overwrite").partitionBy("graph_id").parquet(path)


def save_features(features: DataFrame, path: str) -> None:
    require_columns(features, "graph_id", "k").repartition("graph_id").write.mode("overwrite").partitionBy("graph_id").parquet(path)


def save_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or JSON with a record a line. To replace the table that the rows come from, write beside it first."""
    results.write.mode("overwrite").format(form).save(path)


def save_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.write.mode("overwrite").json(path)


def save_nested_results(results: DataFrame, path: str) -> None:
    """The nested results format, one JSON object of method to graph to record. As it is one value, one task writes
    it: for reports, not for large stores."""
    fields = [c for c in results.columns if c not in ("method", "graph_idx")]
    graphs = results.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("graph_idx", F.struct(*fields)))).alias("graphs"))
    tree = graphs.agg(F.map_from_entries(F.collect_list(F.struct("method", "graphs"))).alias("tree"))
    tree.select(F.to_json("tree", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def save_matrix_array(values: DataFrame, rows: int, cols: int, path: str, order: str) -> None:
    """Matrix-Market text of a full array whose values (v) are given column by column in the order of a column."""
    spark = values.sparkSession
    head = spark.createDataFrame([(f"%%MatrixMarket matrix array real general\n{rows} {cols}",)], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/part=0")
    values.orderBy(order).select(F.col("v").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/part=1")


def save_matrix_market(cells: DataFrame, rows: int, cols: int, path: str, field: str = "real", symmetry: str = "general") -> None:
    """Matrix-Market text of cells (i, k, v) from 0, as a folder whose first file has the header. Of a symmetric
    matrix the lower triangle is written."""
    cells = cells if symmetry == "general" else cells.filter("i >= k")
    count = cells.count()
    spark = cells.sparkSession
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {field} {symmetry}\n{rows} {cols} {count}",)], "value string").coalesce(1)
    body = cells.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("k") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    head.write.mode("overwrite").text(f"{path}/part=0")
    body.write.mode("overwrite").text(f"{path}/part=1")
