"""Readers: Matrix-Market files, edge lists, stored graphs, catalogues, results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalogue import latest_by_name
from ..operators.structure import symmetrise
from ..schema import CATALOGUE, EDGES, RESULTS_FLAT, require_square


def exists(spark: SparkSession, path: str) -> bool:
    """Of any file system that Spark reads; the path may be a glob."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _numbered_lines(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    """name (of the file without its ending, or of the folder), block and at (together the order of lines), value."""
    meta = F.col("_metadata")
    block = F.concat(meta.file_path, F.lit("#"), F.lpad(meta.file_block_start.cast("string"), 20, "0"))
    lines = spark.read.text(path).select("value", meta.file_name.alias("file"), block.alias("block"))
    name = F.lit(path.rstrip("/").rsplit("/", 1)[-1]) if folder else F.regexp_replace("file", r"(\.mtx|\.txt|\.csv)?(\.gz)?$", "")
    return lines.select(name.alias("name"), "block", F.monotonically_increasing_id().alias("at"), "value")


def matrix_market(spark: SparkSession, path: str, folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matrix-Market files, of which the path may name several, or one matrix in the files of a folder, in the
    order of their paths (``sinks.save_matrix_market``) -> headers (name, layout, field, symmetry, rows, cols,
    stored) and cells (name, i, k, v, line_block, line) from 0, symmetric ones with both triangles. Rows of coordinate
    files that hold no value (pattern) have 1. Arrays are read column by column; their zeros are no cells."""
    lines = _numbered_lines(spark, path, folder)
    place = F.struct("block", "at")
    first = lines.groupBy("name").agg(F.min_by("value", place).alias("banner"), F.min(F.when(~F.col("value").startswith("%") & (F.trim("value") != ""), F.struct("block", "at", "value"))).alias("size"))
    word = F.split(F.lower("banner"), r"\s+")
    number = F.split(F.trim("size.value"), r"\s+")
    headers = first.select("name", F.get(word, F.lit(2)).alias("layout"), F.get(word, F.lit(3)).alias("field"), F.get(word, F.lit(4)).alias("symmetry"), F.get(number, F.lit(0)).try_cast("long").alias("rows"), F.get(number, F.lit(1)).try_cast("long").alias("cols"), F.get(number, F.lit(2)).try_cast("long").alias("entries"), F.col("size.block").alias("b0"), F.col("size.at").alias("a0"))
    data = lines.join(headers, "name").filter(~F.col("value").startswith("%") & (F.trim("value") != "") & (F.struct("block", "at") > F.struct("b0", "a0")))
    part = F.split(F.trim("value"), r"\s+")
    coordinate = data.filter("layout = 'coordinate'").select("name", "symmetry", F.get(part, F.lit(0)).try_cast("long").alias("i"), F.get(part, F.lit(1)).try_cast("long").alias("k"), F.coalesce(F.get(part, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("v"), "block", "at")
    coordinate = coordinate.withColumns({"i": F.col("i") - 1, "k": F.col("k") - 1})
    # The position of an array's value: those before it in its block, and in the blocks before.
    array = data.filter("layout = 'array'")
    sizes = array.groupBy("name", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("name", "block").orderBy("at")) - 1
    placed = array.withColumn("p", within).join(sizes, ["name", "block"]).withColumn("p", F.col("p") + F.col("before"))
    full = placed.select("name", "symmetry", (F.col("p") % F.col("rows")).alias("i"), F.expr("p div rows").alias("k"), F.trim("value").try_cast("double").alias("v"), "block", "at").filter("v <> 0 and symmetry = 'general'")
    cells = coordinate.unionByName(full)
    sign = F.when(F.col("symmetry") == "skew-symmetric", -1.0).otherwise(1.0)
    back = cells.filter("symmetry <> 'general' and i <> k").select("name", "symmetry", F.col("k").alias("i"), F.col("i").alias("k"), (F.col("v") * sign).alias("v"), "block", "at")
    both = cells.unionByName(back).select("name", "i", "k", "v", F.col("block").alias("line_block"), F.col("at").alias("line"))
    return headers.select("name", "layout", "field", "symmetry", "rows", "cols", F.coalesce("entries", F.col("rows") * F.col("cols")).alias("stored")), both


def matrix_graph(cells: DataFrame) -> DataFrame:
    """The undirected graph of one square matrix: of two values for an edge, the later in the file."""
    return symmetrise(cells.withColumn("order", F.struct("line_block", "line")), "order")


def square_matrix(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """The cells of one square matrix; raises if it isn't square. Reads the header."""
    headers, cells = matrix_market(spark, path, folder)
    for h in headers.limit(2).collect():
        require_square(h["rows"], h["cols"])
    return cells


def edge_list(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Pairs of node numbers, a line each, ``#`` before comments -> undirected edges (i, k, v = 1), both directions.
    A compressed file is one task to read; its rows are dealt out again by the aggregation."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), separator)
    pairs = lines.select(F.trim(F.get(part, F.lit(0))).try_cast("long").alias("i"), F.trim(F.get(part, F.lit(1))).try_cast("long").alias("k"), F.lit(1.0).cast("float").alias("v"))
    return symmetrise(pairs.filter("i is not null and k is not null"))


def stored_graphs(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Edges written by ``sinks.save_edges``; the ids prune folders."""
    edges = spark.read.schema(EDGES).parquet(path)
    return edges if ids is None else edges.filter(F.col("graph_id").isin(ids))


def catalogue(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """A JSON array of matrices, the last of each name. A missing file is an empty table, unless required."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], CATALOGUE)
    return latest_by_name(spark.read.schema(CATALOGUE).json(path, multiLine=True))


def results(spark: SparkSession, path: str) -> DataFrame:
    """A flat results list, as a JSON array or a row a line; empty if there is none, and without broken records."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULTS_FLAT)
    return spark.read.schema(RESULTS_FLAT).option("mode", "DROPMALFORMED").json(path, multiLine=path.endswith(".json"))


def nested_results(spark: SparkSession, path: str) -> DataFrame:
    """The nested results format, method to graph to record, as rows (method, graph_idx, ...)."""
    record = "struct<graph_name:string,graph_type:string,date:string,num_nodes:bigint,sparsity:double,is_correct:boolean,metrics:map<string,map<string,struct<value:double,unit:string>>>>"
    text = spark.read.text(path, wholetext=True)
    tree = text.select(F.from_json("value", f"map<string,map<string,{record}>>").alias("tree"))
    return tree.select(F.explode("tree").alias("method", "graphs")).select("method", F.explode("graphs").alias("graph_idx", "r")).select("method", "graph_idx", "r.*")


READERS = {"mtx": lambda spark, path: matrix_market(spark, path)[1], "edges": edge_list, "csv": lambda spark, path: edge_list(spark, path, ","), "parquet": stored_graphs}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Cells of whatever the path's ending, or else a part of it, says."""
    for ending, kind in ((r"\.mtx(\.gz)?$", "mtx"), (r"\.csv(\.gz)?$", "csv"), (r"\.txt(\.gz)?$", "edges"), (r"\.parquet/?$", "parquet"), (r"(^|/)ssmatrices(/|$)", "mtx"), (r"(^|/)snap(/|$)", "edges"), (r"(^|/)synthetic(/|$)", "parquet")):
        if re.search(ending, path):
            return READERS[kind](spark, path)
    raise ValueError(f"nothing reads {path}")
