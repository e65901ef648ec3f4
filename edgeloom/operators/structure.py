"""Structural operators on cell tables (i, k, v) and feature tables (k, j, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("k").alias("i"), F.col("i").alias("k"), "v")


def compact(a: DataFrame) -> DataFrame:
    """One cell for each place: the sum of all cells there."""
    return a.groupBy("i", "k").agg(F.sum("v").alias("v"))


def to_rows(a: DataFrame) -> DataFrame:
    """Row-compressed form: i, cells (array of k and v in the order of k). A row must fit a task."""
    return a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("cells"))


def to_columns(a: DataFrame) -> DataFrame:
    """Column-compressed form: k, cells (array of i and v)."""
    return a.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode("cells").alias("c")).select("i", "c.k", "c.v")


def symmetrise(a: DataFrame, order: str | None = None) -> DataFrame:
    """Both directions of each undirected edge, a loop once. Of cells for the same edge, in whatever direction,
    that with the highest ``order`` gives the value; without one, the largest value does."""
    pair = a.select(F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"), "v", *([order] if order else []))
    last = F.max_by("v", order) if order else F.max("v")
    one = pair.groupBy("a", "b").agg(last.alias("v"))
    back = one.filter("a <> b").select(F.col("b").alias("i"), F.col("a").alias("k"), "v")
    return one.select(F.col("a").alias("i"), F.col("b").alias("k"), "v").unionByName(back)


def densify(cells: DataFrame, nodes: DataFrame, width: int, value: str = "val") -> DataFrame:
    """cells (i, j, value) with zeros where there are none, for all of nodes (i) and 0 <= j < width."""
    grid = nodes.select("i").distinct().select("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    have = cells.select("i", F.col("j").cast("int").alias("j"), F.col(value).alias(value))
    zero = F.lit(0).cast(cells.schema[value].dataType)
    return grid.join(have, ["i", "j"], "left").select("i", "j", F.coalesce(value, zero).alias(value))


def widen(x: DataFrame) -> DataFrame:
    """Long features (k, j, w) to wide ones (k, x), in the order of j."""
    return x.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda c: c.w).alias("x"))


def lengthen(x: DataFrame) -> DataFrame:
    """Wide features (k, x) to long ones (k, j, w)."""
    return x.select("k", F.posexplode("x").alias("j", "w"))


def numbered(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with idx, places from 0 in the given order. Ranges are numbered each by itself and moved by the sizes of
    those before, so that no task sees all rows. The ranges are written first: both uses must see the same."""
    return sums_before(df, order, {"idx": F.lit(1).cast("long")}, parts)


def sums_before(df: DataFrame, order: tuple[str, ...], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with, for each name, the sum of its expression over the rows that come before in the given order, which
    must not have ties if the sums are to be the same each time. Ranges are summed each by itself and moved by
    those before, so that no task sees all rows. The ranges are written first: both uses must see the same."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*[F.sum(e).alias(f"__t_{c}") for c, e in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = totals.select("__part", *[none(F.col(f"__t_{c}"), before).alias(f"__o_{c}") for c in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"__w_{c}": none(e, within) for c, e in sums.items()}).join(offsets, "__part")
    return placed.select(*df.columns, *[(F.col(f"__w_{c}") + F.col(f"__o_{c}")).alias(c) for c in sums])


def relabel(nodes: DataFrame, node: str = "node", parts: int | None = None) -> DataFrame:
    """(node) -> (node, idx): places from 0 in the order of the node."""
    return numbered(nodes.select(node).distinct(), node, parts=parts)


def permute(a: DataFrame, order: DataFrame, columns: tuple[str, ...] = ("i", "k")) -> DataFrame:
    """Renames nodes by order (old, new) in the given columns."""
    for c in columns:
        step = order.select(F.col("old").alias(c), F.col("new").alias("__new"))
        a = a.join(step, c).drop(c).withColumnRenamed("__new", c)
    return a


def inverse(order: DataFrame) -> DataFrame:
    return order.select(F.col("new").alias("old"), F.col("old").alias("new"))


def chunk(node: Column, size: int) -> Column:
    """The number of the block of ``size`` nodes."""
    return F.floor(node / F.lit(size)).cast("int")


def row_slices(a: DataFrame, size: int, rows: int) -> DataFrame:
    """Cells with part, the number of their block of rows; one block if all rows fit. Features are never cut."""
    return a.withColumn("part", F.lit(0) if rows <= size else chunk(F.col("i"), size))


def identity(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Features of the identity matrix: (k, j, w)."""
    return nodes.select(F.col(node).alias("k"), F.col(node).alias("j"), F.lit(1.0).alias("w"))
