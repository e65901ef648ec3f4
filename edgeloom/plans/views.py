"""Graphs over the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str, dealt: str | None = None) -> DataFrame:
    """Suppliers by parts, v the quantity in all lines. ``dealt``: the lines are shuffled once, by i or k, for what
    needs all cells of one together."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k"), "l_quantity")
    lines = lines.repartition(dealt) if dealt else lines
    return lines.groupBy("i", "k").agg(F.sum("l_quantity").cast("bigint").alias("v"))


def nation_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers by nations of customers, v the lines between."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("v"))


def part_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, both directions, v the pairs of lines."""
    lines = read(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", F.col("l_partkey").alias("i"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("k"))
    return a.join(b, "l_orderkey").filter("i <> k").groupBy("i", "k").agg(F.count(F.lit(1)).alias("v"))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as features (k, j, w)."""
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("j", "w"))


def as_features(a: DataFrame) -> DataFrame:
    """A cell table as the right side of a product."""
    return a.select(F.col("i").alias("k"), F.col("k").alias("j"), F.col("v").alias("w"))


def transposed_features(a: DataFrame) -> DataFrame:
    return a.select("k", F.col("i").alias("j"), F.col("v").alias("w"))
