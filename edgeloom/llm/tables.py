"""Shared helpers: reading input tables, and written intermediate tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import new_folder, ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with as many more underscores before it as make it differ from all columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


class Workspace:
    """Parquet tables in the shared folder. They survive the loss of executors, are read with column
    pruning, and their size is known to the planner. ``drop`` removes those no longer needed, and the end of the
    session all others, as results read from them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = new_folder(spark, label)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Written, and read again; ``by`` names a column whose values get a folder each, so that a filter on it
        reads only those."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
