"""Cutting the lineage of iterative plans, in the folder that all executors share; and the package on workers."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all run in one process, as in tests, a temporary folder. On a
    cluster there must be one, as no other folder is known to be shared."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="edgeloom-")
        remove_at_exit(spark, own)
        context.setCheckpointDir(own)
        named = context.getCheckpointDir()
    return named.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables may be read for as long as the session lives; they go when its file systems close."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """The rows as a Parquet table: computed once, its size known to the planner, and safe from lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Once a session: the package goes through the shared folder to the Python workers, so that they need neither
    an installation nor the driver's folders."""
    context = spark.sparkContext
    if context.applicationId in _shipped or not PACKAGE.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, str(file.relative_to(PACKAGE.parent)))
    path = new_folder(spark, PACKAGE.name) + ".zip"
    remove_at_exit(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history; survives the loss of executors."""
    return written(df, "cut")


def estimated_bytes(df: DataFrame) -> int:
    """What the planner expects of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
