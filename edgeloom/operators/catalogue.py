"""Filtering and enriching a catalogue of matrices, and choosing what is still to be fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sparsity

Range = tuple[float, float] | None


def within(column: str, bounds: Range) -> Column:
    """Both ends count; no bounds, no condition."""
    return F.col(column).between(*bounds) if bounds else F.lit(True)


def range_filter(df: DataFrame, **bounds: Range) -> DataFrame:
    """Rows that lie in all ranges, by column."""
    return df.where(reduce(Column.__and__, (within(c, b) for c, b in bounds.items()), F.lit(True)))


def contains_any(df: DataFrame, column: str, patterns: list[str] | str | None) -> DataFrame:
    """Rows whose string holds one of the patterns, by case; ``all`` is no condition, none matches nothing."""
    if patterns == "all":
        return df
    wanted = patterns.split(",") if isinstance(patterns, str) else patterns or []
    return df.where(reduce(Column.__or__, (F.col(column).contains(p) for p in wanted), F.lit(False)))


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without nulls in the columns."""
    return df.dropna(subset=list(columns))


def with_sparsity(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("sparsity", sparsity(F.col("nnz").cast("double"), F.col("rows").cast("double"), F.col("cols").cast("double")))


def latest_by_name(catalogue: DataFrame, order: str = "id") -> DataFrame:
    """One row a name: the last in the order."""
    rest = [c for c in catalogue.columns if c != "name"]
    last = catalogue.groupBy("name").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select("name", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*catalogue.columns)


def enrich(matrices: DataFrame, catalogue: DataFrame) -> DataFrame:
    """matrices (name, rows, cols, nnz) with group, kind and sparsity of the catalogue, by name; without an entry,
    the group is Unknown and the sparsity is computed. Rounded to six places."""
    meta = catalogue.select("name", F.col("group").alias("g"), F.col("kind").alias("q"), F.col("sparsity").alias("s"))
    own = sparsity(F.col("nnz").cast("double"), F.col("rows").cast("double"), F.col("cols").cast("double"))
    joined = matrices.join(meta, "name", "left")
    return joined.select("name", F.coalesce("g", F.lit("Unknown")).alias("group"), F.coalesce("q", F.lit("Unknown")).alias("kind"), "rows", "cols", "nnz", F.round(F.coalesce("s", own), 6).alias("sparsity"))


def to_fetch(wanted: DataFrame, existing: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` of those wanted that don't exist yet; the existing don't count towards the limit."""
    return wanted.join(existing.select(key), key, "left_anti").orderBy(key).limit(limit)
