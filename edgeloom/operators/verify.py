"""Comparing two results within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .stats import percentiles

RTOL, ATOL = 1e-3, 1e-4


def differences(expected: DataFrame, actual: DataFrame, rtol: float = RTOL, atol: float = ATOL, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Two results (keys, val) side by side, cells missing in one as 0: keys, e, a, diff, rel, close. The bound is
    relative to the actual value: |e - a| <= atol + rtol |a|; NaN is close to nothing."""
    left = expected.select(*keys, F.col("val").cast("double").alias("e"))
    right = actual.select(*keys, F.col("val").cast("double").alias("a"))
    both = left.join(right, list(keys), "full_outer").withColumns({"e": F.coalesce("e", F.lit(0.0)), "a": F.coalesce("a", F.lit(0.0))})
    diff = F.abs(F.col("e") - F.col("a"))
    sound = ~(F.isnan("e") | F.isnan("a"))
    return both.withColumns({"diff": diff, "rel": F.abs(F.try_divide(F.col("e") - F.col("a"), F.col("e") + 1e-10)), "close": sound & (diff <= atol + rtol * F.abs("a"))})


def summary(expected: DataFrame, actual: DataFrame, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """One row: cells, is_close, the largest differences, least, largest and mean of each side, quartiles and
    99th percentile of the differences. Of no cells at all, is_close is true."""
    d = cut(differences(expected, actual, rtol, atol))
    points = {"diff_p25": 0.25, "diff_p50": 0.5, "diff_p75": 0.75, "diff_p99": 0.99}
    whole = d.agg(
        F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.bool_and("close"), F.lit(True)).alias("is_close"),
        F.max("diff").alias("max_abs_diff"),
        F.max("rel").alias("max_rel_diff"),
        *[f(c).alias(f"{side}_{name}") for side, c in (("expected", "e"), ("actual", "a")) for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )
    one = F.lit(1).alias("__one")
    return whole.select("*", one).join(percentiles(d, "diff", points).select("*", one), "__one").drop("__one")
