"""Neighbourhood aggregation C = A X: an inner join on k and a grouped sum, by interchangeable strategies.

A is (i, k, v) and X (k, j, w), each with unique keys (``compact`` makes them so). The result is (i, j, val) without
the rows and columns that no product reaches; a cell whose products sum to zero stays. Sums are of long for whole
numbers and of double for others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, estimated_bytes
from ..schema import ShapeError, require_multipliable
from .partition import THRESHOLD, clusters_of
from .structure import relabel
from .tiles import products

BROADCAST_BYTES = 64 << 20
TILE = 2048
HOT_PRODUCTS = 1 << 22
SALTS = 32
WIDEST = 1024


def _whole(a: DataFrame, x: DataFrame) -> bool:
    return all(isinstance(t, T.IntegralType) for t in (a.schema["v"].dataType, x.schema["w"].dataType))


def _summed(joined: DataFrame, whole: bool) -> DataFrame:
    kind = "bigint" if whole else "double"
    return joined.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind) * F.col("w").cast(kind)).cast(kind).alias("val"))


def auto(a: DataFrame, x: DataFrame) -> DataFrame:
    """Join and partial and final aggregate; the planner and adaptive execution choose the join."""
    return _summed(a.join(x, "k"), _whole(a, x))


def broadcast(a: DataFrame, x: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Index look-up: X goes to every executor if the planner expects at most ``limit`` bytes of it; a
    shuffled hash join does the same otherwise."""
    return _summed(a.join(x.hint("broadcast" if estimated_bytes(x) <= limit else "shuffle_hash"), "k"), _whole(a, x))


def merge(a: DataFrame, x: DataFrame) -> DataFrame:
    """Two sorted sides, merged."""
    return _summed(a.hint("merge").join(x.hint("merge"), "k"), _whole(a, x))


def shuffle_hash(a: DataFrame, x: DataFrame) -> DataFrame:
    return _summed(a.join(x.hint("shuffle_hash"), "k"), _whole(a, x))


def salted(a: DataFrame, x: DataFrame, hot: int = HOT_PRODUCTS, salts: int = SALTS) -> DataFrame:
    """Keys that make more than ``hot`` products are dealt over ``salts`` tasks: A's cells by their row, X's copied.
    How many products a key makes comes from its two counts, before any is made."""
    many = a.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(x.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "k")
    ways = many.select("k", F.when(F.col("n") * F.col("m") > hot, F.lit(salts)).otherwise(F.lit(1)).alias("ways"))
    left = a.join(ways, "k").withColumn("salt", F.pmod(F.xxhash64("i"), F.col("ways")).cast("int"))
    right = x.join(ways, "k").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    return _summed(left.join(right, ["k", "salt"]), _whole(a, x))


def wide(a: DataFrame, x: DataFrame) -> DataFrame:
    """X as arrays with a place for each j: one row for each (i, k) pair through the join, and one sum for each
    place. For X of at most ``WIDEST`` places, as each is a column of the aggregate; it raises beyond."""
    whole = _whole(a, x)
    kind = "bigint" if whole else "double"
    width = (x.agg(F.max("j")).first()[0] or 0) + 1
    if width > WIDEST:
        raise ShapeError(f"{width} columns are too many for a sum each; there may be {WIDEST}")
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), F.col("w").cast(kind))))
    arrays = x.groupBy("k").agg(cells.alias("c")).select("k", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.try_element_at("c", j)).alias("x"))
    sums = [F.sum(F.col("v").cast(kind) * F.get("x", F.lit(j))).cast(kind).alias(f"s{j}") for j in range(width)]
    out = a.join(arrays, "k").groupBy("i").agg(*sums)
    return out.select("i", F.posexplode(F.array(*[f"s{j}" for j in range(width)])).alias("j", "val")).filter("val is not null")


def blocked(a: DataFrame, x: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of ``tile`` rows by ``tile`` columns of the result, each made in one task from the cells of A and X whose
    keys meet there, as small matrices where they are dense. Only cells are shuffled; a task holds the sums of one
    tile, whatever the size of the whole."""
    made = products(a, x, tile, _whole(a, x))
    return made.select(F.col("i").cast(a.schema["i"].dataType), "j", "val")


def dense(a: DataFrame, x: DataFrame, keys: int | None = None) -> DataFrame:
    """Rows and columns as full arrays over 0..keys-1, and a dot product for each pair that has a key in common."""
    whole = _whole(a, x)
    kind = "bigint" if whole else "double"
    n = keys or (max(a.agg(F.max("k")).first()[0] or 0, x.agg(F.max("k")).first()[0] or 0) + 1)
    zero = F.lit(0).cast(kind)

    def full(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
        cells = F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("long"), F.col(value).cast(kind))))
        places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
        return df.groupBy(by).agg(cells.alias("cells")).select(by, F.transform(places, lambda k: F.coalesce(F.try_element_at(F.col("cells"), k), zero)).alias(name))

    pairs = a.select("i", "k").join(x.select("k", "j"), "k").select("i", "j").distinct()
    both = pairs.join(full(a, "i", "v", "row"), "i").join(full(x, "j", "w", "col"), "j")
    dot = F.aggregate(F.zip_with("row", "col", lambda p, q: p * q), zero, lambda s, p: s + p)
    return both.select("i", "j", dot.alias("val"))


def half(a: DataFrame, x: DataFrame) -> DataFrame:
    """Inputs rounded to half precision, sums in double."""
    from ..functions.scalar import to_half

    return auto(a.withColumn("v", to_half("v")), x.withColumn("w", to_half("w")))


def with_identity(a: DataFrame) -> DataFrame:
    """A I = A without a join."""
    return a.select("i", F.col("k").alias("j"), F.col("v").alias("val"))


def clustered(a: DataFrame, x: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each cluster's rows times X, merged: sums within a cluster, the mean over clusters that have a cell. Nodes
    without a cluster are a cluster of their own, so all rows of A are in the result. A tile of the result is made in
    one task, in a layer for a row's first cluster, one for its second and so on, and merged there."""
    whole = _whole(a, x)
    nth = F.dense_rank().over(Window.partitionBy("i").orderBy("cluster")) - 1
    named = assignments.select(F.col("node").alias("i"), F.coalesce("cluster", F.lit(-1)).alias("cluster")).filter("i is not null")
    named = cut(named.select("i", nth.alias("layer")))
    rows = a.join(named.hint("broadcast") if estimated_bytes(named) <= BROADCAST_BYTES else named, "i", "left")
    layers = (named.agg(F.max("layer")).first()[0] or 0) + 1
    made = products(rows, x, TILE, whole, F.coalesce("layer", F.lit(0)), layers)
    mean = F.expr("val div layers" if whole else "val / layers")
    return made.select(F.col("i").cast(a.schema["i"].dataType), F.col("j").cast(x.schema["j"].dataType), F.when(F.col("layers") > 0, mean).alias("val"))


Strategy = Callable[[DataFrame, DataFrame], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


for _name, _strategy in (("auto", auto), ("broadcast", broadcast), ("merge", merge), ("shuffle_hash", shuffle_hash), ("salted", salted), ("wide", wide), ("blocked", blocked), ("dense", dense), ("half", half)):
    register_strategy(_name, _strategy)


def bfs_clustered(a: DataFrame, x: DataFrame, nodes: int, budget: int, clusters: int, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters of a symmetric graph are grown breadth first, and the product is made cluster by cluster and merged;
    equal to the direct product, as nodes that no cluster reaches have one of their own."""
    return clustered(a, x, clusters_of(a, nodes, budget, clusters, threshold))


def multiply_graphs(a: DataFrame, x: DataFrame, strategy: str = "auto") -> DataFrame:
    """Many products at once: a (graph_id, i, k, v), x (graph_id, k, j, w) -> (graph_id, i, j, val). Each graph's
    rows and keys get a range of numbers of their own, so that any strategy makes all products in one job."""
    numbers = cut(relabel(a.select("graph_id"), "graph_id"))
    a, x = a.join(numbers, "graph_id"), x.join(numbers, "graph_id")
    span = F.lit(max(df.agg(F.max(F.greatest(*c)) if len(c) > 1 else F.max(c[0])).first()[0] or 0 for df, c in ((a, ("i", "k")), (x, ("k",)))) + 1)
    moved = lambda c: (F.col("idx") * span + F.col(c)).alias(c)
    made = multiply(a.select(moved("i"), moved("k"), "v"), x.select(moved("k"), "j", "w"), strategy)
    back = made.select(F.floor(F.col("i") / span).alias("idx"), F.pmod("i", span).alias("i"), "j", "val")
    return back.join(numbers, "idx").select("graph_id", "i", "j", "val")


def multiply(a: DataFrame, x: DataFrame, strategy: str = "auto", a_cols: int | None = None, x_rows: int | None = None) -> DataFrame:
    """By the strategy of that name. Raises if both sizes are given and differ."""
    if a_cols is not None and x_rows is not None:
        require_multipliable(a_cols, x_rows)
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](a, x)


def strategies(spark: SparkSession, like: str = "") -> DataFrame:
    """The registered strategies whose names hold ``like``, as a table."""
    return spark.createDataFrame([(n,) for n in sorted(STRATEGIES) if like in n], "method string")
