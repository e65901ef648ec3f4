"""Results stores with upsert, metric roll-ups with derived ratios, and the tables behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_parts, graph_label, number_first

# Profiler metrics, the name each gets in a report, and how samples of a range are put together.
METRICS = [
    ("device__attribute_display_name", "device_name", "first"),
    ("gpu__time_duration_measured_wallclock.avg", "time_duration", "sum"),
    ("gpu__cycles_active.avg", "cycles_active", "sum"),
    ("gpu__cycles_elapsed.avg", "cycles_elapsed", "sum"),
    ("dram__bytes.avg", "dram_bytes", "sum"),
    ("dram__bytes_read.avg", "dram_bytes_read", "sum"),
    ("dram__bytes_write.avg", "dram_bytes_write", "sum"),
    ("lts__t_bytes.avg", "lts_bytes", "sum"),
    ("l1tex__t_bytes.avg", "l1tex_bytes", "sum"),
    ("l1tex__t_bytes_lookup_hit.avg", "l1tex_bytes_lookup_hit", "sum"),
    ("l1tex__t_bytes_lookup_miss.avg", "l1tex_bytes_lookup_miss", "sum"),
    ("l1tex__data_bank_reads.avg", "l1tex_data_bank_reads", "sum"),
    ("l1tex__data_bank_writes.avg", "l1tex_data_bank_writes", "sum"),
    ("gpc__cycles_active.avg", "gpc_cycles_active", "sum"),
    ("idc__request_cycles_active.avg", "idc_request_cycles_active", "sum"),
    ("gr__ctas_launched.avg", "ctas_launched", "sum"),
    ("sm__maximum_warps_avg_per_active_cycle", "max_warps", "max"),
    ("fbpa__dram_sectors.avg", "dram_sectors", "avg"),
    ("lts__d_sectors.avg", "lts_sectors_accessed", "avg"),
    ("lts__d_sectors_fill_device.avg", "lts_sectors_filled", "avg"),
    ("sm__throughput.avg", "sm_throughput", "avg"),
    ("sm__memory_throughput_internal_activity.avg", "sm_memory_throughput", "avg"),
    ("gpu__dram_throughput.avg", "dram_throughput", "avg"),
    ("gpu__compute_memory_throughput.avg", "compute_memory_throughput", "avg"),
    ("lts__t_request_hit_rate.avg", "lts_request_hit_rate", "avg"),
    ("gpc__cycles_elapsed.avg.per_second", "gpc_cycles_elapsed", "avg"),
    ("idc__request_hit_rate.avg", "idc_request_hit_rate", "avg"),
    ("sm__warps_active.avg.per_cycle_active", "warps_active", "avg"),
]
NANOSECONDS = "time_duration"


def metric_dimension(spark) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric string, display_name string, class string")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: that with the highest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose keys have none."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """The same, but a new row takes the column ``kept`` of the old one where that has a value."""
    fields = [c for c in new.columns if c not in keys]
    n = new.select(*keys, F.struct(*fields).alias("n"))
    o = old.select(*keys, F.struct(*fields).alias("o"))
    both = n.join(o, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c == kept else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in fields]).select(*new.columns)


def samples_of(reports: DataFrame) -> DataFrame:
    """Nested reports (method, actions: array of action_id, ranges: array of string, metrics: map of metric to
    value, value_str, unit) to one row for each sample; a range is named by its range and its graph."""
    actions = reports.select("method", F.explode("actions").alias("a"))
    ranges = actions.select("method", "a.action_id", "a.metrics", F.explode("a.ranges").alias("section"))
    part, graph = first_parts(F.col("section"))
    return ranges.select("method", graph.alias("graph_idx"), part.alias("range"), "action_id", F.explode("metrics").alias("metric", "m")).select("method", "graph_idx", "range", "metric", "action_id", "m.value", "m.value_str", "m.unit")


def rollup(samples: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """samples (keys, metric, action_id, value, value_str, unit), dimension (metric, display_name, class) -> keys,
    metric (its display name), value, value_str (of the first action, for class first), unit (of the last)."""
    known = samples.join(dimension, "metric")
    grouped = known.groupBy(*keys, "display_name", "class").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.avg("value").alias("a"), F.min_by("value", "action_id").alias("f"), F.min_by("value_str", "action_id").alias("fs"), F.max_by("unit", "action_id").alias("unit"))
    value = F.when(F.col("class") == "sum", F.col("s")).when(F.col("class") == "max", F.col("m")).when(F.col("class") == "avg", F.col("a")).otherwise(F.col("f"))
    time = F.col("display_name") == NANOSECONDS
    seconds = time & F.col("unit").isin("ns", "nsecond")
    return grouped.select(*keys, F.col("display_name").alias("metric"), F.when(time, value / 1e9).otherwise(value).alias("value"), F.when(F.col("class") == "first", F.col("fs")).alias("value_str"), F.when(seconds, F.lit("s")).otherwise(F.col("unit")).alias("unit"))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def derived(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """The rolled-up metrics and three made of them; the throughput replaces the averaged one."""
    names = ["cycles_active", "cycles_elapsed", "dram_bytes", "time_duration", "l1tex_bytes_lookup_hit", "l1tex_bytes_lookup_miss"]
    flat = rolled.groupBy(*keys).pivot("metric", names).agg(F.max("value"))
    hit, miss = F.col(names[4]), F.col(names[5])
    made = [("active_cycles_ratio", ratio(F.col(names[0]), F.col(names[1])) * 100, "%"), ("dram_throughput", ratio(F.col(names[2]), F.col(names[3])), "B/s"), ("l1tex_hit_rate", ratio(hit, hit + miss) * 100, "%")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), F.lit(None).cast("string").alias("value_str"), F.lit(u).alias("unit")) for n, v, u in made]))
    new = flat.select(*keys, rows.alias("r")).select(*keys, "r.*")
    return rolled.filter(~F.col("metric").isin("dram_throughput")).unionByName(new)


def metric_of(rolled: DataFrame, metric: str, part: str) -> DataFrame:
    """(graph_idx, method, value, unit) of one metric in one range."""
    return rolled.where((F.col("metric") == metric) & (F.col("range") == part)).select("graph_idx", "method", "value", "unit")


def pivot_first(df: DataFrame, row: str, column: str, value: str, order: str, columns: list) -> DataFrame:
    """A row each, a column for each of ``columns`` with the value of the lowest ``order``, null where there is none."""
    one = df.groupBy(row, column).agg(F.min_by(value, order).alias("__v"))
    return one.groupBy(row).pivot(column, columns).agg(F.first("__v"))


def grid(rows: DataFrame, columns: list, row: str, column: str) -> DataFrame:
    """Each row with each of a few given columns."""
    return rows.select(row).distinct().select(row, F.explode(F.array(*[F.lit(c) for c in columns])).alias(column))


def comparison(rolled: DataFrame, properties: DataFrame, metric: str, part: str, graph_type: str, methods: list[str]) -> DataFrame:
    """Table of a chart of one metric: label, method, value for each graph of the type whose size and sparsity are
    known, and each method; in the order of graphs, numbers first. properties: graph_idx, graph_name,
    graph_type, num_nodes, sparsity."""
    graphs = properties.where(F.col("graph_type") == graph_type).dropna(subset=["num_nodes", "sparsity"])
    values = metric_of(rolled, metric, part)
    shown = graphs.join(values.select("graph_idx").distinct(), "graph_idx", "left_semi")
    cells = grid(shown, methods, "graph_idx", "method").join(shown, "graph_idx").join(values, ["graph_idx", "method"], "left")
    label = graph_label(F.col("graph_idx"), F.col("num_nodes"), F.col("sparsity"), F.col("graph_name"))
    return cells.orderBy(*number_first(F.col("graph_idx")), "method").select("graph_idx", label.alias("graph"), "method", "value")


def series(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Position in the group's order, and how many rows of the group there are up to it."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({"position": F.row_number().over(w) - 1, "so_far": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def annotation_height(df: DataFrame, by: str, value: str = "value", factor: float = 1.05) -> DataFrame:
    """Where a chart writes above its bars; nulls and NaN don't count."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg((F.max(value) * factor).alias("height"))


def size_method_series(results: DataFrame) -> DataFrame:
    """Points of a line chart with error bars: by size and method in the order of sparsity; missing spread and
    sparsity are 0."""
    filled = results.withColumns({"sparsity": F.coalesce("sparsity", F.lit(0.0)), "time_std": F.coalesce("time_std", F.lit(0.0))})
    return series(filled, ["num_nodes", "method"], ["sparsity", "graph_index"]).select("num_nodes", "method", "position", "sparsity", "time_seconds", "time_std")


def bars(results: DataFrame, graph_type: str | None, value: str, methods: list[str], like: str = "") -> DataFrame:
    """Table of a bar chart: graphs of a type (all if none) by methods whose names hold ``like``."""
    some = results if graph_type is None else results.where(F.col("graph_type") == graph_type)
    wanted = [m for m in methods if like in m]
    return pivot_first(some.where(F.col("method").isin(wanted)), "graph_index", "method", value, "date", wanted)


def family(results: DataFrame, name: str) -> DataFrame:
    """Graphs of a family, by what their names hold."""
    return results.where(F.col("graph_name").contains(name))
