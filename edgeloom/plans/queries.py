"""The query catalogue over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalogue, multiply, partition, results, runner, stats, structure, verify
from ..sources import generators, readers, selectors, sinks
from .lineage import cut, new_folder, ship, written
from .views import as_features, embedding_features, nation_nation, part_part, read, supplier_part, transposed_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SP = "sp AS (SELECT l_suppkey AS i, l_partkey AS k, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
NN = "nn AS (SELECT CAST(s_nationkey AS BIGINT) AS i, CAST(c_nationkey AS BIGINT) AS k, COUNT(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
PP = "pp AS (SELECT a.l_partkey AS i, b.l_partkey AS k, COUNT(*) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"
X = "x AS (SELECT vec_id AS k, unnest(range(len(embedding))) AS j, unnest(embedding) AS w FROM embeddings)"
DEG = "deg AS (SELECT i AS node, COUNT(*) AS degree FROM pp GROUP BY 1)"
AAT = f"WITH {SP} SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS val FROM sp a JOIN sp b ON a.k = b.k GROUP BY 1, 2"
NNNN = f"WITH {NN} SELECT a.i, b.k AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS val FROM nn a JOIN nn b ON a.k = b.i GROUP BY 1, 2"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _nodes(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("node")).distinct()


# Products


@query("spmm_embed", f"WITH {SP}, {X} SELECT i, j, ROUND(SUM(v * CAST(w AS DOUBLE)), 4) AS val FROM sp JOIN x ON sp.k = x.k GROUP BY i, j")
def spmm_embed(spark, d):
    return multiply.multiply(supplier_part(spark, d), embedding_features(spark, d)).select("i", F.col("j").cast("long").alias("j"), F.round("val", 4).alias("val"))


@query("spmm_wide", ORACLE_SQL["spmm_embed"])
def spmm_wide(spark, d):
    return multiply.multiply(supplier_part(spark, d), embedding_features(spark, d), "wide").select("i", F.col("j").cast("long").alias("j"), F.round("val", 4).alias("val"))


def _aat(strategy: str) -> Query:
    def run(spark, d):
        sp = supplier_part(spark, d, "k" if strategy == "blocked" else None)
        return multiply.multiply(sp, transposed_features(sp), strategy)

    return run


for _name, _strategy in (("spgemm_aat", "auto"), ("spmm_broadcast", "broadcast"), ("spmm_merge", "merge"), ("spmm_shuffle_hash", "shuffle_hash"), ("spmm_blocked", "blocked")):
    query(_name, AAT)(_aat(_strategy))


@query("spmm_salted", AAT)
def spmm_salted(spark, d):
    """With a limit that most keys are above, so that they are dealt over several tasks."""
    sp = supplier_part(spark, d)
    return multiply.salted(sp, transposed_features(sp), hot=50, salts=4)


@query("spgemm_square", NNNN)
def spgemm_square(spark, d):
    nn = nation_nation(spark, d)
    return multiply.multiply(nn, as_features(nn))


@query("dense_matmul", NNNN)
def dense_matmul(spark, d):
    nn = nation_nation(spark, d)
    return multiply.multiply(nn, as_features(nn), "dense")


@query("half_matmul", f"WITH {NN} SELECT a.i, b.k AS j, CAST(SUM(a.v * b.v) AS DOUBLE) AS val FROM (SELECT i, k, v % 1024 AS v FROM nn) a JOIN (SELECT i, k, v % 1024 AS v FROM nn) b ON a.k = b.i GROUP BY 1, 2")
def half_matmul(spark, d):
    """Whole numbers below 2048 are exact in half precision."""
    nn = nation_nation(spark, d).withColumn("v", F.col("v") % 1024)
    return multiply.multiply(nn, as_features(nn), "half")


@query("identity_spmm", f"WITH {PP} SELECT i, k AS j, v AS val FROM pp")
def identity_spmm(spark, d):
    return multiply.with_identity(part_part(spark, d))


@query("identity_join", f"WITH {NN} SELECT i, k AS j, CAST(v AS DOUBLE) AS val FROM nn")
def identity_join(spark, d):
    nn = nation_nation(spark, d)
    return multiply.multiply(nn, structure.identity(_nodes(nn, "k")))


@query(
    "dense_rectangular",
    """WITH c AS (SELECT l_suppkey AS i, CAST(c_nationkey AS BIGINT) AS k, COUNT(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT i, CAST(n_regionkey AS BIGINT) AS j, CAST(SUM(v * (1 + k % 3)) AS BIGINT) AS val FROM c JOIN nation ON n_nationkey = k GROUP BY 1, 2""",
)
def dense_rectangular(spark, d):
    """Suppliers by nations times nations by regions, with a check of the sizes."""
    cells = _supplier_customer_nation(spark, d).select("i", F.col("j").cast("long").alias("k"), F.col("val").alias("v"))
    nations = read(spark, d, "nation")
    x = nations.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("j"), (1 + F.col("n_nationkey") % 3).cast("long").alias("w"))
    return multiply.multiply(cells, x, "dense", a_cols=25, x_rows=nations.count())


@query("spmm_densified", f"WITH {NN}, c AS (SELECT a.i, b.k AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS val FROM nn a JOIN nn b ON a.k = b.i WHERE a.i % 4 <> 1 AND b.k % 5 <> 2 GROUP BY 1, 2) SELECT CAST(n.n_nationkey AS BIGINT) AS i, m.n_nationkey AS j, COALESCE(c.val, 0) AS val FROM nation n CROSS JOIN nation m LEFT JOIN c ON c.i = n.n_nationkey AND c.j = m.n_nationkey")
def spmm_densified(spark, d):
    """A sparse product in full, zeros where no product reaches."""
    nn = nation_nation(spark, d)
    product = multiply.multiply(nn.filter("i % 4 <> 1"), as_features(nn.filter("k % 5 <> 2")))
    return structure.densify(product, read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i")), 25)


NN2 = f"{NN}, s AS (SELECT LEAST(i, k) AS a, GREATEST(i, k) AS b, MAX(v) AS v FROM nn GROUP BY 1, 2), sym AS (SELECT a AS i, b AS k, v FROM s UNION ALL SELECT b, a, v FROM s WHERE a <> b)"


@query("bfs_clustered_spmm", f"WITH {NN2} SELECT a.i, b.k AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS val FROM sym a JOIN sym b ON a.k = b.i GROUP BY 1, 2")
def bfs_clustered_spmm(spark, d):
    """Clusters grown breadth first, the product made cluster by cluster, and merged."""
    nn = structure.symmetrise(nation_nation(spark, d))
    return multiply.bfs_clustered(nn, as_features(nn), 25, 120, 3, 0.4)


GRAPHS = "sp AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS graph_id, l_suppkey AS i, l_partkey AS k, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"


def _graphs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Three graphs of suppliers and parts, by the suppliers' nations, and each one's transpose as its features."""
    nations = read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 3).cast("string").alias("graph_id"))
    a = supplier_part(spark, d).join(nations, "i").select("graph_id", "i", "k", "v")
    return a, a.select("graph_id", "k", F.col("i").alias("j"), F.col("v").alias("w"))


@query("graph_products", f"WITH {GRAPHS} SELECT a.graph_id, a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS val FROM sp a JOIN sp b ON a.graph_id = b.graph_id AND a.k = b.k GROUP BY 1, 2, 3")
def graph_products(spark, d):
    """The products of many graphs in one job."""
    return multiply.multiply_graphs(*_graphs(spark, d), "merge")


@query(
    "method_runs",
    f"""WITH {GRAPHS}, n AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS g, COUNT(*) AS n FROM supplier GROUP BY 1), c AS (SELECT graph_id, COUNT(*) AS cells FROM (SELECT DISTINCT a.graph_id, a.i, b.i AS j FROM sp a JOIN sp b ON a.graph_id = b.graph_id AND a.k = b.k) GROUP BY 1)
    SELECT m AS method, g AS graph_idx, 'graph ' || g AS graph_name, 'matrix' AS graph_type, '2024-01-01' AS date, n AS num_nodes, TRUE AS is_correct, COALESCE(cells, 0)::DOUBLE AS cells FROM n CROSS JOIN (SELECT unnest(['auto', 'shuffle_hash', 'salted']) AS m) LEFT JOIN c ON c.graph_id = g""",
)
def method_runs(spark, d):
    """Several methods over many graphs: the rows that go to the results store."""
    a, x = _graphs(spark, d)
    graph = (F.col("s_nationkey") % 3).cast("string")
    info = read(spark, d, "supplier").groupBy(graph.alias("graph_id")).agg(F.count(F.lit(1)).alias("num_nodes"))
    info = info.select("graph_id", F.concat(F.lit("graph "), "graph_id").alias("name"), F.lit("matrix").alias("type"), "num_nodes", F.lit(None).cast("double").alias("sparsity"))
    rows = runner.run_methods(info, a, x, ["auto", "shuffle_hash", "salted"], "2024-01-01")
    return rows.select("method", "graph_idx", "graph_name", "graph_type", "date", "num_nodes", "is_correct", F.col("metrics")["main"]["cells"]["value"].alias("cells"))


@query("cluster_spmm_merge", AAT)
def cluster_spmm_merge(spark, d):
    sp = supplier_part(spark, d, "k")
    # A third of the suppliers has no cluster and goes to the residual one.
    nodes = _nodes(read(spark, d, "lineitem"), "l_suppkey")
    assigned = nodes.withColumn("cluster", F.when(F.col("node") % 3 != 0, structure.chunk(F.col("node"), 10)))
    return multiply.clustered(sp, transposed_features(sp), assigned)


@query("product_counts", f"WITH {SP} SELECT a.k, a.n * a.n AS products FROM (SELECT k, COUNT(*) AS n FROM sp GROUP BY k) a")
def product_counts(spark, d):
    sp = supplier_part(spark, d)
    return stats.product_counts(sp, transposed_features(sp))


@query("strategy_list", "SELECT unnest(['auto','blocked','broadcast','dense','half','merge','salted','shuffle_hash','wide']) AS method")
def strategy_list(spark, d):
    return multiply.strategies(spark)


# Structure


@query("degree", f"WITH {PP} SELECT p_partkey AS node, COUNT(pp.k) AS degree FROM part LEFT JOIN pp ON p_partkey = pp.i GROUP BY 1")
def degree(spark, d):
    return stats.degrees(part_part(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query("densify", f"WITH {NN} SELECT n.n_nationkey::BIGINT AS i, m.n_nationkey AS j, COALESCE(nn.v, 0) AS val FROM nation n CROSS JOIN nation m LEFT JOIN nn ON nn.i = n.n_nationkey AND nn.k = m.n_nationkey")
def densify(spark, d):
    cells = nation_nation(spark, d).select("i", F.col("k").alias("j"), F.col("v").alias("val"))
    return structure.densify(cells, read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i")), 25)


@query(
    "densify_suppliers",
    """WITH c AS (SELECT l_suppkey AS i, c_nationkey AS j, COUNT(*) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT s_suppkey AS i, n_nationkey AS j, COALESCE(c.val, 0) AS val FROM supplier CROSS JOIN nation LEFT JOIN c ON c.i = s_suppkey AND c.j = n_nationkey""",
)
def densify_suppliers(spark, d):
    return structure.densify(_supplier_customer_nation(spark, d), read(spark, d, "supplier").select(F.col("s_suppkey").alias("i")), 25)


def _supplier_customer_nation(spark, d) -> DataFrame:
    """(i, j, val): suppliers by nations of customers, val the lines between."""
    orders, customers = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("l_suppkey").alias("i"), F.col("c_nationkey").alias("j")).agg(F.count(F.lit(1)).alias("val"))


@query("relabel", "SELECT o_custkey AS node, ROW_NUMBER() OVER (ORDER BY o_custkey) - 1 AS idx FROM (SELECT DISTINCT o_custkey FROM orders)")
def relabel(spark, d):
    return structure.relabel(read(spark, d, "orders").select(F.col("o_custkey").alias("node")))


@query("symmetrise", f"WITH {SP}, s AS (SELECT LEAST(i, k) AS a, GREATEST(i, k) AS b, MAX(v) AS v FROM sp GROUP BY 1, 2) SELECT a AS i, b AS k, v FROM s UNION ALL SELECT b, a, v FROM s WHERE a <> b")
def symmetrise(spark, d):
    """Numbers of suppliers are also numbers of parts, so that some edges have a value in either direction."""
    return structure.symmetrise(supplier_part(spark, d))


@query(
    "symmetrise_last",
    "WITH s AS (SELECT LEAST(l_suppkey, l_partkey) AS a, GREATEST(l_suppkey, l_partkey) AS b, MAX_BY(l_quantity, l_orderkey * 1000 + l_linenumber * 100 + l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a AS i, b AS k, v FROM s UNION ALL SELECT b, a, v FROM s WHERE a <> b",
)
def symmetrise_last(spark, d):
    """Of the cells for an edge the last one counts."""
    lines = read(spark, d, "lineitem")
    place = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")
    return structure.symmetrise(lines.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"), place.alias("at")), "at")


@query("transpose", f"WITH {SP} SELECT k AS i, i AS k, v FROM sp")
def transpose(spark, d):
    return structure.transpose(supplier_part(spark, d))


@query("compact", f"WITH {SP} SELECT i, k, v FROM sp")
def compact(spark, d):
    lines = read(spark, d, "lineitem")
    cells = lines.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k"), F.col("l_quantity").cast("bigint").alias("v"))
    return structure.compact(cells)


@query("csr_rows", f"WITH {SP} SELECT i, COUNT(*) AS n, MIN(k) AS first_k, MAX(k) AS last_k, CAST(SUM(v) AS BIGINT) AS total FROM sp GROUP BY i")
def csr_rows(spark, d):
    rows = structure.to_rows(supplier_part(spark, d))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c.v)
    return rows.select("i", F.size("cells").cast("long").alias("n"), F.get("cells", F.lit(0)).k.alias("first_k"), F.element_at("cells", -1).k.alias("last_k"), total.alias("total"))


@query("csc_columns", f"WITH {SP} SELECT k, COUNT(*) AS n, MIN(i) AS first_i, MAX(i) AS last_i FROM sp GROUP BY k")
def csc_columns(spark, d):
    columns = structure.to_columns(supplier_part(spark, d))
    return columns.select("k", F.size("cells").cast("long").alias("n"), F.get("cells", F.lit(0)).i.alias("first_i"), F.element_at("cells", -1).i.alias("last_i"))


@query("csr_round_trip", f"WITH {SP} SELECT i, k, v FROM sp")
def csr_round_trip(spark, d):
    return structure.from_rows(structure.to_rows(supplier_part(spark, d)))


@query("wide_round_trip", f"WITH {X} SELECT k, CAST(j AS INTEGER) AS j, CAST(ROUND(CAST(w AS DOUBLE) * 10000) AS BIGINT) AS w FROM x")
def wide_round_trip(spark, d):
    x = embedding_features(spark, d)
    return structure.lengthen(structure.widen(x)).select("k", "j", F.round(F.col("w").cast("double") * 10000).cast("bigint").alias("w"))


@query("permute_roundtrip", NNNN)
def permute_roundtrip(spark, d):
    nn = nation_nation(spark, d)
    order = _nodes(nn.select("i").union(nn.select("k")), "i").select(F.col("node").alias("old"), F.xxhash64("node").alias("new"))
    moved = structure.permute(nn, order)
    return structure.permute(multiply.multiply(moved, as_features(moved)), structure.inverse(order), ("i", "j")).select("i", "j", "val")


@query("chunk_clusters", f"WITH {SP} SELECT CAST(FLOOR(k / 100) AS INTEGER) AS cluster, COUNT(DISTINCT k) AS size FROM sp GROUP BY 1")
def chunk_clusters(spark, d):
    nodes = _nodes(supplier_part(spark, d), "k")
    return partition.cluster_sizes(nodes.withColumn("cluster", structure.chunk(F.col("node"), 100)))


@query("row_slices", f"WITH {SP} SELECT CAST(FLOOR(i / 30) AS INTEGER) AS part, COUNT(*) AS n, CAST(SUM(v) AS BIGINT) AS total FROM sp GROUP BY 1")
def row_slices(spark, d):
    sliced = structure.row_slices(supplier_part(spark, d), 30, 100)
    return sliced.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# Statistics and work counts


@query(
    "graph_props",
    f"""WITH {PP}, {DEG} SELECT COUNT(*) AS nodes, CAST(SUM(degree) AS BIGINT) AS cells, MAX(degree) AS max_degree,
    ROUND(AVG(degree), 6) AS mean_degree, ROUND(STDDEV_POP(degree), 6) AS std_degree, ROUND(QUANTILE_CONT(degree, 0.5), 6) AS p50,
    ROUND(QUANTILE_CONT(degree, 0.9), 6) AS p90, ROUND(SUM(degree) / COUNT(*), 6) AS avg_degree,
    ROUND(SUM(degree) / (COUNT(*) * COUNT(*)), 8) AS density, ROUND(QUANTILE_CONT(degree, 0.9) / NULLIF(QUANTILE_CONT(degree, 0.5), 0), 6) AS degree_skew FROM deg""",
)
def graph_props(spark, d):
    props = stats.graph_properties(stats.degrees(part_part(spark, d)))
    return props.select("nodes", "cells", "max_degree", *[F.round(c, 8 if c == "density" else 6).alias(c) for c in ("mean_degree", "std_degree", "p50", "p90", "avg_degree", "density", "degree_skew")])


@query("matrix_stats", f"WITH {SP}, s AS (SELECT (SELECT COUNT(*) FROM supplier) AS rows, (SELECT COUNT(*) FROM part) AS cols) SELECT rows, cols, nnz, nonzero, ROUND(1 - nnz / (rows * cols)::DOUBLE, 8) AS sparsity FROM s CROSS JOIN (SELECT COUNT(*) AS nnz, COUNT(*) FILTER (v % 50 <> 0) AS nonzero FROM sp)")
def matrix_stats(spark, d):
    cells = supplier_part(spark, d).withColumn("v", F.col("v") % 50)
    return stats.matrix_stats(cells, read(spark, d, "supplier").count(), read(spark, d, "part").count()).withColumn("sparsity", F.round("sparsity", 8))


@query(
    "graph_sample",
    f"""WITH {PP}, {DEG}, s AS (SELECT degree FROM deg ORDER BY node * 7919 % 10007, node LIMIT 100) SELECT (SELECT COUNT(*) FROM deg) AS nodes, (SELECT MAX(degree) FROM deg) AS max_degree,
    ROUND(AVG(degree), 6) AS mean_degree, ROUND(STDDEV_POP(degree), 6) AS std_degree, ROUND(QUANTILE_CONT(degree, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(degree, 0.9), 6) AS p90 FROM s""",
)
def graph_sample(spark, d):
    """Statistics of a sample of nodes without replacement, in an order that SQL can repeat."""
    props = stats.graph_properties(stats.degrees(part_part(spark, d)), 100, order=F.col("node") * 7919 % 10007)
    return props.select("nodes", "max_degree", *[F.round(c, 6).alias(c) for c in ("mean_degree", "std_degree", "p50", "p90")])


@query("edge_density", f"WITH {PP}, {DEG} SELECT pp.i, pp.k, ROUND((a.degree + b.degree) / (2.0 * (SELECT COUNT(*) FROM part)), 8) AS weight FROM pp JOIN deg a ON a.node = pp.i JOIN deg b ON b.node = pp.k")
def edge_density(spark, d):
    return stats.edge_density(part_part(spark, d), read(spark, d, "part").count()).select("i", "k", F.round("weight", 8).alias("weight"))


@query(
    "merge_steps",
    f"""WITH {SP}, last AS (SELECT i, MAX(k) AS m FROM sp GROUP BY i),
    pairs AS (SELECT DISTINCT a.i, b.i AS j FROM sp a JOIN sp b ON a.k = b.k),
    keys AS (SELECT p.i, p.j, s.k FROM pairs p JOIN sp s ON s.i = p.i UNION SELECT p.i, p.j, s.k FROM pairs p JOIN sp s ON s.i = p.j)
    SELECT q.i, q.j, COUNT(*) AS steps FROM keys q JOIN last a ON a.i = q.i JOIN last b ON b.i = q.j WHERE q.k <= LEAST(a.m, b.m) GROUP BY 1, 2""",
)
def merge_steps(spark, d):
    sp = supplier_part(spark, d, "i")
    return stats.merge_steps(sp, transposed_features(sp))


@query(
    "node_workload",
    f"""WITH {NN}, o AS (SELECT i AS node, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS s FROM nn GROUP BY 1), c AS (SELECT k AS node, COUNT(*) AS n FROM nn GROUP BY 1)
    SELECT COALESCE(o.node, c.node) AS node, COALESCE(o.n, 0) AS output_edges, COALESCE(c.n, 0) AS input_edges, COALESCE(o.s, 0) AS sum_of_neighbours FROM o FULL JOIN c ON o.node = c.node""",
)
def node_workload(spark, d):
    work = stats.node_workload(nation_nation(spark, d))
    return work.select("node", "output_edges", "input_edges", F.aggregate("neighbours", F.lit(0).cast("long"), lambda s, k: s + k).alias("sum_of_neighbours"))


@query(
    "cluster_limits",
    """WITH g AS (SELECT p_partkey + 11 AS n, (p_partkey + 11) * 7 AS e, CAST(10 + p_size AS BIGINT) AS f, CAST(4000000 + 1000 * p_partkey AS BIGINT) AS free FROM part),
    r AS (SELECT *, 12 + 4 * f AS each, CAST(TRUNC((free * 0.8::DOUBLE - (4 * n + 12 * e)) / (12 + 4 * f)) AS BIGINT) AS room FROM g),
    m AS (SELECT *, LEAST(room, CAST(TRUNC(e * 0.2::DOUBLE) AS BIGINT)) AS most FROM r),
    c AS (SELECT *, GREATEST(e // most + 1, LEAST(LEAST(n // 10, 32), CAST(TRUNC(SQRT(e / most)) AS BIGINT))) AS num FROM m)
    SELECT n AS nodes, most AS max_edges_per_cluster, num AS num_clusters, most * each AS memory_per_cluster, 4 * n + 12 * e + num * most * each AS total_memory_needed FROM c""",
)
def cluster_limits(spark, d):
    parts = read(spark, d, "part")
    n = F.col("p_partkey") + 11
    limits = scalar.cluster_limits(n, n * 7, (F.col("p_size") + 10).cast("bigint"), F.lit(4_000_000).cast("bigint") + F.col("p_partkey") * 1000)
    return parts.select(n.alias("nodes"), *[c.alias(name) for name, c in limits.items()])


@query(
    "optimal_clusters",
    """WITH g AS (SELECT p_partkey AS id, 1 + p_size * 0.5::DOUBLE AS deg, (1 + p_size) / 100.0::DOUBLE AS density, CAST(1000000 * (1 + p_partkey) AS BIGINT) AS mem, CAST(8 AS BIGINT) AS units FROM part)
    SELECT id, CAST(TRUNC(LEAST(mem * 0.8::DOUBLE / 12 / 10, units * 8192 * deg, deg * SQRT(density * (units * 8192)))) AS BIGINT) AS target_edges_per_cluster,
    GREATEST(2, CAST(TRUNC(deg * density * units) AS BIGINT)) AS num_clusters, CAST(256 AS BIGINT) AS threads_per_block, units * 8192 AS max_concurrent_threads FROM g""",
)
def optimal_clusters(spark, d):
    parts = read(spark, d, "part")
    found = scalar.optimal_clusters(1 + F.col("p_size") * 0.5, (1 + F.col("p_size")) / F.lit(100.0), F.lit(1_000_000).cast("bigint") * (1 + F.col("p_partkey")), F.lit(8).cast("bigint"))
    return parts.select(F.col("p_partkey").alias("id"), *[c.alias(name) for name, c in found.items()])


@query("multiply_memory", "SELECT p_partkey AS id, (p_partkey * 3 + 500) * 8 + (p_partkey + 1 + 100 + 1) * 4 + p_partkey * 64 * 4 AS bytes FROM part")
def multiply_memory(spark, d):
    n = F.col("p_partkey")
    return read(spark, d, "part").select(n.alias("id"), scalar.multiply_memory(n * 3, n, F.lit(500).cast("bigint"), F.lit(100).cast("bigint"), F.lit(64).cast("bigint")).alias("bytes"))


# Partitioning


@query(
    "bfs_hop",
    f"""WITH {PP}, {DEG}, front AS (SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10),
    ranked AS (SELECT node, degree, COALESCE(SUM(degree) OVER (ORDER BY degree DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM front),
    expanded AS (SELECT node FROM ranked WHERE before < 1000),
    claimed AS (SELECT DISTINCT pp.k AS node FROM pp JOIN expanded e ON e.node = pp.i JOIN deg a ON a.node = pp.i JOIN deg b ON b.node = pp.k WHERE (a.degree + b.degree) / (2.0 * (SELECT COUNT(*) FROM part)) > 0.05 AND pp.k NOT IN (SELECT node FROM front))
    SELECT node, TRUE AS expanded FROM expanded UNION ALL SELECT node, FALSE FROM claimed""",
)
def bfs_hop(spark, d):
    pp = written(part_part(spark, d), "edges")
    degree = cut(stats.degrees(pp))
    frontier = degree.orderBy(F.desc("degree"), "node").limit(10).select("node")
    return partition.bfs_hop(stats.edge_density(pp, read(spark, d, "part").count(), degree), frontier, degree, 1000, 0.05)


@query("seed_node", f"WITH {PP}, {DEG} SELECT node FROM deg WHERE node % 3 <> 0 ORDER BY degree DESC, node LIMIT 1")
def seed_node(spark, d):
    """Where the next cluster starts if every third node is taken."""
    degree = cut(stats.degrees(part_part(spark, d)))
    return partition.next_seed(degree, degree.filter("node % 3 = 0").select("node"))


@query("bfs_clusters")
def bfs_clusters(spark, d):
    """Clusters of the graph of nations: a loop, so without SQL; the tests compare it with a plain search."""
    nn = structure.symmetrise(nation_nation(spark, d))
    return partition.clusters_of(nn, 25, 120, 3, 0.4)


@query("fiedler_vector")
def fiedler_vector(spark, d):
    """Of the graph of nations; an eigenvector, so without SQL."""
    return partition.fiedler(structure.symmetrise(nation_nation(spark, d))).select("node", F.round("f", 5).alias("f"))


@query(
    "semi_extract",
    f"""WITH {SP}, {X}, need AS (SELECT DISTINCT CAST(i // 50 AS INTEGER) AS cluster, k FROM sp UNION SELECT DISTINCT CAST(i // 50 AS INTEGER), i FROM sp)
    SELECT cluster, x.k, CAST(x.j AS INTEGER) AS j, CAST(ROUND(CAST(x.w AS DOUBLE) * 10000) AS BIGINT) AS w FROM need JOIN x ON x.k = need.k""",
)
def semi_extract(spark, d):
    sp = supplier_part(spark, d)
    members = _nodes(sp, "i").withColumn("cluster", structure.chunk(F.col("node"), 50))
    return partition.subfeatures(sp, embedding_features(spark, d), members).select("cluster", "k", "j", F.round(F.col("w").cast("double") * 10000).cast("bigint").alias("w"))


@query("submatrices", f"WITH {SP} SELECT CAST(i % 4 AS INTEGER) AS cluster, COUNT(*) AS cells, COUNT(DISTINCT k) AS columns, CAST(SUM(v) AS BIGINT) AS total FROM sp GROUP BY 1")
def submatrices(spark, d):
    sp = supplier_part(spark, d)
    members = _nodes(sp, "i").withColumn("cluster", (F.col("node") % 4).cast("int"))
    return partition.submatrices(sp, members).groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("k").alias("columns"), F.sum("v").alias("total"))


@query("covering_clusters", f"WITH {SP}, n AS (SELECT DISTINCT i AS node, CASE WHEN i % 7 = 0 THEN NULL WHEN i < 60 THEN i // 10 ELSE i END AS cluster FROM sp), s AS (SELECT cluster, COUNT(*) AS size FROM n GROUP BY 1) SELECT n.node, CAST(CASE WHEN s.size >= 2 THEN n.cluster ELSE -1 END AS INTEGER) AS cluster FROM n LEFT JOIN s ON n.cluster = s.cluster")
def covering_clusters(spark, d):
    node = F.col("node")
    cluster = F.when(node % 7 == 0, F.lit(None)).when(node < 60, F.floor(node / 10)).otherwise(node).cast("int")
    return partition.covering(_nodes(supplier_part(spark, d), "i").withColumn("cluster", cluster))


@query("spectral_split", "SELECT c_custkey AS node, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS part FROM customer")
def spectral_split(spark, d):
    scores = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("f"))
    return partition.split_by(scores, 4000.0).select("node", "part")


# Verification


@query(
    "verify_summary",
    f"""WITH {NN}, e AS (SELECT a.i, b.k AS j, CAST(SUM(a.v * b.v) AS DOUBLE) AS val FROM nn a JOIN nn b ON a.k = b.i GROUP BY 1, 2),
    d AS (SELECT val AS e, val * (1 + (i % 5) * 0.0004::DOUBLE) AS a FROM e)
    SELECT COUNT(*) AS cells, BOOL_AND(ABS(e - a) <= 0.0001::DOUBLE + 0.001::DOUBLE * ABS(a)) AS is_close, ROUND(MAX(ABS(e - a)), 4) AS max_abs_diff, ROUND(MAX(ABS((e - a) / (e + 1e-10))), 8) AS max_rel_diff,
    ROUND(MIN(e), 4) AS expected_min, ROUND(MAX(e), 4) AS expected_max, ROUND(AVG(e), 4) AS expected_mean, ROUND(MIN(a), 4) AS actual_min, ROUND(MAX(a), 4) AS actual_max, ROUND(AVG(a), 4) AS actual_mean,
    ROUND(QUANTILE_CONT(ABS(e - a), 0.25), 4) AS diff_p25, ROUND(QUANTILE_CONT(ABS(e - a), 0.5), 4) AS diff_p50, ROUND(QUANTILE_CONT(ABS(e - a), 0.75), 4) AS diff_p75, ROUND(QUANTILE_CONT(ABS(e - a), 0.99), 4) AS diff_p99 FROM d""",
)
def verify_summary(spark, d):
    nn = nation_nation(spark, d)
    expected = multiply.multiply(nn, as_features(nn)).withColumn("val", F.col("val").cast("double"))
    actual = expected.withColumn("val", F.col("val") * (1 + (F.col("i") % 5) * 0.0004))
    out = verify.summary(expected, actual)
    return out.select("cells", "is_close", *[F.round(c, 8 if c == "max_rel_diff" else 4).alias(c) for c in out.columns[2:]])


# Results, roll-ups, reports

_OLD = "old AS (SELECT user_id, event_type, MAX_BY(event_id, event_id) AS event_id, MAX_BY(value, event_id) AS value, MAX_BY(props, event_id) AS metrics FROM events WHERE value < 60 GROUP BY 1, 2)"
_NEW = "new AS (SELECT user_id, event_type, MAX_BY(event_id, event_id) AS event_id, MAX_BY(value, event_id) AS value, NULL AS metrics FROM events WHERE value >= 30 GROUP BY 1, 2)"
_KEYS = ["user_id", "event_type"]


def _stores(spark, d) -> tuple[DataFrame, DataFrame]:
    events = read(spark, d, "events").select(*_KEYS, "event_id", "value", F.col("props").alias("metrics"))
    old = results.latest(events.filter("value < 60"), _KEYS, "event_id")
    new = results.latest(events.filter("value >= 30"), _KEYS, "event_id").withColumn("metrics", F.lit(None).cast("string"))
    return old, new


@query("results_upsert", f"WITH {_OLD}, {_NEW} SELECT user_id, event_type, event_id, ROUND(value, 4) AS value FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.event_type = old.event_type) UNION ALL SELECT user_id, event_type, event_id, ROUND(value, 4) FROM new")
def results_upsert(spark, d):
    return results.upsert(*_stores(spark, d), _KEYS).select(*_KEYS, "event_id", F.round("value", 4).alias("value"))


@query(
    "results_upsert_keep_metrics",
    f"""WITH {_OLD}, {_NEW} SELECT COALESCE(n.user_id, o.user_id) AS user_id, COALESCE(n.event_type, o.event_type) AS event_type, CASE WHEN n.user_id IS NOT NULL THEN n.event_id ELSE o.event_id END AS event_id,
    ROUND(CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END, 4) AS value, COALESCE(o.metrics, n.metrics) AS metrics FROM new n FULL JOIN old o ON n.user_id = o.user_id AND n.event_type = o.event_type""",
)
def results_upsert_keep_metrics(spark, d):
    kept = results.upsert_keeping(*_stores(spark, d), _KEYS, "metrics")
    return kept.select(*_KEYS, "event_id", F.round("value", 4).alias("value"), "metrics")


_CLASS = "CASE event_type WHEN 'click' THEN 'sum' WHEN 'purchase' THEN 'sum' WHEN 'view' THEN 'avg' WHEN 'error' THEN 'max' ELSE 'first' END"
_ROLLED = f"""rolled AS (SELECT user_id, event_type AS metric, CASE {_CLASS} WHEN 'sum' THEN SUM(value) WHEN 'avg' THEN AVG(value) WHEN 'max' THEN MAX(value) ELSE MIN_BY(value, event_id) END AS value,
    CASE WHEN {_CLASS} = 'first' THEN MIN_BY(props, event_id) END AS value_str FROM events GROUP BY 1, 2)"""


def _rolled(spark, d) -> DataFrame:
    samples = read(spark, d, "events").select("user_id", F.col("event_type").alias("metric"), F.col("event_id").alias("action_id"), "value", F.col("props").alias("value_str"), F.lit("ms").alias("unit"))
    classes = [("click", "sum"), ("purchase", "sum"), ("view", "avg"), ("error", "max"), ("signup", "first")]
    dimension = spark.createDataFrame([(m, m, c) for m, c in classes], "metric string, display_name string, class string")
    return results.rollup(samples, dimension, ["user_id"])


@query("metric_rollup", f"WITH {_ROLLED} SELECT user_id, metric, ROUND(value + 1e-9, 4) AS value, value_str FROM rolled")
def metric_rollup(spark, d):
    return _rolled(spark, d).select("user_id", "metric", F.round(F.col("value") + 1e-9, 4).alias("value"), "value_str")


_RATIOS = """WITH l AS (SELECT l_suppkey AS s, CAST(SUM(l_quantity) AS BIGINT) AS q, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS h FROM lineitem GROUP BY 1)
    SELECT CAST(s AS VARCHAR) AS graph_idx, m.metric, ROUND(CASE m.metric WHEN 'time_duration' THEN q / 1e9 WHEN 'dram_bytes' THEN n WHEN 'dram_throughput' THEN n / (q / 1e9) WHEN 'active_cycles_ratio' THEN h / q::DOUBLE * 100 ELSE h / (h + n)::DOUBLE * 100 END, 6) AS value,
    CASE m.metric WHEN 'time_duration' THEN 's' WHEN 'dram_bytes' THEN 'byte' WHEN 'dram_throughput' THEN 'B/s' ELSE '%' END AS unit FROM l CROSS JOIN (SELECT unnest(['time_duration', 'dram_bytes', 'dram_throughput', 'active_cycles_ratio', 'l1tex_hit_rate']) AS metric) m"""


@query("profiler_metrics", _RATIOS)
def profiler_metrics(spark, d):
    """Samples named as a profiler does, rolled up with the real dimension table, and the three ratios made of them."""
    lines = read(spark, d, "lineitem").withColumn("action_id", F.monotonically_increasing_id())
    quantity, line, one = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(1.0)
    names = {"gpu__time_duration_measured_wallclock.avg": (quantity, "ns"), "dram__bytes.avg": (one, "byte"), "gpu__cycles_active.avg": (line, "cycle"), "gpu__cycles_elapsed.avg": (quantity, "cycle"), "l1tex__t_bytes_lookup_hit.avg": (line, "byte"), "l1tex__t_bytes_lookup_miss.avg": (one, "byte")}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(u).alias("unit")) for m, (v, u) in names.items()]))
    samples = lines.select(F.col("l_suppkey").cast("string").alias("graph_idx"), F.lit("main").alias("range"), "action_id", each.alias("m")).select("graph_idx", "range", "action_id", "m.*", F.lit(None).cast("string").alias("value_str"))
    rolled = results.derived(results.rollup(samples, results.metric_dimension(spark), ["graph_idx", "range"]), ["graph_idx", "range"])
    shown = rolled.filter(F.col("metric").isin("time_duration", "dram_bytes", "dram_throughput", "active_cycles_ratio", "l1tex_hit_rate"))
    return shown.select("graph_idx", "metric", F.round("value", 6).alias("value"), "unit")


@query("profiler_report", "SELECT event_type AS method, CAST(user_id AS VARCHAR) AS graph_idx, 'main' AS range, m.metric, CAST(event_id AS INTEGER) AS action_id, ROUND(CASE m.metric WHEN 'value' THEN value ELSE event_id END, 4) AS value, m.unit FROM events CROSS JOIN (SELECT unnest(['value', 'id']) AS metric, unnest(['ms', 'none']) AS unit) m")
def profiler_report(spark, d):
    """Nested reports of actions, their ranges and metrics, as one row for each sample."""
    sample = lambda v, u: F.struct(v.cast("double").alias("value"), F.lit(None).cast("string").alias("value_str"), F.lit(u).alias("unit"))
    metrics = F.create_map(F.lit("value"), sample(F.col("value"), "ms"), F.lit("id"), sample(F.col("event_id"), "none"))
    action = F.struct(F.col("event_id").cast("int").alias("action_id"), F.array(F.concat(F.lit(" main  "), F.col("user_id").cast("string"))).alias("ranges"), metrics.alias("metrics"))
    reports = read(spark, d, "events").groupBy(F.col("event_type").alias("method"), "user_id").agg(F.collect_list(action).alias("actions"))
    return results.samples_of(reports).select("method", "graph_idx", "range", "metric", "action_id", F.round("value", 4).alias("value"), "unit")


@query("pivot_time", "SELECT user_id, " + ", ".join(f"ROUND(MIN_BY(value, event_id) FILTER (event_type = '{t}'), 4) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def pivot_time(spark, d):
    types = ["click", "error", "purchase", "signup", "view"]
    flat = results.pivot_first(read(spark, d, "events"), "user_id", "event_type", "value", "event_id", types)
    return flat.select("user_id", *[F.round(t, 4).alias(t) for t in types])


@query("method_grid", "SELECT g.user_id, t.event_type, COUNT(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) g CROSS JOIN (SELECT unnest(['click', 'error', 'view']) AS event_type) t LEFT JOIN events e ON e.user_id = g.user_id AND e.event_type = t.event_type GROUP BY 1, 2")
def method_grid(spark, d):
    events = read(spark, d, "events")
    counted = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    cells = results.grid(events, ["click", "error", "view"], "user_id", "event_type").join(counted, _KEYS, "left")
    return cells.select(*_KEYS, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("running_series", "SELECT p_brand, p_type, p_partkey, ROW_NUMBER() OVER w - 1 AS position, COUNT(*) OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey ROWS UNBOUNDED PRECEDING) AS so_far FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey)")
def running_series(spark, d):
    done = results.series(read(spark, d, "part"), ["p_brand", "p_type"], ["p_size", "p_partkey"])
    return done.select("p_brand", "p_type", "p_partkey", F.col("position").cast("long").alias("position"), "so_far")


@query(
    "size_method_series",
    """WITH r AS (SELECT CAST(p_size AS BIGINT) AS num_nodes, p_brand AS method, CAST(p_partkey AS VARCHAR) AS g, COALESCE(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 7 / 8.0::DOUBLE END, 0) AS sparsity, ROUND(p_retailprice, 2) AS time_seconds, COALESCE(CASE WHEN p_partkey % 2 = 0 THEN 0.5::DOUBLE END, 0) AS time_std FROM part)
    SELECT num_nodes, method, CAST(ROW_NUMBER() OVER (PARTITION BY num_nodes, method ORDER BY sparsity, g) - 1 AS INTEGER) AS position, sparsity, time_seconds, time_std FROM r""",
)
def size_method_series(spark, d):
    """Parts as results: sizes as nodes, brands as methods; some have neither sparsity nor spread."""
    key = F.col("p_partkey")
    rows = read(spark, d, "part").select(F.col("p_size").cast("long").alias("num_nodes"), F.col("p_brand").alias("method"), key.cast("string").alias("graph_index"), F.when(key % 3 != 0, key % 7 / F.lit(8.0)).alias("sparsity"), F.round("p_retailprice", 2).alias("time_seconds"), F.when(key % 2 == 0, 0.5).alias("time_std"))
    return results.size_method_series(rows)


@query("max_annotation", "SELECT user_id, ROUND(MAX(value) * 1.05::DOUBLE, 4) AS height FROM events WHERE value IS NOT NULL GROUP BY 1")
def max_annotation(spark, d):
    return results.annotation_height(read(spark, d, "events"), "user_id").select("user_id", F.round("height", 4).alias("height"))


@query("method_bars", "SELECT o_custkey AS graph_index, " + ", ".join(f"ROUND(MIN_BY(o_totalprice, o_orderkey) FILTER (o_orderpriority = '{m}'), 2) AS \"{m}\"" for m in ("1-URGENT", "5-LOW")) + " FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def method_bars(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("graph_index"), F.col("o_orderstatus").alias("graph_type"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("date"))
    shown = results.bars(orders, "F", "value", ["1-URGENT", "5-LOW"])
    return shown.select("graph_index", *[F.round(F.col(f"`{m}`"), 2).alias(m) for m in ("1-URGENT", "5-LOW")])


@query("family_subset", "SELECT p_partkey AS graph_index, p_name AS graph_name FROM part WHERE CONTAINS(p_name, 'ring')")
def family_subset(spark, d):
    return results.family(read(spark, d, "part").select(F.col("p_partkey").alias("graph_index"), F.col("p_name").alias("graph_name")), "ring")


def _metric_table(spark, d) -> DataFrame:
    """Event types as methods over users as graphs, with one metric in one range."""
    events = read(spark, d, "events")
    return events.groupBy("event_type", "user_id").agg(F.sum("value").alias("value")).select(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("graph_idx"), F.lit("main").alias("range"), F.lit("total").alias("metric"), "value", F.lit("ms").alias("unit"))


@query("metric_extract", "SELECT CAST(user_id AS VARCHAR) AS graph_idx, event_type AS method, ROUND(SUM(value) + 1e-9, 4) AS value, 'ms' AS unit FROM events GROUP BY 1, 2")
def metric_extract(spark, d):
    return results.metric_of(_metric_table(spark, d), "total", "main").withColumn("value", F.round(F.col("value") + 1e-9, 4))


@query(
    "comparison_table",
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS g, event_type AS m, ROUND(SUM(value) + 1e-9, 4) AS v FROM events GROUP BY 1, 2),
    p AS (SELECT CAST(c_custkey AS VARCHAR) AS g, c_name, CAST(c_nationkey AS BIGINT) AS n, CASE WHEN c_acctbal > 0 THEN 0.5::DOUBLE END AS s FROM customer WHERE c_mktsegment = 'BUILDING'),
    shown AS (SELECT p.* FROM p WHERE s IS NOT NULL AND n IS NOT NULL AND g IN (SELECT g FROM t))
    SELECT shown.g AS graph_idx, shown.g || ' (n=' || n || ' p=0.5)' || chr(10) || c_name AS graph, k.m AS method, t.v AS value FROM shown CROSS JOIN (SELECT unnest(['click', 'view', 'none']) AS m) k LEFT JOIN t ON t.g = shown.g AND t.m = k.m""",
)
def comparison_table(spark, d):
    customers = read(spark, d, "customer")
    properties = customers.select(F.col("c_custkey").cast("string").alias("graph_idx"), F.col("c_name").alias("graph_name"), F.col("c_mktsegment").alias("graph_type"), F.col("c_nationkey").cast("long").alias("num_nodes"), F.when(F.col("c_acctbal") > 0, 0.5).alias("sparsity"))
    shown = results.comparison(_metric_table(spark, d), properties, "total", "main", "BUILDING", ["click", "view", "none"])
    return shown.withColumn("value", F.round(F.col("value") + 1e-9, 4))


@query("known_methods", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def known_methods(spark, d):
    methods = spark.createDataFrame([("click",), ("view",), ("none",)], "event_type string")
    return read(spark, d, "events").join(methods, "event_type", "left_semi").select("event_id")


@query("distinct_methods", "SELECT DISTINCT event_type AS method FROM events")
def distinct_methods(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("method")).distinct()


@query("latest_by_key", "SELECT user_id, MAX(event_id) AS event_id, MAX_BY(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_by_key(spark, d):
    return results.latest(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


# Catalogue and selectors


@query("range_filter", "SELECT p_partkey, p_size, ROUND(p_retailprice, 2) AS p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500")
def range_filter(spark, d):
    parts = read(spark, d, "part")
    return catalogue.range_filter(parts, p_size=(10, 20), p_retailprice=(900, 1500), p_brand=None).select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))


@query("metadata_left_join", "SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, COALESCE(d.source, 'Unknown') AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def metadata_left_join(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("source", F.lit("Unknown")).alias("source"))


@query("catalogue_enrich", "SELECT c.c_name AS name, COALESCE(n.n_name, 'Unknown') AS \"group\", COALESCE(n.n_name, 'Unknown') AS kind, c.c_custkey + 1 AS rows, c.c_custkey + 2 AS cols, c.c_custkey AS nnz, ROUND(COALESCE(CASE WHEN n.n_nationkey IS NOT NULL THEN 0.5::DOUBLE END, 1 - c.c_custkey / ((c.c_custkey + 1.0::DOUBLE) * (c.c_custkey + 2.0::DOUBLE))), 6) AS sparsity FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 0")
def catalogue_enrich(spark, d):
    customers, nations = read(spark, d, "customer"), read(spark, d, "nation")
    meta = customers.filter("c_acctbal > 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("group"), F.col("n_name").alias("kind"), F.lit(0.5).alias("sparsity"))
    matrices = customers.select(F.col("c_name").alias("name"), (F.col("c_custkey") + 1).alias("rows"), (F.col("c_custkey") + 2).alias("cols"), F.col("c_custkey").alias("nnz"))
    return catalogue.enrich(matrices, meta)


@query("with_sparsity", "SELECT p_partkey AS id, ROUND(1 - (p_partkey + 1.0::DOUBLE) / ((p_size + 1.0::DOUBLE) * 20000), 6) AS sparsity FROM part")
def with_sparsity(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("nnz"), (F.col("p_size") + 1).alias("rows"), F.lit(20000).alias("cols"))
    return catalogue.with_sparsity(parts).select("id", F.round("sparsity", 6).alias("sparsity"))


@query("anti_join_limit", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10")
def anti_join_limit(spark, d):
    return catalogue.to_fetch(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("not_null", "SELECT event_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def not_null(spark, d):
    return catalogue.known(read(spark, d, "events"), "value", "props").select("event_id")


@query("selector_contains", "SELECT p_partkey, p_name FROM part WHERE CONTAINS(p_name, 'bolt') OR CONTAINS(p_name, 'gizmo')")
def selector_contains(spark, d):
    return selectors.select_names(read(spark, d, "part"), "p_name", "bolt,gizmo").select("p_partkey", "p_name")


@query("selector_range", "SELECT p_partkey FROM part WHERE p_partkey BETWEEN 0 AND 20 OR p_partkey = 50 OR p_partkey BETWEEN 100 AND 110")
def selector_range(spark, d):
    return selectors.select_numbers(read(spark, d, "part"), "p_partkey", "0-20,50,100-110").select("p_partkey")


@query("selector_union", "SELECT CAST(p_partkey AS VARCHAR) AS graph_id, p_name AS name, 'synthetic' AS type FROM part WHERE p_partkey BETWEEN 3 AND 9 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'matrix' FROM supplier WHERE CONTAINS(s_name, '2') UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 'snap' FROM nation")
def selector_union(spark, d):
    table = lambda t, i, n, kind: read(spark, d, t).select(F.col(i).cast("string").alias("graph_id"), F.col(n).alias("name"), F.lit(kind).alias("type"))
    graphs = table("part", "p_partkey", "p_name", "synthetic").union(table("supplier", "s_suppkey", "s_name", "matrix")).union(table("nation", "n_nationkey", "n_name", "snap"))
    return selectors.select(graphs, "3-9", "2", "all")


@query("number_order", "SELECT user_id, ROW_NUMBER() OVER (ORDER BY TRY_CAST(CASE WHEN user_id % 5 = 0 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS BIGINT) NULLS LAST, CASE WHEN user_id % 5 = 0 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END) AS place FROM (SELECT DISTINCT user_id FROM events)")
def number_order(spark, d):
    users = read(spark, d, "events").select("user_id").distinct()
    key = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return users.withColumn("key", key).withColumn("place", F.row_number().over(Window.orderBy(*scalar.number_first(F.col("key")))).cast("long")).select("user_id", "place")


# Sources


@query("mtx_scan", f"WITH {SP} SELECT i, k, CAST(v AS DOUBLE) AS v FROM sp")
def mtx_scan(spark, d):
    """Written as Matrix-Market text to the shared folder, and read back."""
    path = new_folder(spark, "matrix")
    sinks.save_matrix_market(supplier_part(spark, d), 100_000, 10_000_000, path)
    return readers.matrix_market(spark, path, folder=True)[1].select("i", "k", "v")


@query("edge_list_scan", "WITH e AS (SELECT DISTINCT LEAST(o_orderkey % 500, o_custkey) AS a, GREATEST(o_orderkey % 500, o_custkey) AS b FROM orders) SELECT a AS i, b AS k, CAST(1 AS DOUBLE) AS v FROM e UNION ALL SELECT b, a, 1 FROM e WHERE a <> b")
def edge_list_scan(spark, d):
    path = new_folder(spark, "edges")
    orders = read(spark, d, "orders")
    orders.select(F.concat_ws("\t", (F.col("o_orderkey") % 500).cast("string"), F.col("o_custkey").cast("string"))).union(spark.createDataFrame([("# a comment",)], "c string")).write.text(path, compression="gzip")
    return readers.edge_list(spark, path).select("i", "k", F.col("v").cast("double").alias("v"))


@query("edge_csv_scan", ORACLE_SQL["edge_list_scan"])
def edge_csv_scan(spark, d):
    path = new_folder(spark, "edges")
    read(spark, d, "orders").select(F.concat_ws(",", (F.col("o_orderkey") % 500).cast("string"), F.col("o_custkey").cast("string"))).write.text(path, compression="gzip")
    return readers.edge_list(spark, path, ",").select("i", "k", F.col("v").cast("double").alias("v"))


@query("stored_graph_scan", f"WITH {SP} SELECT CAST(i % 3 AS VARCHAR) AS graph_id, i, k, CAST(v AS DOUBLE) AS v FROM sp WHERE i % 3 <> 1")
def stored_graph_scan(spark, d):
    path = new_folder(spark, "graphs")
    sinks.save_edges(supplier_part(spark, d).select((F.col("i") % 3).cast("string").alias("graph_id"), "i", "k", F.col("v").cast("float").alias("v")), path)
    return readers.stored_graphs(spark, path, ["0", "2"]).select(F.col("graph_id").cast("string").alias("graph_id"), "i", "k", F.col("v").cast("double").alias("v"))


@query("mtx_symmetric_scan", f"WITH {NN2} SELECT i, k, CAST(v AS DOUBLE) AS v FROM sym")
def mtx_symmetric_scan(spark, d):
    """The lower triangle of a square matrix, read back as the whole."""
    path = new_folder(spark, "matrix")
    sinks.save_matrix_market(structure.symmetrise(nation_nation(spark, d)), 25, 25, path, symmetry="symmetric")
    return readers.square_matrix(spark, path, folder=True).select("i", "k", "v")


@query("mtx_array_scan", "SELECT CAST(ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, CAST(s_nationkey AS DOUBLE) AS v FROM supplier QUALIFY s_nationkey <> 0")
def mtx_array_scan(spark, d):
    """A full vector; its zeros are no cells."""
    path, suppliers = new_folder(spark, "matrix"), read(spark, d, "supplier")
    sinks.save_matrix_array(suppliers.select("s_suppkey", F.col("s_nationkey").alias("v")), suppliers.count(), 1, path, "s_suppkey")
    return readers.matrix_market(spark, path, folder=True)[1].select("i", "k", "v")


@query("matrix_adjacency", f"WITH {NN}, p AS (SELECT i, k, v FROM nn WHERE i <= k) SELECT i, k, CAST(v AS DOUBLE) AS v FROM p UNION ALL SELECT k, i, CAST(v AS DOUBLE) FROM p WHERE i <> k")
def matrix_adjacency(spark, d):
    """The undirected graph of a square matrix of which only the upper triangle is stored."""
    path = new_folder(spark, "matrix")
    sinks.save_matrix_market(nation_nation(spark, d).filter("i <= k"), 25, 25, path)
    return readers.matrix_graph(readers.square_matrix(spark, path, folder=True)).select("i", "k", "v")


@query(
    "load_dispatch",
    "WITH p AS (SELECT s_suppkey AS i, s_suppkey + 1 + s_nationkey AS k FROM supplier), u AS (SELECT i, k FROM p UNION ALL SELECT k, i FROM p) SELECT kind, i, k, CAST(1 AS DOUBLE) AS v FROM u CROSS JOIN (SELECT unnest(['csv', 'snap']) AS kind) UNION ALL SELECT 'synthetic', i, k, 1 FROM p",
)
def load_dispatch(spark, d):
    """The reader is chosen by the ending or by a part of the path."""
    root = new_folder(spark, "sources")
    pairs = read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") + 1 + F.col("s_nationkey")).alias("k"))
    pairs.select(F.concat_ws(",", "i", "k")).write.text(f"{root}/edges.csv")
    pairs.select(F.concat_ws(" ", "i", "k")).write.text(f"{root}/snap/edges")
    sinks.save_edges(pairs.select(F.lit("0").alias("graph_id"), "i", "k", F.lit(1.0).cast("float").alias("v")), f"{root}/synthetic/graphs")
    paths = {"csv": "edges.csv", "snap": "snap/edges", "synthetic": "synthetic/graphs"}
    csv, snap, stored = (readers.load(spark, f"{root}/{path}").select(F.lit(kind).alias("kind"), "i", "k", F.col("v").cast("double").alias("v")) for kind, path in paths.items())
    return csv.unionByName(snap).unionByName(stored)


@query("catalogue_scan", "SELECT 'region ' || n_regionkey AS name, MAX(n_nationkey) AS id, MAX_BY(n_name, n_nationkey) AS \"group\", CAST(MAX(n_nationkey) + 5 AS BIGINT) AS nnz FROM nation GROUP BY 1")
def catalogue_scan(spark, d):
    """A JSON array with several entries a name, of which the last counts."""
    path = new_folder(spark, "catalogue")
    entry = F.struct(F.col("n_nationkey").alias("id"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_name").alias("group"), F.lit(9).alias("rows"), F.lit(9).alias("cols"), (F.col("n_nationkey") + 5).alias("nnz"))
    read(spark, d, "nation").agg(F.to_json(F.collect_list(entry))).write.text(path)
    return readers.catalogue(spark, path, required=True).select("name", "id", "group", "nnz")


@query("nested_results_scan", "SELECT event_type AS method, CAST(user_id AS VARCHAR) AS graph_idx, COUNT(*) AS num_nodes, CASE WHEN user_id % 2 = 0 THEN user_id / 4.0::DOUBLE END AS sparsity, user_id % 3 <> 0 AS is_correct, CASE WHEN user_id % 5 <> 0 THEN COUNT(*)::DOUBLE END AS seconds FROM events GROUP BY event_type, user_id")
def nested_results_scan(spark, d):
    """The nested format, method to graph to record, written and read back."""
    path, user = new_folder(spark, "results"), F.col("user_id")
    counted = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    metric = F.create_map(F.lit("main"), F.create_map(F.lit("seconds"), F.struct(F.col("n").cast("double").alias("value"), F.lit("s").alias("unit"))))
    rows = counted.select(F.col("event_type").alias("method"), user.cast("string").alias("graph_idx"), F.lit("g").alias("graph_name"), F.lit("matrix").alias("graph_type"), F.lit("2024").alias("date"), F.col("n").alias("num_nodes"), F.when(user % 2 == 0, user / F.lit(4.0)).alias("sparsity"), (user % 3 != 0).alias("is_correct"), F.when(user % 5 != 0, metric).alias("metrics"))
    sinks.save_nested_results(rows, path)
    back = readers.nested_results(spark, path)
    return back.select("method", "graph_idx", "num_nodes", "sparsity", "is_correct", F.col("metrics")["main"]["seconds"]["value"].alias("seconds"))


@query("source_exists", "SELECT unnest(['part', 'region', 'no such table']) AS name, unnest([TRUE, TRUE, FALSE]) AS found")
def source_exists(spark, d):
    return spark.createDataFrame([(n, readers.exists(spark, f"{d}/{n}.parquet")) for n in ("part", "region", "no such table")], "name string, found boolean")


@query("half_features", "SELECT p_partkey AS k, j::INTEGER AS j, ((p_partkey * 73856093 + j * 19349663 + 42) % 1000003 % 2048) / 2048.0::DOUBLE AS w FROM part CROSS JOIN (SELECT unnest(range(10)) AS j)")
def half_features(spark, d):
    """Seeded features in half precision; multiples of 1 / 2048 below 1 stay as they are."""
    made = generators.random_features(read(spark, d, "part").select(F.col("p_partkey").alias("node")), portable=2048)
    return made.select("k", "j", scalar.to_half("w").alias("w"))


@query("er_graph", "WITH r AS (SELECT unnest(range(400)) AS n), p AS (SELECT a.n AS i, b.n AS k FROM r a JOIN r b ON a.n < b.n WHERE (a.n * 73856093 + b.n * 19349663 + 42) % 1000003 < 0.05::DOUBLE * 1000003) SELECT i, k, CAST(1 AS DOUBLE) AS v FROM p UNION ALL SELECT k, i, 1 FROM p")
def er_graph(spark, d):
    return generators.erdos_renyi(spark, 400, 0.05, portable=True).select("i", "k", F.col("v").cast("double").alias("v"))


@query("er_graph_sparse")
def er_graph_sparse(spark, d):
    ship(spark)
    return generators.erdos_renyi_sparse(spark, 5000, 0.001)


@query("ba_graph")
def ba_graph(spark, d):
    ship(spark)
    return generators.scale_free(generators.grid(spark, sizes=(1000, 2000)))


@query("ba_feature_spmm")
def ba_feature_spmm(spark, d):
    """Neighbourhood sums of random features over a scale-free graph."""
    ship(spark)
    edges = generators.scale_free(generators.grid(spark, sizes=(1000,))).drop("graph_id")
    return multiply.multiply(edges, generators.random_features(_nodes(edges, "i")))


@query("parameter_grid", "SELECT n AS num_nodes, p AS edge_prob, COUNT(*) AS graphs FROM (SELECT unnest([1000, 2000]) AS n) a CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.5::DOUBLE, NULL]) AS p) b CROSS JOIN (SELECT unnest(range(2))) c GROUP BY 1, 2")
def parameter_grid(spark, d):
    cases = generators.grid(spark, (1000, 2000), (0.01, 0.5), 2, erdos_renyi=True)
    return cases.groupBy(F.col("num_nodes").cast("int").alias("num_nodes"), "edge_prob").agg(F.count(F.lit(1)).alias("graphs"))


@query("matrix_label", "SELECT p_partkey AS id, p_partkey || '_p_' || printf('%.2f', p_size / 63.0::DOUBLE) || '_' || p_name AS label FROM part")
def matrix_label(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), scalar.matrix_label(F.col("p_partkey"), F.col("p_size") / F.lit(63.0), F.col("p_name")).alias("label"))

