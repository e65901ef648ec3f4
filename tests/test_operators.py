"""Hand-checked matrices, algebraic properties, and comparison with plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom import schema
from edgeloom.functions import scalar
from edgeloom.operators import catalogue, multiply, partition, results, runner, stats, structure, tiles, verify
from edgeloom.plans.lineage import estimated_bytes

PATH = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]


def cells(spark, rows):
    return spark.createDataFrame(rows, "i long, k long, v double")


def feats(spark, x):
    return spark.createDataFrame([(k, j, float(w)) for k, row in enumerate(x) for j, w in enumerate(row)], "k long, j long, w double")


def table(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def noise(seed, n=30, m=25, cells_=160, whole=True):
    rng = random.Random(seed)
    places = {(rng.randrange(n), rng.randrange(m)) for _ in range(cells_)}
    return [(i, k, rng.randint(-5, 5) if whole else rng.uniform(-1, 1)) for i, k in sorted(places)]


def plain_product(a, x):
    out = {}
    for i, k, v in a:
        for k2, j, w in x:
            if k == k2:
                out[i, j] = out.get((i, j), 0) + v * w
    return out


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "merge", "shuffle_hash", "salted", "wide", "blocked", "dense", "half"])
def test_path_graph(spark, strategy):
    got = table(multiply.multiply(cells(spark, PATH), feats(spark, [[1, 2], [3, 4], [5, 6]]), strategy), "i", "j", "val")
    assert got == {(0, 0): 3, (0, 1): 4, (1, 0): 6, (1, 1): 8, (2, 0): 3, (2, 1): 4}


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "merge", "shuffle_hash", "salted", "wide", "blocked", "dense"])
@pytest.mark.parametrize("whole", [True, False])
def test_strategies_agree(spark, monkeypatch, strategy, whole):
    monkeypatch.setattr(multiply, "TILE", 7)
    a, x = noise(1, whole=whole), noise(2, 25, 12, whole=whole)
    kind = "long" if whole else "double"
    da = spark.createDataFrame(a, f"i long, k long, v {kind}")
    dx = spark.createDataFrame(x, f"k long, j long, w {kind}")
    if strategy == "salted":
        got = table(multiply.salted(da, dx, hot=10, salts=3), "i", "j", "val")
    elif strategy == "blocked":
        got = table(multiply.blocked(da, dx, tile=7), "i", "j", "val")
    else:
        got = table(multiply.multiply(da, dx, strategy), "i", "j", "val")
    want = plain_product(a, x)
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c]) for c in want)


def test_tiles_multiply_large_whole_numbers_exactly(spark):
    a = [(i, k, 2**31 + 7 * i + k) for i in range(3) for k in range(2)] + [(5, 9, -3)]
    x = [(k, j, (-1) ** k * (2**29 + 3 * k + j)) for k in range(2) for j in range(3)] + [(9, 1, 2**60)]
    da, dx = spark.createDataFrame(a, "i long, k long, v long"), spark.createDataFrame(x, "k long, j long, w long")
    assert table(multiply.blocked(da, dx, tile=4), "i", "j", "val") == plain_product(a, x)


def test_broadcast_is_checked(spark):
    a, x = cells(spark, PATH), feats(spark, [[1.0]] * 3)
    assert estimated_bytes(x) > 1
    plan = lambda limit: multiply.broadcast(a, x, limit)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 100) and "BroadcastHashJoin" not in plan(1)


def test_identity_and_self_loop(spark):
    a = cells(spark, [(0, 0, 2.0), (0, 1, 3.0), (1, 0, 3.0)])
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "i long")
    product = multiply.multiply(a, structure.identity(nodes, "i"))
    assert table(product, "i", "j", "val") == table(multiply.with_identity(a), "i", "j", "val") == {(0, 0): 2, (0, 1): 3, (1, 0): 3}
    full = table(structure.densify(product, nodes, 3), "i", "j", "val")
    assert len(full) == 9 and full[2, 0] == full[2, 1] == full[2, 2] == 0


def test_linear(spark):
    a, x, y = spark.createDataFrame(noise(3), "i long, k long, v long"), noise(4, 25, 6), noise(5, 25, 6)
    fx, fy = (spark.createDataFrame(v, "k long, j long, w long") for v in (x, y))
    both = fx.union(fy).groupBy("k", "j").agg(F.sum("w").alias("w"))
    left = table(multiply.multiply(a, both), "i", "j", "val")
    right = {}
    for part in (fx, fy):
        for c, v in table(multiply.multiply(a, part), "i", "j", "val").items():
            right[c] = right.get(c, 0) + v
    assert left == right


def test_registry(spark):
    multiply.register_strategy("mine", lambda a, x: multiply.auto(a, x))
    try:
        assert [r.method for r in multiply.strategies(spark, "mi").collect()] == ["mine"]
        assert multiply.multiply(cells(spark, PATH), feats(spark, [[1.0]] * 3), "mine").count() == 3
    finally:
        del multiply.STRATEGIES["mine"]
    with pytest.raises(ValueError):
        multiply.multiply(cells(spark, PATH), feats(spark, [[1.0]]), "none such")


def test_duplicates_and_csr(spark):
    a = structure.compact(cells(spark, [(0, 1, 1.0), (0, 1, 2.0)]))
    assert table(a, "i", "k", "v") == {(0, 1): 3}
    rows = noise(6)
    b = cells(spark, [(i, k, float(v)) for i, k, v in rows])
    assert table(structure.from_rows(structure.to_rows(b)), "i", "k", "v") == table(b, "i", "k", "v")
    for r in structure.to_columns(b).collect():
        assert [c.i for c in r.cells] == sorted(i for i, k, _ in rows if k == r.k)


def test_symmetrise_last_wins(spark):
    rows = [(0, 1, 5.0, 1), (1, 0, 7.0, 2), (2, 2, 4.0, 3), (0, 1, 6.0, 0)]
    df = spark.createDataFrame(rows, "i long, k long, v double, line long")
    assert table(structure.symmetrise(df, "line"), "i", "k", "v") == {(0, 1): 7, (1, 0): 7, (2, 2): 4}


def test_relabel_and_permute(spark):
    nodes = spark.createDataFrame([(x * 7 % 101,) for x in range(90)] + [(7,)], "node long")
    got = table(structure.relabel(nodes, parts=5), "node", "idx")
    assert [got[k,] for k in sorted(k for k, in got)] == list(range(90))
    a = cells(spark, [(i, k, float(v)) for i, k, v in noise(7)])
    order = spark.range(40).select(F.col("id").alias("old"), ((F.col("id") * 17 + 3) % 41).alias("new"))
    assert table(structure.permute(structure.permute(a, order), structure.inverse(order)), "i", "k", "v") == table(a, "i", "k", "v")


def test_chunks_and_slices(spark):
    sizes = spark.range(2500).groupBy(structure.chunk(F.col("id"), 1000).alias("c")).count().orderBy("c").collect()
    assert [r["count"] for r in sizes] == [1000, 1000, 500]
    a = cells(spark, PATH)
    assert {r.part for r in structure.row_slices(a, 5, 3).collect()} == {0}
    assert {(r.i, r.part) for r in structure.row_slices(a, 2, 3).collect()} == {(0, 0), (1, 0), (2, 1)}


def test_degree_skew_and_sample(spark):
    degree = spark.createDataFrame([(k, k) for k in range(1, 11)], "node long, degree long")
    p = stats.graph_properties(degree).first()
    assert (p.p90, p.p50) == (9.1, 5.5) and p.degree_skew == pytest.approx(1.6545454545)
    s = stats.graph_properties(degree, 4).first()
    assert s.nodes == 10 and s.max_degree == 10 and s.mean_degree == stats.graph_properties(degree, 4).first().mean_degree
    empty = stats.graph_properties(degree.limit(0)).first()
    assert empty.nodes == 0 and empty.avg_degree is None and empty.degree_skew is None


def two_pointers(a, x):
    p = q = steps = 0
    while p < len(a) and q < len(x):
        steps += 1
        p, q = p + (a[p] <= x[q]), q + (x[q] <= a[p])
    return steps


def test_merge_steps(spark):
    a, x = noise(8, 20, 30, 200), noise(9, 30, 20, 200)
    got = table(stats.merge_steps(cells(spark, [(i, k, 1.0) for i, k, _ in a]), spark.createDataFrame([(k, j, 1.0) for k, j, _ in x], "k long, j long, w double")), "i", "j", "steps")
    for (i, j), steps in got.items():
        assert steps == two_pointers(sorted(k for r, k, _ in a if r == i), sorted(k for k, c, _ in x if c == j))
    assert set(got) == set(plain_product(a, x))


def test_edge_density_of_a_path(spark):
    assert {r.weight for r in stats.edge_density(cells(spark, PATH), 3).collect()} == {0.5}


def test_workload_and_products(spark):
    w = {r.node: r for r in stats.node_workload(cells(spark, [(0, 1, 1.0), (0, 2, 1.0), (3, 0, 1.0)])).collect()}
    assert (w[0].output_edges, w[0].input_edges, w[0].neighbours) == (2, 1, [1, 2]) and (w[2].output_edges, w[2].input_edges, w[2].neighbours) == (0, 1, [])
    a, x = noise(10), noise(11, 25, 9)
    total = stats.product_counts(cells(spark, [(i, k, 1.0) for i, k, _ in a]), spark.createDataFrame([(k, j, 1.0) for k, j, _ in x], "k long, j long, w double")).agg(F.sum("products")).first()[0]
    assert total == sum(1 for _, k, _ in a for k2, _, _ in x if k == k2)


def test_close_is_asymmetric(spark):
    one = lambda v: spark.createDataFrame([(0, 0, v)], "i long, j long, val double")
    assert not verify.summary(one(1000.0), one(999.0002)).first().is_close
    assert verify.summary(one(999.0002), one(1000.0)).first().is_close
    assert not verify.summary(one(float("nan")), one(float("nan"))).first().is_close
    assert verify.summary(one(0.00005), one(1.0).limit(0)).first().is_close
    assert verify.summary(one(1.0).limit(0), one(1.0).limit(0)).first().is_close


def test_summary_against_numpy(spark):
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=200), rng.normal(size=200)
    make = lambda v: spark.createDataFrame([(k, 0, float(x)) for k, x in enumerate(v)], "i long, j long, val double")
    s, d = verify.summary(make(e), make(a)).first(), np.abs(e - a)
    assert [s.diff_p25, s.diff_p50, s.diff_p75, s.diff_p99] == pytest.approx(np.percentile(d, [25, 50, 75, 99]))
    assert s.max_rel_diff == pytest.approx(np.max(np.abs((e - a) / (e + 1e-10)))) and s.expected_mean == pytest.approx(e.mean())


def plain_bfs(adjacent, n, budget, clusters, threshold):
    degree = {v: len(x) for v, x in adjacent.items()}
    heavy = {v: [u for u in x if (degree[v] + degree[u]) / (2 * n) > threshold] for v, x in adjacent.items()}
    taken = {}
    for c in range(clusters):
        free = sorted((v for v in adjacent if v not in taken), key=lambda v: (-degree[v], v))
        if not free:
            break
        front, spent = free[:1], 0
        while front:
            taken.update({v: c for v in front})
            found = set()
            before = spent
            for v in sorted(front, key=lambda v: (-degree[v], v)):
                if before < budget:
                    spent += degree[v]
                    found |= {u for u in heavy[v] if u not in taken}
                before += degree[v]
            if spent >= budget:
                break
            front = sorted(found)
    return {v: taken.get(v) for v in adjacent}


@pytest.mark.parametrize("seed,budget,threshold", [(1, 30, 0.0), (2, 12, 0.06), (3, 1000, 0.5)])
def test_bfs_clusters(spark, seed, budget, threshold):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)}
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    df = cells(spark, [(a, b, 1.0) for a, x in adjacent.items() for b in x])
    got = {r.node: r.cluster for r in partition.grow_clusters(df, 40, budget, 3, threshold).collect()}
    assert got == plain_bfs(adjacent, 40, budget, 3, threshold)
    cover = partition.clusters_of(df, 40, budget, 3, threshold)
    assert {r.node for r in cover.collect()} == set(adjacent) and cover.filter("cluster is null").count() == 0
    sizes = {r.cluster: r["size"] for r in partition.cluster_sizes(cover).collect()}
    assert all(s >= 2 for c, s in sizes.items() if c >= 0)
    x = feats(spark, np.arange(80).reshape(40, 2))
    assert table(multiply.clustered(df, x, cover), "i", "j", "val") == table(multiply.multiply(df, x), "i", "j", "val")
    assert partition.submatrices(df, cover).count() == df.count()


def test_path_isnt_crossed_at_half(spark):
    got = {r.node: r.cluster for r in partition.grow_clusters(cells(spark, PATH), 3, 100, 1).collect()}
    assert got == {0: None, 1: 0, 2: None}


def test_fiedler(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(base, base + 12), 2))) for base in (0, 12) for _ in range(40)} | {(3, 15)}
    df = cells(spark, [(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges])
    got = {r.node: r.f for r in partition.fiedler(df).collect()}
    ids = sorted(got)
    m = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        m[ids.index(a), ids.index(b)] = m[ids.index(b), ids.index(a)] = 1
    d = m.sum(axis=1)
    want = np.linalg.eigh(np.eye(len(ids)) - m / np.sqrt(np.outer(d, d)))[1][:, 1]
    assert abs(want @ [got[v] for v in ids]) > 0.999
    split = {r.node: r.part for r in partition.split_by(spark.createDataFrame(list(got.items()), "node long, f double"), 0.0).collect()}
    assert len({split[v] for v in ids if v < 12}) == 1 and split[0] != split[20]
    assert partition.fiedler(df.limit(0)) is None
    with pytest.raises(ArithmeticError):
        partition.fiedler(df, steps=2, restarts=1)


def test_range_filter(spark):
    df = spark.createDataFrame([(9999,), (10000,), (50000,), (50001,)], "rows long")
    assert [r.rows for r in catalogue.range_filter(df, rows=(10000, 50000)).collect()] == [10000, 50000]
    assert catalogue.range_filter(df, rows=None).count() == 4
    assert catalogue.contains_any(df.select(F.col("rows").cast("string").alias("n")), "n", None).count() == 0
    assert catalogue.contains_any(df.select(F.col("rows").cast("string").alias("n")), "n", "all").count() == 4


def test_fetch_counts_new_ones_only(spark):
    wanted = spark.createDataFrame([(f"m{k:02d}",) for k in range(30)], "name string")
    got = catalogue.to_fetch(wanted, wanted.limit(5), "name", 4)
    assert [r.name for r in got.collect()] == ["m05", "m06", "m07", "m08"]


def test_upsert(spark):
    old = spark.createDataFrame([("g0", "m1", 1, "x"), ("g0", "m2", 2, None)], "g string, m string, t int, metrics string")
    new = spark.createDataFrame([("g0", "m1", 9, None)], "g string, m string, t int, metrics string")
    assert sorted(map(tuple, results.upsert_keeping(old, new, ["g", "m"], "metrics").collect())) == [("g0", "m1", 9, "x"), ("g0", "m2", 2, None)]
    assert sorted(map(tuple, results.upsert(old, new, ["g", "m"]).collect()), key=str) == [("g0", "m1", 9, None), ("g0", "m2", 2, None)]


def test_nested_samples_and_comparison(spark):
    wall, drawn = "gpu__time_duration_measured_wallclock.avg", "device__attribute_display_name"
    sample = lambda v, s, u: {"value": v, "value_str": s, "unit": u}
    report = [("m1", [{"action_id": 1, "ranges": ["main 7"], "metrics": {wall: sample(2e9, None, "ns"), drawn: sample(None, "chip", None)}}, {"action_id": 2, "ranges": ["main 7", "warmup 7"], "metrics": {wall: sample(1e9, None, "ns"), drawn: sample(None, "other", None)}}])]
    shape = "method string, actions array<struct<action_id:int,ranges:array<string>,metrics:map<string,struct<value:double,value_str:string,unit:string>>>>"
    samples = results.samples_of(spark.createDataFrame(report, shape))
    rolled = results.rollup(samples, results.metric_dimension(spark), ["method", "graph_idx", "range"])
    got = {(r.range, r.metric): (r.value, r.value_str, r.unit) for r in rolled.collect()}
    assert got["main", "time_duration"] == (3.0, None, "s") and got["warmup", "time_duration"][0] == 1.0 and got["main", "device_name"][1] == "chip"
    made = results.derived(rolled, ["method", "graph_idx", "range"])
    assert made.filter("metric = 'dram_throughput' and value is null").count() == 2
    props = spark.createDataFrame([("7", "g", "synthetic", 10, 0.5), ("8", "h", "synthetic", 10, None)], "graph_idx string, graph_name string, graph_type string, num_nodes long, sparsity double")
    shown = results.comparison(rolled, props, "time_duration", "main", "synthetic", ["m1", "m2"]).collect()
    assert [(r.graph, r.method, r.value) for r in shown] == [("7 (n=10 p=0.5)\ng", "m1", 3.0), ("7 (n=10 p=0.5)\ng", "m2", None)]


def test_reports(spark):
    rows = [("1", "a-sparse", "Scale-Free_1", "synthetic", 2.0, "2024-01-02", 10, 0.5, None), ("1", "a-sparse", "Scale-Free_1", "synthetic", 3.0, "2024-01-01", 10, 0.5, None), ("2", "b", "x", "matrix", 4.0, "2024-01-01", 10, None, 0.1)]
    df = spark.createDataFrame(rows, "graph_index string, method string, graph_name string, graph_type string, time_seconds double, date string, num_nodes long, sparsity double, time_std double")
    assert [tuple(r) for r in results.bars(df, "synthetic", "time_seconds", ["a-sparse", "b"], "sparse").collect()] == [("1", 3.0)]
    assert results.family(df, "Scale-Free").count() == 2
    line = results.size_method_series(df).filter("method = 'b'").first()
    assert (line.position, line.sparsity, line.time_std) == (0, 0.0, 0.1)
    assert results.annotation_height(df, "method", "time_seconds").filter("method = 'a-sparse'").first().height == pytest.approx(3.15)


def test_sizing(spark):
    one = spark.range(1)
    lim = scalar.cluster_limits(F.lit(1000).cast("bigint"), F.lit(20000).cast("bigint"), F.lit(10).cast("bigint"), F.lit(10**7).cast("bigint"))
    r = one.select(*[c.alias(n) for n, c in lim.items()]).first()
    assert (r.max_edges_per_cluster, r.num_clusters) == (4000, 6) and r.memory_per_cluster == 4000 * 52 and r.total_memory_needed == 4000 + 240000 + 6 * 4000 * 52
    few = scalar.cluster_limits(F.lit(10).cast("bigint"), F.lit(4).cast("bigint"), F.lit(10).cast("bigint"), F.lit(10**7).cast("bigint"))
    assert one.select(few["num_clusters"]).first()[0] is None
    values = [0.1, 65504.0, 1e6, 2049.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalar.to_half("v")).collect()]
    assert got[0] == float(np.float16(0.1)) and got[1] == 65504.0 and got[2] == float("inf") and got[3] == 2048.0


def test_validators(spark):
    a = cells(spark, PATH)
    schema.require_unique(a, "i", "k")
    with pytest.raises(schema.ShapeError):
        schema.require_unique(a, "i")
    with pytest.raises(schema.ShapeError):
        schema.require_columns(a, "i", "w")
    with pytest.raises(schema.ShapeError):
        schema.require_square(2, 3)
    with pytest.raises(schema.ShapeError):
        schema.require_multipliable(2, 3)
    assert stats.capacity(spark)["parallelism"] >= 1
    s = stats.matrix_stats(a.withColumn("v", F.when(F.col("i") == 0, 0.0).otherwise(1.0)), 3, 4).first()
    assert (s.nnz, s.nonzero, s.sparsity) == (4, 3, pytest.approx(1 - 4 / 12))


def test_bfs_clusters_of_a_long_path(spark):
    edges = [(k, k + 1, 1.0) for k in range(67)]
    df = cells(spark, edges + [(k, i, v) for i, k, v in edges])
    got = {r.node: r.cluster for r in partition.grow_clusters(df, 68, 10_000, 1, 0.0).collect()}
    assert got == dict.fromkeys(range(68), 0)


def test_percentiles_under_ties(spark):
    values = [0.0] * 900 + [float(k) for k in range(100)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    got = stats.percentiles(df, "x", {"a": 0.25, "b": 0.9, "c": 0.905, "d": 0.99, "e": 1.0}).first()
    assert list(got) == pytest.approx(np.percentile(values[:-1], [25, 90, 90.5, 99, 100]))
    assert list(stats.percentiles(df.limit(0), "x", {"a": 0.5}).first()) == [None]


def test_sums_before(spark):
    df = spark.createDataFrame([(k * 37 % 101, k % 7) for k in range(101)], "x long, n long")
    got = {r.x: r.s for r in structure.sums_before(df, ("x",), {"s": F.col("n")}, parts=6).collect()}
    size = {k * 37 % 101: k % 7 for k in range(101)}
    assert got == {x: sum(size[y] for y in range(x)) for x in size}


def test_products_of_many_graphs(spark):
    graphs = {"a": (noise(20), noise(21, 25, 6)), "b": (noise(22), noise(23, 25, 9)), "none": ([], noise(24, 25, 3))}
    a = spark.createDataFrame([(g, *c) for g, (m, _) in graphs.items() for c in m], "graph_id string, i long, k long, v long")
    x = spark.createDataFrame([(g, *c) for g, (_, m) in graphs.items() for c in m], "graph_id string, k long, j long, w long")
    for strategy in ("auto", "blocked", "salted"):
        got = table(multiply.multiply_graphs(a, x, strategy), "graph_id", "i", "j", "val")
        assert got == {(g, *c): v for g, (m, n) in graphs.items() for c, v in plain_product(m, n).items()}
    multiply.register_strategy("wrong", lambda a, x: multiply.auto(a, x).withColumn("val", F.col("val") + F.when(F.col("i") < 30, 1).otherwise(0)))
    try:
        info = spark.createDataFrame([(g, f"graph {g}", "synthetic", 30, 0.5) for g in graphs], "graph_id string, name string, type string, num_nodes long, sparsity double")
        rows = {(r.method, r.graph_idx): r for r in runner.run_methods(info, a, x, ["auto", "merge", "wrong"], "today").collect()}
    finally:
        del multiply.STRATEGIES["wrong"]
    assert len(rows) == 9 and {k for k, r in rows.items() if not r.is_correct} == {("wrong", "a")}
    assert rows["merge", "b"].metrics["main"]["cells"].value == len(plain_product(*graphs["b"])) and rows["merge", "none"].metrics["main"]["cells"].value == 0
    assert rows["auto", "a"].graph_name == "graph a" and rows["auto", "a"].date == "today"


def test_sizes_are_checked(spark):
    a, x = cells(spark, PATH), feats(spark, [[1.0]] * 3)
    assert multiply.multiply(a, x, a_cols=3, x_rows=3).count() == 3
    with pytest.raises(schema.ShapeError):
        multiply.multiply(a, x, a_cols=3, x_rows=4)
    with pytest.raises(schema.ShapeError):
        multiply.multiply(a, x.withColumn("j", F.col("j") + 5000), "wide")


def test_clusters_sum_large_whole_numbers_exactly(spark):
    a, x = [(0, 0, 2**60), (0, 1, 3), (1, 1, 5)], [(0, 0, 1), (1, 0, 7), (1, 1, 2)]
    da, dx = spark.createDataFrame(a, "i long, k long, v long"), spark.createDataFrame(x, "k long, j long, w long")
    # Node 0 is in two clusters, node 1 in none.
    twice = spark.createDataFrame([(0, 4), (0, 9)], "node long, cluster int")
    assert table(multiply.clustered(da, dx, twice), "i", "j", "val") == plain_product(a, x)


@pytest.mark.parametrize("whole", [True, False])
def test_heavy_tiles_are_made_by_several_tasks(spark, whole):
    a, x = noise(1, whole=whole), noise(2, 25, 12, whole=whole)
    kind = "long" if whole else "double"
    da, dx = spark.createDataFrame(a, f"i long, k long, v {kind}"), spark.createDataFrame(x, f"k long, j long, w {kind}")
    layer = F.when(F.col("i") % 2 == 0, 0).otherwise(1)
    for made in (tiles.products(da, dx, 7, whole, heavy=5), tiles.products(da, dx, 7, whole, layer, 2, 40), tiles.products(da, dx, 4096, whole)):
        got, want = table(made, "i", "j", "val"), plain_product(a, x)
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_tiles_take_any_numbers(spark):
    inf = float("inf")
    a = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, inf), (2, 1, None), (2, 0, 3.0), (3, 2, None), (None, 0, 1.0), (-5, 1, 1.0)]
    x = [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 4.0), (1, 2, inf), (2, 0, 1.0), (None, 0, 9.0)]
    da, dx = spark.createDataFrame(a, "i long, k long, v double"), spark.createDataFrame(x, "k long, j long, w double")
    want = table(multiply.auto(da, dx), "i", "j", "val")
    assert table(multiply.blocked(da, dx, tile=4), "i", "j", "val") == want and want[2, 2] is None and want[1, 1] == -inf
    assert table(multiply.clustered(da, dx, spark.createDataFrame([(0, 1), (2, 1)], "node long, cluster int")), "i", "j", "val") == want


def test_tiles_raise_where_a_sum_passes_long(spark):
    a = spark.createDataFrame([(0, k, 2**62) for k in range(2)], "i long, k long, v long")
    x = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, -1)], "k long, j long, w long")
    with pytest.raises(Exception, match="range of long"):
        multiply.blocked(a, x).collect()


def test_merge_steps_over_tiles_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(stats, "MERGED", 7)
    rng = random.Random(21)
    a = sorted({(rng.randrange(-10, 20), rng.choice([5, 4095, 4096, 9000, -1, rng.randrange(-9000, 20000), rng.randrange(40)])) for _ in range(400)})
    x = sorted({(rng.choice([5, 4095, 4096, 9000, -1, rng.randrange(-9000, 20000), rng.randrange(40)]), rng.randrange(25)) for _ in range(300)})
    da = spark.createDataFrame([*((i, k, 1) for i, k in a), (None, 5, 1), (3, None, 1)], "i long, k long, v long")
    dx = spark.createDataFrame([(k, j, 1) for k, j in x], "k long, j long, w long")
    rows = stats.merge_steps(da, dx)
    got = table(rows, "i", "j", "steps")
    assert rows.count() == len(got) and set(got) == {(i, j) for i, k in a for m, j in x if k == m}
    for (i, j), steps in got.items():
        assert steps == two_pointers(sorted(k for r, k in a if r == i), sorted(k for k, c in x if c == j))
    # Pairs are the result of the last step: none of them is shuffled.
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
