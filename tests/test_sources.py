import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.sources import generators, readers, selectors, sinks


def cells(df):
    return {(r.i, r.k): r.v for r in df.collect()}


def test_symmetric_matrix_market(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% a remark\n3 3 3\n1 1 2.0\n2 1 -1.0\n3 3 4.0\n")
    head, body = readers.matrix_market(spark, str(tmp_path / "s.mtx"))
    assert cells(body) == {(0, 0): 2, (1, 0): -1, (0, 1): -1, (2, 2): 4}
    h = head.first()
    assert (h.name, h.layout, h.symmetry, h.rows, h.cols, h.stored) == ("s", "coordinate", "symmetric", 3, 3, 3)


def test_other_matrix_market_forms(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n%\n3 2\n" + "\n".join("1 0 2.5 0 -4 5".split()) + "\n")
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n")
    (tmp_path / "w.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n")
    head, body = readers.matrix_market(spark, str(tmp_path / "*.mtx"))
    of = lambda n: cells(body.filter(F.col("name") == n))
    assert of("a") == {(0, 0): 1, (2, 0): 2.5, (1, 1): -4, (2, 1): 5}
    assert of("p") == {(0, 2): 1, (1, 0): 1} and of("w") == {(1, 0): 3, (0, 1): -3}
    assert {r.name: (r.rows, r.cols, r.stored) for r in head.collect()} == {"a": (3, 2, 6), "p": (2, 3, 2), "w": (2, 2, 1)}


def test_large_array_over_splits(spark, tmp_path):
    values = np.arange(5000) % 7
    (tmp_path / "v.mtx").write_text("%%MatrixMarket matrix array real general\n5000 1\n" + "\n".join(map(str, values)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = cells(readers.matrix_market(spark, str(tmp_path / "v.mtx"))[1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(k, 0): v for k, v in enumerate(values.tolist()) if v}


def test_general_matrix_as_graph(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 2 5\n2 1 7\n1 1 1\n")
    assert cells(readers.matrix_graph(readers.matrix_market(spark, str(tmp_path / "g.mtx"))[1])) == {(0, 1): 7, (1, 0): 7, (0, 0): 1}


def test_edge_lists(spark, tmp_path):
    with gzip.open(tmp_path / "n.txt.gz", "wt") as f:
        f.write("# from to\n1\t2\n2 1\n\n3   3\n4 1\n")
    with gzip.open(tmp_path / "n.csv.gz", "wt") as f:
        f.write("1,2\n2, 3\n")
    want = {(1, 2): 1, (2, 1): 1, (3, 3): 1, (1, 4): 1, (4, 1): 1}
    assert cells(readers.load(spark, str(tmp_path / "n.txt.gz"))) == want
    assert cells(readers.load(spark, str(tmp_path / "n.csv.gz"))) == {(1, 2): 1, (2, 1): 1, (2, 3): 1, (3, 2): 1}
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "n.pkl"))


def test_matrix_market_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 3, 1.5), (7, 0, -2.0)], "i long, k long, v double").repartition(3)
    sinks.save_matrix_market(df, 8, 4, str(tmp_path / "m"))
    head, body = readers.matrix_market(spark, str(tmp_path / "m"), folder=True)
    assert cells(body) == {(0, 3): 1.5, (7, 0): -2} and head.first().stored == 2


def test_stored_graphs(spark, tmp_path):
    graphs = generators.grid(spark, sizes=(20, 30))
    edges = generators.scale_free(graphs)
    sinks.save_edges(edges, str(tmp_path / "g"))
    assert readers.stored_graphs(spark, str(tmp_path / "g")).count() == edges.count()
    one = readers.stored_graphs(spark, str(tmp_path / "g"), ["1"])
    assert {r.graph_id for r in one.select("graph_id").distinct().collect()} == {"1"} and "PartitionFilters: [graph_id" in one._jdf.queryExecution().toString().replace("isnotnull(graph_id", "graph_id")


def test_catalogue(spark, tmp_path):
    rows = [{"id": 1, "name": "a", "group": "g", "rows": 2, "cols": 2, "nnz": 1}, {"id": 2, "name": "a", "group": "h", "rows": 3, "cols": 3, "nnz": 1}]
    (tmp_path / "c.json").write_text(json.dumps(rows, indent=4))
    assert [(r.id, r.group) for r in readers.catalogue(spark, str(tmp_path / "c.json")).collect()] == [(2, "h")]
    assert readers.catalogue(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.catalogue(spark, str(tmp_path / "none.json"), required=True)


def test_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"graph_index": "0", "method": "m", "time_seconds": 1.5}]))
    assert readers.results(spark, str(tmp_path / "r.json")).first().time_seconds == 1.5
    assert readers.results(spark, str(tmp_path / "none.json")).count() == 0
    tree = {"m": {"0": {"graph_name": "g", "num_nodes": 3, "metrics": {"main": {"time_duration": {"value": 2.0, "unit": "s"}}}}}}
    (tmp_path / "t.json").write_text(json.dumps(tree, indent=4))
    r = readers.nested_results(spark, str(tmp_path / "t.json")).first()
    assert (r.method, r.graph_idx, r.num_nodes, r.metrics["main"]["time_duration"].value) == ("m", "0", 3, 2.0)
    sinks.save_results(readers.results(spark, str(tmp_path / "r.json")), str(tmp_path / "out"), "json")
    assert readers.results(spark, str(tmp_path / "out")).first().method == "m"


def test_selectors(spark):
    assert selectors.number_ranges("0-2,5") == [(0, 2), (5, 5)]
    graphs = spark.createDataFrame([("0", "g0", "synthetic"), ("3", "g3", "synthetic"), ("x", "matrix one", "matrix"), ("y", "net", "snap")], "graph_id string, name string, type string")
    ids = lambda **o: [r.graph_id for r in selectors.select(graphs, **o).collect()]
    assert ids(synthetic="0-2") == ["0"] and ids(synthetic="all", networks="all") == ["0", "3", "y"] and ids(matrices="one,two") == ["x"]
    with pytest.raises(ValueError):
        ids()


@pytest.mark.parametrize("make", [generators.erdos_renyi, generators.erdos_renyi_sparse])
def test_erdos_renyi(spark, make):
    got = {(r.i, r.k) for r in make(spark, 300, 0.05).collect()}
    assert all((k, i) in got and i != k for i, k in got)
    assert abs(len(got) / 2 - 0.05 * 300 * 299 / 2) < 4 * np.sqrt(0.05 * 0.95 * 300 * 299 / 2)
    assert got == {(r.i, r.k) for r in make(spark, 300, 0.05).collect()} != {(r.i, r.k) for r in make(spark, 300, 0.05, seed=1).collect()}
    assert make(spark, 30, 1.0).count() == 30 * 29 and make(spark, 30, 0.0).count() == 0 and make(spark, 1, 0.5).count() == 0


def test_scale_free(spark):
    edges = generators.scale_free(generators.grid(spark, sizes=(200, 6, 3)))
    per = {r.graph_id: r["count"] for r in edges.groupBy("graph_id").count().collect()}
    assert per == {"0": 2 * 5 * 195, "1": 2 * 5 * 1}
    degree = [r["count"] for r in edges.filter("graph_id = '0'").groupBy("i").count().collect()]
    assert min(degree) >= 1 and max(degree) > 25
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, generators.scale_free(generators.grid(spark, sizes=(200, 6, 3))).collect()))


def test_features_and_grid(spark):
    nodes = spark.range(50).select(F.col("id").alias("node"))
    f = generators.random_features(nodes)
    assert f.count() == 500 and f.filter("w < 0 or w >= 1").count() == 0 and abs(f.agg(F.avg("w")).first()[0] - 0.5) < 0.05
    assert generators.grid(spark, erdos_renyi=True).count() == 4 * 3 + 4
