import numpy as np
import pytest

from edgeloom.llm import embedding_dedup as ed

#: Least recall by number of cells.
RECALL = {24: 0.999, 1024: 0.99, 4096: 0.99, 1 << 20: 0.99}


def by_hand(rows, threshold=0.9):
    """rows: (id, vector). Returns (id, n_links, component) per row."""
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least or (d is not None and d < least[r]) else least[r]
    return sorted(((d, links[i], least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 1, 2, 5, 30], p=[0.4, 0.2, 0.2, 0.1, 0.08, 0.02])):
            rows.append((base + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3])).astype(np.float32).astype(float).tolist())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "PER_CELL", 40)
    rows = made(3)
    rows += [(-5, None), (-6, []), (-7, [0.0] * 16), (-8, [1.0] * 15 + [None]), (-9, [float("nan")] * 16), (-10, [float("inf")] + [1.0] * 15), (-11, [1.0, 2.0]), (-12, [2.0, 4.0]), (None, rows[0][1]), (-13, rows[0][1]), (-13, rows[0][1])]
    df = spark.createDataFrame([(d, v, 0) for d, v in rows], "vec_id long, embedding array<double>, rep int")
    got = ed.embedding_dedup(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == by_hand(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert ed.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1024, 4])
def test_exact_against_brute_force(spark, monkeypatch, most):
    """Random vectors without clusters, in cells of one and of several levels."""
    monkeypatch.setattr(ed, "BLOCK", 64)
    monkeypatch.setattr(ed, "PER_CELL", 12)
    monkeypatch.setattr(ed, "LEVEL", most)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(250, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base + 0.12 * rng.normal(size=base.shape), base[:20]]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = by_hand(rows)
    got = ed.embedding_dedup(df, exact=True).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("cells", [24, 1024, 4096, 1 << 20])
def test_recall_of_pairs_at_the_threshold(cells):
    """Random vectors, the hardest there are, in 64 dimensions, with pairs at exactly 0.9."""
    rng = np.random.default_rng(0)
    x = ed.unit(rng.normal(size=(1000, 64)))
    w = rng.normal(size=x.shape)
    w = ed.unit(w - (w * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * w
    levels = ed.levels_of(rng.normal(size=(ed.SAMPLE, 64)), cells)
    assert np.prod([len(c) for c in levels]) >= cells and max(map(len, levels)) <= ed.LEVEL
    a, b = (np.concatenate([ed.cells_of(v[k : k + 250], levels) for k in range(0, len(v), 100)]) for v in (x, y))
    recall = np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())])
    print(cells, recall)
    assert recall > RECALL[cells]


def test_testdata(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in df.select("vec_id", "embedding").orderBy("vec_id").collect()], float)
    u = ed.unit(x)
    want = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    got = ed.embedding_dedup(df).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want.tolist()
