import numpy as np

from matchloom.llm import knn

SCHEMA = "id long, v array<float>, key string, rep int"


def _clusters(n, dim=16, seed=0, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, dim))
    x = np.repeat(centres, size, axis=0) + 0.15 * rng.standard_normal((n // size * size, dim))
    return x * rng.uniform(0.3, 3, (len(x), 1))


def _exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for a in range(len(u)):
        s = np.round(u @ u[a], 9)
        s[a] = -9
        out[ids[a]] = [ids[b] for b in np.lexsort((ids, -s))[:k]]
    return out


def test_recall_against_brute_force(spark):
    x = _clusters(3000)
    ids = np.arange(len(x)) * 7
    df = spark.createDataFrame([(int(i), [float(y) for y in v], "c", 0) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(5)
    want = _exact(x.astype(np.float32).astype(float), ids, 5)
    got = {}
    for r in knn.nearest(df, "id", "v", 16, 5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(x)
    found = sum(len(set(got[i].values()) & set(want[i])) for i in want)
    assert found / (5 * len(want)) > 0.95


def test_unusable_rows_copies_and_ties(spark):
    e = lambda *k: [1.0 if j in k else 0.0 for j in range(4)]
    rows = [(1, e(0)), (1, e(0)), (2, [2.0 * y for y in e(0)]), (3, e(0)), (4, e(0, 1)), (5, None), (6, [0.0] * 4), (7, [1.0] * 3), (8, [1.0, None, 0.0, 0.0]), (None, e(2)), (9, [float("nan")] * 4)]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    got = {}
    for r in knn.nearest(df, "id", "v", 4, 2).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [1, 2]}


def test_large_cells_are_worked_off_in_chunks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(8) + 0.01 * rng.standard_normal((400, 8))  # all in one cell
    df = spark.createDataFrame([(i, [float(y) for y in v], "", 0) for i, v in enumerate(x)], SCHEMA)
    want = _exact(x.astype(np.float32).astype(float), np.arange(400), 3)
    got = {}
    for r in knn.nearest(df, "id", "v", 8, 3, cell_rows=50).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    found = sum(len(got[i] & set(want[i])) for i in want)
    assert found / 1200 > 0.98


def test_few_and_none(spark):
    assert knn.nearest(spark.createDataFrame([], SCHEMA), "id", "v", 4, 5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], "", 0)], SCHEMA)
    assert knn.nearest(one, "id", "v", 2, 5).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], "", 0), (2, [1.0, 0.1], "", 0)], SCHEMA)
    assert sorted((r["id"], r["neighbour"]) for r in knn.nearest(two, "id", "v", 2, 5).collect()) == [(1, 2), (2, 1)]


def test_probes_come_in_the_order_of_their_success():
    sets = knn.perturbations(4, 30)
    assert sets[0] == (0,) and len(set(sets)) == 30
    assert all(7 - i not in s for s in sets for i in s)
    x = np.random.default_rng(2).standard_normal((50, 8))
    home, probed, far = knn.bucket_ids(x, 3, 4, 1.5, 10, 5)
    assert home.shape == (50, 3) and probed.shape == far.shape == (50, 3, 10)
    assert (probed != home[:, :, None]).all() and (far[:, :, 0] <= far[:, :, 1:].min(axis=2)).all()
    assert knn.bucket_ids(x, 2, 0, 1.5, 10, 5)[1].shape == (50, 2, 0)


def test_codes_keep_seven_digits():
    x = np.random.default_rng(3).standard_normal((100, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert np.abs(knn.decode(knn.encode(x), 24) - x).max() < 1.3e-7
    assert (knn.encode(knn.decode(knn.encode(x), 24).astype(float)) == knn.encode(x)).all()


def test_cells_and_their_borders(spark):
    """Several cells and tables, vectors sent across the borders; items that are given repeatedly and copies of a third."""
    x = _clusters(4000, seed=5)
    ids = np.arange(len(x))
    rows = [(int(i), [float(y) for y in v], "", 0) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows + rows[:1500], SCHEMA).repartition(5)
    want = _exact(x.astype(np.float32).astype(float), ids, 5)
    got = {}
    for r in knn.nearest(df, "id", "v", 16, 5, functions=2).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(v) == len(set(v)) == 5 for v in got.values()) and len(got) == len(x)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) > 0.95
    copies = [(10_000 + i, rows[7][1], "", 0) for i in range(2000)]
    for few in (10**6, 10):  # by a broadcast list, and by a shuffle
        knn.BROADCAST_ROWS = few
        try:
            near = {}
            for r in knn.nearest(spark.createDataFrame(rows[:2000] + copies, SCHEMA), "id", "v", 16, 5, functions=2).collect():
                near.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
        finally:
            knn.BROADCAST_ROWS = 200_000
        assert [n for _, n in sorted(near[11_999])] == [7, 10_000, 10_001, 10_002, 10_003]
        assert [n for _, n in sorted(near[7])] == [10_000, 10_001, 10_002, 10_003, 10_004] and len(near) == 4000
