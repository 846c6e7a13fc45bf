import random

from matchloom.llm import topn

SCHEMA = "g string, i long, s double, i__ string, rank int"


def _brute(rows, n, low=0.0, high=1.0):
    best = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and s == s and low <= s <= high:
            best[(g, i)] = max(best.get((g, i), -1), s)
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        out |= {(g, i, k) for k, (_, i) in enumerate(ranked, 1)}
    return out


def test_against_brute_force_with_ties_copies_nulls_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        g = "hot" if rng.random() < 0.35 else rng.choice([None, *(f"g{k}" for k in range(40))])
        s = rng.choice([None, float("nan"), -1.0, 2.0, *[round(rng.random(), 1)] * 8])
        rows.append((g, i if rng.random() > 0.01 else None, s, "x", 1))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 3, 10):
        got = {(r["g"], r["i"], r["rank"]) for r in topn.top_n_per_group(df, "g", "i", "s", n, 0.0, 1.0).collect()}
        assert got == _brute(rows, n)


def test_an_item_with_several_scores_counts_with_its_best(spark):
    df = spark.createDataFrame([("a", 1, 0.2, "p", 0), ("a", 1, 0.9, "q", 0), ("a", 2, 0.5, "r", 0)], SCHEMA).repartition(3)
    got = topn.top_n_per_group(df, "g", "i", "s", 1, carry=("i__",)).collect()
    assert [(r["i"], r["s"], r["i__"]) for r in got] == [(1, 0.9, "q")]


def test_empty(spark):
    assert topn.top_n_per_group(spark.createDataFrame([], SCHEMA), "g", "i", "s", 5).count() == 0


def test_pruning_within_a_partition(spark, monkeypatch):
    monkeypatch.setattr(topn, "PRUNE_ROWS", 50)
    import pyarrow as pa

    t = pa.table({"__g": ["a"] * 500 + ["b"] * 500, "__i": list(range(1000)), "__s": [float(i % 97) for i in range(1000)]})
    out = pa.Table.from_batches(list(topn._local(3)(iter(t.to_batches(max_chunksize=40)))))
    best = {g: sorted(((-float(i % 97), i) for i in range(lo, lo + 500)))[:3] for g, lo in (("a", 0), ("b", 500))}
    got = {g: sorted((-s, i) for h, i, s in zip(*(out[c].to_pylist() for c in ("__g", "__i", "__s")), strict=True) if h == g) for g in "ab"}
    assert got == best
