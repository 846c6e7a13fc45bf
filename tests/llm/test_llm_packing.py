import random

import pytest

from matchloom.llm import binpack as B
from matchloom.llm import mixing as M

SCHEMA = "id long, n long, bin string, part string"


def _plain_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(c - s, i) for i, c in enumerate(bins) if c >= s]
        if fits:
            i = min(fits)[1]
        else:
            bins.append(capacity)
            i = len(bins) - 1
        bins[i] -= s
        out.append(i)
    return out, bins


def test_best_fit_as_the_plain_one():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        sizes = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
        got = B.best_fit_decreasing(sizes, capacity)
        want, bins = _plain_best_fit(sizes, capacity)
        fill = {}
        for b, s in zip(got, sizes, strict=True):
            fill[b] = fill.get(b, 0) + s
        assert max(fill.values()) <= capacity and len(fill) == len(bins)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 60), None, "") for i in range(2000)] + [(9001, 250, None, ""), (9002, None, None, ""), (9003, 0, None, ""), (9004, -1, None, ""), (None, 5, None, ""), (9001, 250, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard in (10_000, 300):
        got = B.pack(df, "id", "n", 100, items_per_shard=shard).collect()
        fill, parts = {}, {}
        for r in got:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
            parts.setdefault(r["id"], []).append((r["part"], r["start"], r["size"]))
        assert all(v <= 100 for v in fill.values()) and all(fill[r["container"]] == r["fill"] for r in got)
        assert sorted(parts.pop(9001)) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
        assert {i: p[0][2] for i, p in parts.items()} == {i: n for i, n, *_ in rows[:2000]} and all(len(p) == 1 for p in parts.values())
        total = sum(fill.values())
        assert total / (100 * len(fill)) > 0.97
    again = {(r["id"], r["part"]): r["container"] for r in B.pack(df.repartition(9), "id", "n", 100, items_per_shard=300).collect()}
    assert again == {(r["id"], r["part"]): r["container"] for r in got}
    assert B.pack(spark.createDataFrame([], SCHEMA), "id", "n", 10).count() == 0


def test_shards_follow_the_parts(spark):
    """A few items of very many parts spread over shards like many small ones; a single shard is refilled like others."""
    df = spark.createDataFrame([(i, 50 * 100 + i, None, "") for i in range(20)], SCHEMA)
    got = B.pack(df, "id", "n", 50, items_per_shard=100).collect()
    assert sum(r["size"] for r in got) == sum(5000 + i for i in range(20)) and all(r["size"] <= 50 for r in got)
    assert len({r["container"].split("-")[1] for r in got if r["container"].startswith("0-")}) > 15
    one = B.pack(spark.createDataFrame([(i, 40, None, "") for i in range(4)], SCHEMA), "id", "n", 100).collect()
    assert {r["container"].split("-")[0] for r in one} == {"1"} and len({r["container"] for r in one}) == 2


def test_token_count(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",), ("日本語" * 5000,)], "t string")
    got = [r[0] for r in df.select(B.token_count("t")).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] > 1000


def test_poisson_draws():
    for cap in (1, 2, 4):
        for mean in (0.01, 0.3, 0.9 * cap):
            rate = M.rate_for(mean, cap)
            t = M.thresholds(rate, cap)
            assert sum(1 - x for x in t) == pytest.approx(mean, abs=1e-6) and t == sorted(t)
    assert M.thresholds(M.rate_for(3, 3), 3) == [0.0] * 3
    for mean, cap in ((650.0, 2000), (800.0, 2000), (1990.0, 2000), (3000.0, 5000)):
        t = M.thresholds(M.rate_for(mean, cap), cap)
        assert sum(1 - x for x in t) == pytest.approx(mean, rel=1e-6)


def test_rates_keep_the_total_and_the_caps():
    got = M.plan_rates({"a": (10, 1000), "b": (10, 100), "c": (1, 50)}, [("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3), ("d", 0.0, 1)], 1000)
    assert got["b"] == (2.0, 2) and sum(got[s][0] * n for s, n in (("a", 1000), ("b", 100), ("c", 50))) == pytest.approx(1000)
    assert got["c"][0] <= 3


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), rng.randint(1, 100), f"text {i}") for i in range(6000)] + [(7001, None, 5, "x"), (7002, "zzz", 5, "x"), (7003, "a", None, "x"), (None, "a", 5, "x")]
    df = spark.createDataFrame(docs, "id long, source string, n int, copies string")
    goal = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix(df, "id", "source", "n", goal, total=150_000)
    rows = mixture.collect()
    assert set(mixture.columns) == {"id", "source", "copies", "__size", "__copy", "__position"}
    seen = {}
    for r in rows:
        seen.setdefault((r["source"], r["id"]), []).append(r["__copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= {"a": 1, "b": 2, "c": 4}[s] for (s, _), c in seen.items())
    assert [r["__position"] for r in rows] == sorted(r["__position"] for r in rows)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["none"]["copies"] == 0 and set(rep) == {"a", "b", "c", "none"}
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert rep[s]["size"] == sum(r["__size"] for r in rows if r["source"] == s)
        assert rep[s]["actual_share"] == pytest.approx(share / 0.9, abs=0.03)
    again = {(r["id"], r["__copy"]) for r in M.mix(df.repartition(5), "id", "source", "n", goal, total=150_000)[0].collect()}
    assert again == {(r["id"], r["__copy"]) for r in rows}
    empty, rep0 = M.mix(df.limit(0), "id", "source", "n", goal)
    assert empty.count() == 0 and {r["actual_share"] for r in rep0.collect()} == {0.0}
