"""Sources mixed to target weights by Poisson replication.

A source's mean number of copies per document follows from its target share and its size. Every document draws its
number of copies from a Poisson distribution of that mean by inverting it at a number in [0, 1) hashed from seed and
document, so the draw is the same in every run and needs no shuffle. Copies are then spread by a hash of document,
copy and seed: a global shuffle that doesn't depend on the partitioning and in which no source is a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the target list may have; it is read to the driver.
MAX_SOURCES = 10_000


def _probability(k: int, rate: float) -> float:
    """P(K = k) for K Poisson; through logarithms, so that no rate is too large."""
    return math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)


def truncated_mean(lam: float, cap: int) -> float:
    """E[min(K, cap)] for K Poisson with mean lam."""
    p = [_probability(k, lam) for k in range(cap)]
    return math.fsum(k * x for k, x in enumerate(p)) + cap * max(0.0, 1 - math.fsum(p))


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate at which the number of copies, cut at cap, has this mean; infinity if every draw must be cap."""
    if mean >= cap - 1e-9:
        return math.inf
    low, high = 0.0, 1.0
    while truncated_mean(high, cap) < mean:
        if high > 4 * cap + 1000:
            return math.inf  # the mean differs from the cap by less than can be told
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if truncated_mean(mid, cap) < mean else (low, mid)
    return high


def thresholds(rate: float, cap: int) -> list[float]:
    """The cumulative probabilities P(K < k), k = 1..cap: a draw u has as many copies as thresholds it reaches."""
    if math.isinf(rate):
        return [0.0] * cap
    total, out = 0.0, []
    for k in range(cap):
        total += _probability(k, rate)
        out.append(total)
    return out


def unit_hash(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the columns' values; 53 bits."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def plan_rates(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, tuple[float, int]]:
    """(mean copies per document, cap) of each target source that has documents. sizes: source -> (documents, size).

    What a capped or missing source can't fill goes to the others in proportion to their shares, so the total is kept
    as long as any source has copies left.
    """
    there = {s: (share, cap) for s, share, cap in targets if share > 0 and cap > 0 and sizes.get(s, (0, 0))[1] > 0}
    full: dict[str, tuple[float, int]] = {}
    want = float(sum(sizes[s][1] for s in there)) if total is None else float(total)
    left = dict(there)
    while left:
        rest = want - sum(sizes[s][1] * cap for s, (_, cap) in full.items())
        weight = sum(share for share, _ in left.values())
        over = [s for s, (share, cap) in left.items() if max(rest, 0) * share / weight > cap * sizes[s][1]]
        if not over:
            return {s: (float(cap), cap) for s, (_, cap) in full.items()} | {s: (max(rest, 0) * share / weight / sizes[s][1], cap) for s, (share, cap) in left.items()}
        for s in over:
            full[s] = left.pop(s)
    return {s: (float(cap), cap) for s, (_, cap) in full.items()}


def mix(docs: DataFrame, item: str, source: str, size: str, targets: DataFrame, target_source: str = "source", share: str = "target_share", max_repeats: str = "max_repeats", total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of documents drawn so that each source holds its target share of the total size.

    mixture: all columns of docs but size, then __size, __copy (from 1) and __position, a number by which the mixture is
    globally shuffled: rows come in its order within partitions that are split by its ranges.
    report: source, target_share, max_repeats, available_docs, available_size, mean_copies, copies, size, actual_share, capped.

    No document appears more than max_repeats times. Documents whose source is null or not listed, whose item is null or
    whose size is null or not above 0 are left out. A listed source without documents reports 0. Documents with the same
    item value draw the same number. Shares that don't sum to 1 are taken in proportion. Empty tables give an empty
    mixture. A null target share or cap counts as 0. The columns of docs must not begin with two underscores.
    """
    rows = docs.withColumn("__size", F.col(size).cast("long")).drop(size)
    rows = rows.filter(F.col(item).isNotNull() & F.col(source).isNotNull() & (F.col("__size") > 0))
    listed = targets.select(F.col(target_source).alias("s"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("w"), F.coalesce(F.col(max_repeats).cast("int"), F.lit(0)).alias("m")).filter("s is not null")
    goal = [tuple(r) for r in listed.groupBy("s").agg(F.max("w"), F.max("m")).limit(MAX_SOURCES + 1).collect()]
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    names = [g[0] for g in goal]
    stats = rows.filter(F.col(source).isin(names)).groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n"), F.sum("__size").alias("z"))
    sizes = {r["s"]: (r["n"], r["z"]) for r in stats.collect()}  # at most one row for each listed source
    weight = sum(max(w, 0.0) for _, w, _ in goal) or 1.0
    goal = [(s, max(w, 0.0) / weight, m) for s, w, m in goal]
    rates = plan_rates(sizes, goal, total)
    u = unit_hash(F.col(item), seed=seed)
    spark = docs.sparkSession
    # a source's thresholds come from a table of at most MAX_SOURCES rows
    steps = spark.createDataFrame([(s, thresholds(rate_for(mean, cap), cap)) for s, (mean, cap) in rates.items()], "__s string, __steps array<double>")
    copies = F.size(F.filter("__steps", lambda t: u >= t))
    drawn = rows.join(F.broadcast(steps), F.col(source) == F.col("__s")).withColumn("__n", copies).drop("__s", "__steps").filter("__n > 0")
    each = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    placed = each.withColumn("__position", unit_hash(F.col(item), F.col("__copy"), seed=seed + 1))
    mixture = placed.repartitionByRange("__position").sortWithinPartitions("__position")
    plan = spark.createDataFrame(
        [(s, w, m, *sizes.get(s, (0, 0)), float(rates.get(s, (0.0, 0))[0]), bool(s in rates and rates[s][0] >= rates[s][1])) for s, w, m in goal],
        "source string, target_share double, max_repeats int, available_docs long, available_size long, mean_copies double, capped boolean",
    )
    got = drawn.groupBy(F.col(source).alias("source")).agg(F.sum("__n").alias("copies"), F.sum(F.col("__n") * F.col("__size")).alias("size"))
    all_size = got.agg(F.sum("size").alias("total"))
    report = (
        plan.join(F.broadcast(got), "source", "left")  # at most MAX_SOURCES rows
        .join(F.broadcast(all_size))
        .select(
            "source", "target_share", "max_repeats", "available_docs", "available_size", "mean_copies",
            F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("size", F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.col("size") / F.col("total"), F.lit(0.0)).alias("actual_share"), "capped",
        )
    )
    return mixture, report
