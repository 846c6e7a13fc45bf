"""Top N items within every group, by partition lower bounds.

1. Every partition keeps its own N best distinct items of each group. Its N-th best is a lower bound of the group's
   global N-th best; partitions with fewer than N items of a group give no bound.
2. The greatest bound per group is joined to the survivors of step 1; what lies below it goes away before the shuffle.
3. The rest is deduplicated and ranked.

A bound is the pair (score, item id), so that equal scores are cut as sharply as different ones. A group that holds a
third of all rows sends at most N rows per partition into the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import bounded_broadcast, checkpointed

#: Rows gathered before a partition's survivors are pruned again.
PRUNE_ROWS = 200_000


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a row's value differs from the row before; the first row is True."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.ones(len(col), bool)
    if len(col) > 1:
        out[1:] = pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return out


def _best(t: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best distinct items of each group, and a mask of each group's n-th."""
    t = t.take(pc.sort_indices(t, sort_keys=[("__g", "ascending"), ("__s", "descending"), ("__i", "ascending")]))
    new_group = _changes(t["__g"])
    start = np.flatnonzero(new_group)
    # copies of an item within a group: the first in this order, so the best, stays
    group_no = np.cumsum(new_group) - 1
    codes = pc.dictionary_encode(t["__i"]).combine_chunks()
    codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(group_no * (codes.max(initial=0) + 1) + codes, return_index=True)
    keep = np.zeros(t.num_rows, bool)
    keep[first] = True
    distinct_before = np.cumsum(keep) - keep
    rank = distinct_before - np.repeat(distinct_before[start], np.diff(np.append(start, t.num_rows)))
    keep &= rank < n
    return t.filter(pa.array(keep)), (rank == n - 1)[keep]


def _local(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, PRUNE_ROWS
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                t, _ = _best(pa.Table.from_batches(held), n)
                held = t.combine_chunks().to_batches()
                rows = t.num_rows
                limit = max(PRUNE_ROWS, 2 * rows)
        if rows:
            t, nth = _best(pa.Table.from_batches(held), n)
            yield from t.append_column("__bound", pa.array(nth)).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, low: float | None = None, high: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The n items of every group with the highest score; among equals the smaller item id; all where there are fewer.

    Gives group, item, score, rank (1 is best) and the carried columns.
    Rows with a null group, item or score, a NaN score, or a score outside low..high don't count. A repeated item counts
    once in its group, with its best score. An empty table gives an empty result. Other columns are not looked at, so
    their names and nulls don't matter. group and item may be of any orderable type.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("__g"), F.col(item).alias("__i"), s.alias("__s"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    ok = F.col("__g").isNotNull() & F.col("__i").isNotNull() & F.col("__s").isNotNull() & ~F.isnan("__s")
    if low is not None:
        ok &= F.col("__s") >= low
    if high is not None:
        ok &= F.col("__s") <= high
    rows = rows.filter(ok)
    local = rows.mapInArrow(_local(n), T.StructType([*rows.schema.fields, T.StructField("__bound", T.BooleanType())]))
    # the greatest bound: the highest score, and of those the smallest id
    bounds = checkpointed(
        local.filter("__bound")
        .groupBy(F.col("__g").alias("__bg"))
        .agg(F.max("__s").alias("__bs"), F.min_by("__i", F.struct(-F.col("__s"), "__i")).alias("__bi"))
    )
    known = local.join(bounded_broadcast(bounds), F.col("__g") == F.col("__bg"), "left")
    above = known.filter(F.col("__bs").isNull() | (F.col("__s") > F.col("__bs")) | ((F.col("__s") == F.col("__bs")) & (F.col("__i") <= F.col("__bi"))))
    each = above.groupBy("__g", "__i").agg(F.max("__s").alias("__s"), *(F.max_by(f"__c_{c}", "__s").alias(f"__c_{c}") for c in carry))
    w = Window.partitionBy("__g").orderBy(F.desc("__s"), "__i")
    return (
        each.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), "rank", *(F.col(f"__c_{c}").alias(c) for c in carry))
    )
