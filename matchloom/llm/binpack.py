"""Fixed-capacity containers filled by best-fit decreasing.

A task packs a shard of items, largest first, each into the open bin with the least room that still holds it; the open
bins are found through a segment tree over remaining capacities, in logarithmic time. Shards hold a bounded number of
items whatever the table's size. Bins that a shard leaves badly filled are taken apart and packed once more with those
of other shards, again in bounded shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import checkpointed

#: Where the public vocabulary files lie; every operator that counts tokens takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text in a byte-level public vocabulary; 0 for null and ''. Special tokens' strings are plain text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    # not deterministic for the optimizer, else a filter on the count would encode every text a second time below
    return F.pandas_udf(run, T.LongType()).asNondeterministic()(text)


class CapacityTree:
    """Open bins by remaining capacity 0..capacity: a segment tree of counts over the capacities, bins in its leaves."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_no: int) -> None:
        self.bins.setdefault(room, []).append(bin_no)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin with room for size, removed from the tree; None if there is none."""
        at = size + self.width
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.width
        bin_no = self.bins[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, bin_no


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin number of each size; every size is 0..capacity. Sizes must come in falling order."""
    tree, out, bins = CapacityTree(capacity), [], 0
    for size in sizes:
        found = tree.take(size)
        room, bin_no = found or (capacity, bins)
        bins += found is None
        out.append(bin_no)
        tree.add(room - size, bin_no)
    return out


_PACKED = "__item {item}, part int, start long, size long, bin long, fill long"


def _packer(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "__item", "part"], ascending=[False, True, True], kind="stable")
        pdf["bin"] = np.asarray(best_fit_decreasing(pdf["size"].tolist(), capacity), dtype="int64")
        pdf["fill"] = pdf.groupby("bin")["size"].transform("sum")
        return pdf[["__item", "part", "start", "size", "bin", "fill"]].assign(shard=key[0])

    return run


def pack(df: DataFrame, item: str, size: str, capacity: int, items_per_shard: int = 50_000, refill_below: float = 0.97, rounds: int = 1) -> DataFrame:
    """Containers of fixed capacity filled with items; gives container (string), item, part, start, size, fill.

    Each item lies whole in one container, unless its size exceeds the capacity: then it is cut into parts of capacity
    and a rest (part from 0, start is the offset of the part), which are packed like items. fill is the container's
    total. Null items are left out; sizes that are null, 0 or negative take no container and give no row. A repeated
    item counts once, with its greatest size. An empty table gives an empty result. The result doesn't depend on how
    the table is partitioned.

    A shard has about items_per_shard parts by the hash of the item, so no task grows with the table or with the sizes. Bins filled less
    than refill_below of the capacity are taken apart and packed again with those of other shards, `rounds` times.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    kind = df.schema[item].dataType.simpleString()
    src = df.select(F.col(item).alias("__item"), F.col(size).cast("long").alias("__size")).filter(F.col("__item").isNotNull() & (F.col("__size") > 0))
    # read twice below: once for the number of parts, which sets the number of shards
    items = checkpointed(src.groupBy("__item").agg(F.max("__size").alias("__size")))
    cap = F.lit(capacity).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("__size") - 1, cap)
    parts = items.select("__item", "__size", F.posexplode(starts).alias("part", "start")).select(
        "__item", "part", "start", F.least(cap, F.col("__size") - F.col("start")).alias("size")
    )
    shards = max(1, -(-(items.agg(F.sum(F.ceil(F.col("__size") / cap))).first()[0] or 0) // items_per_shard))
    schema = _PACKED.format(item=kind) + ", shard int"

    def packed(rows: DataFrame, n: int, seed: int) -> DataFrame:
        sharded = rows.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "__item", "part"), F.lit(n)).cast("int"))
        return sharded.groupBy("__shard").applyInPandas(_packer(capacity), schema)

    out, now = None, packed(parts, shards, 0)
    for r in range(1, rounds + 1):
        now = checkpointed(now)  # read three times below
        loose = F.col("fill") < int(refill_below * capacity)
        done = now.filter(~loose).withColumn("round", F.lit(r - 1))
        out = done if out is None else out.unionByName(done)
        shards = max(1, -(-now.filter(loose).count() // items_per_shard))
        now = packed(now.filter(loose).drop("bin", "fill", "shard"), shards, r)
    last = now.withColumn("round", F.lit(rounds))
    out = last if out is None else out.unionByName(last)
    return out.select(F.concat_ws("-", "round", "shard", "bin").alias("container"), F.col("__item").alias(item), "part", "start", "size", "fill")
