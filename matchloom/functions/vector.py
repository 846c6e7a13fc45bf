"""Vectors as arrays of numbers; sums run in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def dot_arrow(a: Column, b: Column) -> Column:
    """dot() of arrays of one length for many rows: a whole Arrow batch in one numpy call; null where either is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            ok = (x.notna() & y.notna()).to_numpy()
            out = np.full(len(x), np.nan)
            if ok.any():
                p, q = (np.stack(v[ok].to_list()).astype(np.float64) for v in (x, y))
                out[ok] = np.einsum("nd,nd->n", p, q)
            yield pd.Series(pd.arrays.FloatingArray(np.nan_to_num(out), ~ok))

    return F.pandas_udf(run, "double")(a, b)
