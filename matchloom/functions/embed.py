"""Embedders: what turns texts into vectors. The plans take any of them; one for words alone is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import text as X


@runtime_checkable
class Embedder(Protocol):
    """dim numbers for each text, as a column of arrays of unit length; a text without content gives zeros."""

    dim: int

    def column(self, text: Column) -> Column: ...


class HashedEmbedder:
    """A deterministic lexical embedding: a text's terms hashed to signed places, counted, at length 1.

    The JVM finds and hashes the terms; Python adds up a whole Arrow batch at once.
    """

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def column(self, text: Column) -> Column:
        dim = self.dim

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for places in batches:
                sizes = np.fromiter((0 if p is None else len(p) for p in places), np.int64, len(places))
                flat = np.concatenate([np.asarray(p, np.int64) for p in places if p is not None and len(p)] or [np.empty(0, np.int64)])
                at = np.repeat(np.arange(len(places)), sizes) * dim + np.abs(flat) - 1
                x = np.bincount(at, np.sign(flat), len(places) * dim).reshape(-1, dim)
                yield pd.Series(list(unit_rows(x).astype(np.float32)))

        return F.pandas_udf(run, "array<float>")(hashed_places(X.terms(text), dim))

    def compact(self, text: Column) -> Column:
        """What column() adds up, as it moves in tens of bytes instead of dim numbers: made in the JVM alone."""
        return F.transform(hashed_places(X.terms(text), self.dim), lambda x: x.cast("smallint" if self.dim < 1 << 15 else "int"))

    def compact_similarity(self, a: Column, b: Column) -> Column:
        """The product of two texts' vectors from their compact forms."""
        dim = self.dim

        def dense(x: pa.Array) -> np.ndarray:
            lists = pc.fill_null(x, []) if x.null_count else x
            flat, rows = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(lists).to_numpy()
            return unit_rows(np.bincount(rows * dim + np.abs(flat) - 1, np.sign(flat), len(x) * dim).reshape(-1, dim))

        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            out = np.empty(len(x))
            for at in range(0, len(x), 2048):
                out[at : at + 2048] = np.einsum("nd,nd->n", dense(x.slice(at, 2048)), dense(y.slice(at, 2048)))
            return pa.array(out)

        run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "double")(a, b)


def hashed_places(terms: Column, dim: int) -> Column:
    """The place 1..dim of each term, negative where its sign is: both from its MD5."""
    number = lambda t, a: F.conv(F.substring(F.md5(t), a, 8), 16, 10).cast("long")
    return F.transform(terms, lambda t: ((number(t, 1) % dim) + 1) * F.when(number(t, 9) % 2 == 0, 1).otherwise(-1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays as it is."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


_models: dict[str, Callable[[list[str]], np.ndarray]] = {}


class ModelEmbedder:
    """Any model: `load` gives a function from a list of texts to a matrix of dim columns.

    A worker process loads each model once, by its name, whatever number of tasks it runs. Texts go to the model in
    batches; rows are brought to unit length. Null and empty texts are not sent; they give zeros. A matrix of another
    width is an error.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 32) -> None:
        self.name, self.load, self.dim, self.batch = name, load, dim, batch

    def column(self, text: Column) -> Column:
        name, load, dim, size = self.name, self.load, self.dim, self.batch

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if name not in _models:
                _models[name] = load()
            for texts in batches:
                x = np.zeros((len(texts), dim))
                asked = [i for i, t in enumerate(texts) if t]
                for a in range(0, len(asked), size):
                    rows = asked[a : a + size]
                    got = np.asarray(_models[name]([texts.iloc[i] for i in rows]), dtype=np.float64)
                    if got.shape != (len(rows), dim):
                        raise ValueError(f"{name} gave {got.shape} for {len(rows)} texts of {dim} numbers")
                    x[rows] = got
                yield pd.Series(list(unit_rows(x).astype(np.float32)))

        return F.pandas_udf(run, "array<float>")(text)
