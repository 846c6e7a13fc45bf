"""Tables on disk that are written again and again: repositories by key, and vectors with what is known of them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.files import upsert


class Repository(Protocol):
    """What keeps rows by key."""

    def save(self, rows: DataFrame) -> None: ...
    def get(self, keys: DataFrame) -> DataFrame: ...
    def list_all(self) -> DataFrame: ...
    def delete(self, keys: DataFrame) -> None: ...
    def exists(self, keys: DataFrame) -> DataFrame: ...
    def clear(self) -> None: ...


class ParquetRepository:
    """Rows by key in numbered versions of a Parquet table: a reader sees the last version that was written whole, a
    writer never touches one that is being read. Of rows with one key the last written stays. Null keys are kept apart
    from all others by nobody: they are left out."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), list(key), schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]  # one entry for each version
        whole = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in whole)

    def _write(self, rows: DataFrame) -> None:
        done = self._versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/v={(done[-1] if done else 0) + 1}")

    def list_all(self) -> DataFrame:
        done = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={done[-1]}") if done else self.spark.createDataFrame([], self.schema)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=self.key)

    def save(self, rows: DataFrame) -> None:
        names = self.list_all().columns
        self._write(upsert(self.list_all(), self._keyed(rows).select(*names).dropDuplicates(self.key), self.key))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.list_all().join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def delete(self, keys: DataFrame) -> None:
        self._write(self.list_all().join(keys.select(*self.key).distinct(), self.key, "left_anti"))

    def exists(self, keys: DataFrame) -> DataFrame:
        """The keys, each once, with whether there is a row."""
        there = self.list_all().select(*self.key).withColumn("found", F.lit(True))
        return keys.select(*self.key).distinct().join(there, self.key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def clear(self) -> None:
        self._write(self.list_all().limit(0))


def save_vectors(vectors: DataFrame, path: str, vector: str, dim: int, **known: str) -> None:
    """Vectors with all their other columns, and what is known of them as a whole (dim, and say the embedder's name): it
    is kept with the vector's column, so a loaded table can't be taken for one of another model. A vector of another
    length fails the write."""
    right = F.when(F.col(vector).isNull() | (F.size(vector) == dim), F.col(vector)).otherwise(F.raise_error(f"a vector doesn't have {dim} numbers").cast("array<float>"))
    vectors.withColumn(vector, right.cast("array<float>")).withMetadata(vector, {"dim": dim, **known}).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, vector: str, dim: int | None = None, **known: str) -> tuple[DataFrame, dict]:
    """(vectors, what is known of them); what is asked for must be so."""
    df = spark.read.parquet(path)
    meta = dict(df.schema[vector].metadata)
    for name, want in {**({} if dim is None else {"dim": dim}), **known}.items():
        if meta.get(name) != want:
            raise ValueError(f"{path} has {name} {meta.get(name)!r}, not {want!r}")
    return df, meta
