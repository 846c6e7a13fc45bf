"""Session helpers shared by operators: checkpoint folder, bounded broadcasts, table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup side may have to be broadcast; above it the join is left to shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core from which on a table's files have row groups enough for all of them.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, if it is small and comes from fewer files: one row group
    would else leave all further work on its rows to one task. Tables beyond SPREAD_BYTES for each core, and those of many
    files, are not shuffled; the paths are listed for small tables only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * SPREAD_BYTES:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    The cluster names it in spark.checkpoint.dir; only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="matchloom-ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df has at most `rows` rows (counted, at most rows + 1 read), else df unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
