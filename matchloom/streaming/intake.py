"""Documents that arrive as a stream, processed by the batch plan one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_stream(spark: SparkSession, path: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files that appear under path go through plan; each micro-batch is a folder of out, written anew if the
    batch is repeated, so every document counts once. A document arrives whole, hence no state between batches."""
    stream = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
