"""Annotation of files as they come: each batch is worked on once, and what is done already is skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def annotate_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str, fmt: str = "parquet", per_batch: int = 8) -> int:
    """Run over all files of the source that earlier runs have not seen, and return the number of batches of this run.

    A key is worked on once, in the batch it comes first in: the keys met are the stream's state, kept beside the checkpoint and read by
    key, so a batch costs what it holds and not what came before it. With very many keys the session is to keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass). A batch that is repeated after a failure overwrites the folder of its own number.
    """
    done = {"n": 0}

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done["n"] += 1

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(source).dropDuplicates([key])
        .writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return done["n"]


def windowed_counts(stream: DataFrame, time: str, by: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n): counts in windows of event time; rows later than the watermark are dropped."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
