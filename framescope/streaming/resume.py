"""Work that can be stopped and taken up again: batches written once, totals that go on, and what is still to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, folder: str, keys: list[str], failed: Column, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write a stream's rows to ``folder/rows`` and running totals by ``keys`` to ``folder/totals``, a folder for each batch.

    A batch that is run again after a failure replaces its own folders, and its totals add up from those of the batch
    before, so rows and totals are those of one undisturbed run. ``then`` is called with each batch between the two.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/rows/batch={number}")
        if then:
            then(rows, number)
        own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"))
        if number:
            before = batch.sparkSession.read.schema(own.schema).parquet(f"{folder}/totals/batch={number - 1}")
            own = own.unionByName(before).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
        own.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def totals(spark, folder: str) -> DataFrame:
    """The totals of the last batch."""
    every = spark.read.parquet(f"{folder}/totals")
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def rows(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def unfinished(wanted: DataFrame, history: DataFrame, key: str, success: Column | None = None) -> DataFrame:
    """Wanted keys that the history doesn't hold as done: with a row for which ``success`` is true, or else with any row."""
    done = history if success is None else history.where(success)
    return wanted.join(done.select(key).distinct(), key, "left_anti")
