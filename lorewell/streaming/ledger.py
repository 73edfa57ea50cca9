"""Append-only ledgers as streams: windows of usage, and records that merge as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def usage_windows(log: DataFrame, span: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, provider, entries, total_tokens) by tumbling windows; rows later than `late` are left out, copies of a
    ledger row within that time count once."""
    rows = log.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["ledger_pos"])
    grouped = rows.groupBy(F.window("recorded_at", span).alias("w"), F.coalesce("provider", F.lit("unknown")).alias("provider"))
    return grouped.agg(F.count("*").alias("entries"), F.sum(F.coalesce("total_tokens", F.lit(0))).cast("bigint").alias("total_tokens")).select(F.col("w.start").alias("start"), "provider", "entries", "total_tokens")


def start(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there, `each` taking every micro-batch; a batch may come twice after a failure."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
