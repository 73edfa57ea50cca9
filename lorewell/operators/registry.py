"""The registry: scans, identity, first-wins and latest-wins merging, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import urls as U

#: Statuses of records that wait for processing.
PENDING = ["new", "raw_saved", "normalized", "failed_retryable"]


def scan(resources: DataFrame, status: str | None = None) -> DataFrame:
    """All records, newest first; ties by id."""
    rows = resources if status is None else resources.filter(F.col("status") == status)
    return rows.orderBy(F.desc("first_seen_at"), "id")


def pending(resources: DataFrame) -> DataFrame:
    return resources.filter(F.col("status").isin(PENDING))


def lookup(resources: DataFrame, ident: str) -> DataFrame:
    """The record with an id or canonical id; both filters reach the scan."""
    return resources.filter((F.col("id") == ident) | (F.col("canonical_id") == ident))


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in the full order; a null key is a key of its own row."""
    own = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", own).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def first_by(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """`columns` of the row of each key with the least `order`, by a hash aggregate instead of a sort of groups."""
    best = F.min_by(F.struct(*columns), F.col(order))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def insert_or_skip(resources: DataFrame, batch: DataFrame) -> DataFrame:
    """Records of a batch that the registry lacks by canonical id, the first of each."""
    fresh = batch.filter("canonical_id IS NOT NULL").join(resources.select("canonical_id").filter("canonical_id IS NOT NULL").distinct(), "canonical_id", "left_anti")
    return fresh.groupBy("canonical_id").agg(F.min("record_no").alias("record_no"))


def latest(rows: DataFrame, key: str, at: list[str], *columns: str) -> DataFrame:
    """`columns` of the last row of each key; an append-only log read as a table of states."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("r")).select(key, "r.*")


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def merge_seconds(lists: DataFrame, key: str, column: str) -> DataFrame:
    """The sorted union of the lists of each key, nulls left out."""
    return lists.select(key, F.explode(column).alias("s")).filter("s IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_set("s")).alias("seconds"))


def stale_reasons(provider: str, model: str, version: str) -> Column:
    """Why a record's note is out of date, in fixed order; [] if it is current."""
    own = T.provider_name(F.col("llm_provider"))
    mismatch = (F.when((own == "mock") & F.lit(provider != "mock"), F.lit("provider_mismatch:mock→real"))
                .when(own != provider, F.concat(F.lit("provider_mismatch:"), F.when(own == "", "none").otherwise(own), F.lit("→" + provider)))
                .when(F.col("llm_model").isNotNull() & (F.col("llm_model") != model), F.concat(F.lit("model_mismatch:"), F.col("llm_model"), F.lit("→" + model))))
    return F.array_compact(F.array(
        F.when(F.col("status") == "failed_retryable", "failed_retryable"),
        F.when(F.coalesce(F.col("generated_note_path"), F.lit("")) == "", "missing_note_path"),
        F.when(~F.col("prompt_version").eqNullSafe(version), F.concat(F.lit("prompt_version:"), F.coalesce("prompt_version", F.lit("none")))), mismatch))


def quality_gate(resources: DataFrame) -> DataFrame:
    """Share of titled records, number of untitled ones, and whether both are good enough."""
    untitled = T.replaceable_title(F.col("title")).cast("int")
    return resources.agg(F.count("*").alias("n"), F.sum(untitled).cast("bigint").alias("untitled"), F.round(1 - F.avg(untitled.cast("double")), 6).alias("coverage")).withColumn(
        "passed", (F.col("coverage") > 0.9) & (F.col("untitled") <= 2))


def identities(resources: DataFrame) -> DataFrame:
    return resources.select("id", U.canonical_id(F.col("source_type"), F.col("original_url"), F.col("content_hash")).alias("computed_id"), U.normalize_url(F.col("original_url")).alias("url"), U.domain(F.col("original_url")).alias("domain"))
