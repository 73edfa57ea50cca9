"""Integrity checks: rows of (severity, code, n), never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _issue(rows: DataFrame, severity: str, code: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "n")


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """Row checks in one pass over the chunks, duplicates in one aggregate; only what occurs."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    codes = F.array_compact(F.array(
        F.when(blank("text"), F.struct(F.lit("error").alias("severity"), F.lit("empty_text").alias("code"))), F.when(blank("citation_label"), F.struct(F.lit("error").alias("severity"), F.lit("missing_label").alias("code"))),
        F.when(blank("resource_id"), F.struct(F.lit("error").alias("severity"), F.lit("missing_resource").alias("code"))), F.when(F.col("content_hash").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("missing_hash").alias("code"))),
        F.when(F.col("char_count").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("missing_char_count").alias("code"))),
        F.when((F.col("start_time").isNotNull()) & (F.col("end_time") < F.col("start_time")), F.struct(F.lit("warning").alias("severity"), F.lit("end_before_start").alias("code")))))
    rows = chunks.select(F.explode(codes).alias("x")).select("x.*").groupBy("severity", "code").agg(F.count("*").alias("n"))
    return rows.unionByName(_issue(chunks.groupBy("chunk_id").agg(F.count("*").alias("c")).filter("c > 1"), "error", "duplicate_chunk"))


def index_issues(postings: DataFrame, meta: DataFrame) -> DataFrame:
    """Postings of unknown chunks and negative counts."""
    orphans = postings.join(meta.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return _issue(orphans, "error", "posting_without_chunk").unionByName(_issue(postings.filter("tf < 0"), "error", "negative_count"))


def vector_issues(vectors: DataFrame, dimension: int) -> DataFrame:
    """Dimensions out of range and vectors that are not of unit length."""
    norms = vectors.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return _issue(vectors.filter((F.col("dim") < 0) | (F.col("dim") >= dimension)), "error", "dimension_range").unionByName(_issue(norms.filter(F.abs(F.col("s") - 1) > 1e-6), "error", "not_unit_length"))
