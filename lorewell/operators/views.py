"""Derived views: timeline, gaps, review buckets and queue, status report, search items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T


def learned_at():
    """When a resource was learned: consumed, else processed, else first seen."""
    return F.coalesce("user_consumed_at", "processed_at", "first_seen_at")


def timeline(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(period, label, entries, concepts): resources by month, with the topics (else tags) of the month sorted."""
    r = resources.join(assigned, "id").select(F.date_trunc("month", learned_at()).alias("period"), "id", F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.coalesce("tags", F.array().cast("array<string>"))).alias("c"))
    # concepts are counted apart from entries: an explode of both would count entries twice
    entries = r.groupBy("period").agg(F.count("*").alias("entries"))
    concepts = r.select("period", F.explode("c").alias("x")).groupBy("period").agg(F.array_join(F.sort_array(F.collect_set("x")), ",").alias("concepts"))
    return entries.join(concepts, "period", "left").select("period", F.date_format("period", "MMMM yyyy").alias("label"), "entries", F.coalesce("concepts", F.lit("")).alias("concepts"))


def _flag(name: str):
    return F.get_json_object("extra", f"$.{name}")


def gaps(resources: DataFrame) -> DataFrame:
    """(gap_type, n, first_id): what is missing from the registry."""
    kinds = F.array_compact(F.array(
        F.when(F.col("status") == "needs_manual_markdown", "needs_manual_markdown"), F.when(F.col("status") == "failed_retryable", "failed_retryable"),
        F.when(_flag("quality_status") == "weak", "weak_note"), F.when(F.coalesce(F.col("title"), F.lit("")) == "", "missing_title"), F.when(F.coalesce(F.col("author"), F.lit("")) == "", "missing_author")))
    return resources.select("id", F.explode(kinds).alias("gap_type")).groupBy("gap_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def buckets():
    """The review categories of a record."""
    return F.array_compact(F.array(
        F.when((F.col("status") == "failed_retryable") | (F.col("status") == "failed_permanent"), "failed"), F.when(_flag("quality_status") == "weak", "weak"),
        F.when(_flag("requires_human_review") == "true", "human_review"), F.when(F.coalesce(F.col("generated_note_path"), F.lit("")) == "", "missing_note"),
        F.when(F.col("status") == "needs_manual_markdown", "manual"), F.when(T.replaceable_title(F.col("title")), "untitled")))


def review_buckets(resources: DataFrame) -> DataFrame:
    return resources.select(F.explode(buckets()).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def review_queue(resources: DataFrame, n: int = 50) -> DataFrame:
    """The first `n` records to review: by the most urgent category, then id."""
    urgent = F.array_position(F.array(*map(F.lit, ("failed", "weak", "human_review", "missing_note", "manual", "untitled"))), F.get(buckets(), F.lit(0)))
    return resources.select("id", F.get(buckets(), F.lit(0)).alias("category"), urgent.cast("int").alias("priority")).filter("category IS NOT NULL").orderBy("priority", "id").limit(n)


def status_report(resources: DataFrame) -> DataFrame:
    """(kind, value, n): records by type, status and provider, in one pass."""
    rows = resources.select("source_type", "status", T.provider_name(F.col("llm_provider")).alias("provider"))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("source_type", "status", "provider"))))
    return rows.select(pairs.alias("x")).select("x.*").groupBy("kind", "value").agg(F.count("*").alias("n"))


def search_items(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(type, id, title, route) of resources and of topics in use."""
    items = resources.select(F.lit("resource").alias("type"), "id", T.display_title(F.col("title"), F.coalesce("canonical_id", "id")).alias("title"), T.route("/resources/", F.col("id")).alias("route"))
    used = assigned.select(F.explode("topics").alias("id")).distinct().select(F.lit("topic").alias("type"), "id", F.col("id").alias("title"), F.concat(F.lit("/topics/"), "id").alias("route"))
    return items.unionByName(used)
