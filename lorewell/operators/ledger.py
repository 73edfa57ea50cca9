"""Append-only ledgers: roll-ups, tails, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_rollup(ledger: DataFrame) -> DataFrame:
    """Entries, tokens and cost in total, by provider, by model and by source of usage, in one pass."""
    rows = ledger.select(*(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("provider", "model", "usage_source")), F.coalesce("total_tokens", F.lit(0)).alias("t"), F.coalesce("estimated_cost", F.lit(0.0)).alias("c"))
    sets = rows.groupingSets([[], [F.col("provider")], [F.col("model")], [F.col("usage_source")]], F.col("provider"), F.col("model"), F.col("usage_source"))
    return sets.agg(F.count("*").alias("entries"), F.sum("t").cast("bigint").alias("total_tokens"), F.round(F.sum("c"), 6).alias("estimated_cost"), F.grouping_id().cast("bigint").alias("level"))


def status_rollup(runs: DataFrame) -> DataFrame:
    """(kind, value, n): runs by status and by operation; null is 'unknown'."""
    rows = runs.select(F.coalesce(F.trim("status"), F.lit("unknown")).alias("status"), F.coalesce("operation", F.lit("unknown")).alias("operation"))
    both = rows.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")), F.struct(F.lit("operation").alias("kind"), F.col("operation").alias("value")))).alias("x")).select("x.*")
    return both.groupBy("kind", "value").agg(F.count("*").alias("n"))


def tail(log: DataFrame, n: int, *columns: str) -> DataFrame:
    """The last `n` rows of a log, newest first."""
    return log.select("ledger_pos", *columns).orderBy(F.desc("ledger_pos")).limit(n)


def provider_usage(rows: DataFrame, column: str) -> DataFrame:
    """Token counts from the usage object of a JSON column, under any of the names in use; booleans and text are none."""
    get = lambda k: F.coalesce(*(F.when(F.get_json_object(column, p).rlike("^[0-9]+$"), F.get_json_object(column, p).cast("bigint")) for p in (f"$.usage.{k}", f"$.{k}")))
    first = lambda *ks: F.coalesce(*(get(k) for k in ks))
    i, o = first("prompt_tokens", "input_tokens", "prompt_eval_count", "prompt_count"), first("completion_tokens", "output_tokens", "eval_count", "completion_count")
    total = F.coalesce(first("total_tokens", "total_count"), F.when(i.isNotNull() | o.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0))))
    return rows.withColumns({"input_tokens": i, "output_tokens": o, "total_tokens": total})


def daily_usage(ledger: DataFrame) -> DataFrame:
    """(day, entries, total_tokens) by the time of recording."""
    return ledger.groupBy(F.to_date("recorded_at").alias("day")).agg(F.count("*").alias("entries"), F.sum(F.coalesce("total_tokens", F.lit(0))).cast("bigint").alias("total_tokens"))


def running_usage(ledger: DataFrame) -> DataFrame:
    """Each resource's running total in the order of the log."""
    w = Window.partitionBy("resource_id").orderBy("ledger_pos").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.dropDuplicates(["ledger_pos"]).select("ledger_pos", "resource_id", F.sum(F.coalesce("total_tokens", F.lit(0))).over(w).cast("bigint").alias("running_tokens"))


def unlogged_runs(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(status, n): runs without a row in the token ledger."""
    return runs.join(ledger.select("run_id").distinct(), "run_id", "left_anti").groupBy(F.trim("status").alias("status")).agg(F.count("*").alias("n"))
