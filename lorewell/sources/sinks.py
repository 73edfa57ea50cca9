"""Writers: ordered JSON Lines, Parquet tables of the indexes, public vocabularies, flashcards as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON Lines in a total order, so that two runs give the same bytes; files are cut by range of the order."""
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.mode("overwrite").json(path)


def write_chunk_index(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet by source type, sorted by resource and place, so that a resource is found by file statistics."""
    chunks.repartitionByRange("source_type", "resource_id", "chunk_index").sortWithinPartitions("source_type", "resource_id", "chunk_index", "chunk_id").write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/chunks")


def write_search_index(postings: DataFrame, lengths: DataFrame, path: str) -> None:
    """Postings sorted by term, so that a query reads the row groups of its terms only, and document lengths."""
    postings.repartitionByRange("term").sortWithinPartitions("term", F.desc("tf"), "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    postings.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").json(f"{path}/vocabulary")


def write_flashcards(cards: DataFrame, path: str, kind: str = "csv") -> None:
    """(question, answer, topic, difficulty, resource_id) with a header, or as JSON Lines."""
    rows = cards.select("question", "answer", "topic", "difficulty", "resource_id")
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True) if kind == "csv" else rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
