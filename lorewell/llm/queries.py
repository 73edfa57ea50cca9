"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import bpe, history, lookalike, mainbody, packing, pieces, scans, turns
from lorewell.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found_noise(table(spark, d, "chunks"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(spark, d, "chunks"), table(spark, d, "size_limits"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks"), table(spark, d, "size_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.found_turns(table(spark, d, "chunks"), table(spark, d, "speakers"))


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.spoken_turns(table(spark, d, "chunks"), table(spark, d, "speakers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated(table(spark, d, "resources"), table(spark, d, "intake"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate(table(spark, d, "chunks"), table(spark, d, "resources"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_bodies(table(spark, d, "chunks"), table(spark, d, "resources"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), packing.container_capacity(table(spark, d, "size_limits")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looks(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize_looks(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_pieces, p3_found, p3_turns, p4_found, p5_found, p5_bodies, p6_ids, p7_containers, p8_found, p8_forms)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT c.chunk_id FROM chunks c JOIN size_limits s ON s.item_kind = c.source_type AND s.unit = 'char' WHERE length(c.text) > s.max_size",
    }
