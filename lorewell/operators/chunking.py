"""Cutting ordered lines, paragraphs, segments and pages into chunks: resettable folds as one higher-order expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

MAX_WORDS, TARGET_WORDS = 1000, 500


def _fold(items: Column, size, limit: int, target: int) -> Column:
    """Group numbers of items: a group ends before an item that would take it above `limit`, and once it has `target`."""
    zero = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("group"), F.lit(False).alias("some"))

    def step(acc: Column, x: Column) -> Column:
        n = size(x).cast("bigint")
        over = acc["some"] & (acc["held"] + n > limit)
        group = F.when(over, acc["group"] + 1).otherwise(acc["group"])
        held = F.when(over, n).otherwise(acc["held"] + n)
        full = held >= target
        return F.struct(F.concat(acc["groups"], F.array(group)).alias("groups"), F.when(full, F.lit(0).cast("bigint")).otherwise(held).alias("held"),
                        F.when(full, group + 1).otherwise(group).alias("group"), (~full).alias("some"))

    return F.aggregate(items, zero, step)["groups"]


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, content): Markdown headings begin sections; headings without a body are dropped unless last."""
    is_head = lambda line: F.regexp_replace(line, r"^\s+|\s+$", "").rlike(r"^#{1,6}\s+.+$")
    zero = F.struct(F.array().cast("array<struct<heading:string,lines:array<string>>>").alias("done"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, line: Column) -> Column:
        closed = F.when(F.size(acc["lines"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["heading"].alias("heading"), acc["lines"].alias("lines"))))).otherwise(acc["done"])
        title = F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^#+", ""))
        head = is_head(line)
        return F.struct(F.when(head, closed).otherwise(acc["done"]).alias("done"), F.when(head, title).otherwise(acc["heading"]).alias("heading"),
                        F.when(head, F.array().cast("array<string>")).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"))

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["heading"].alias("heading"), acc["lines"].alias("lines")))
        return F.when((F.size(acc["lines"]) > 0) | acc["heading"].isNotNull(), F.concat(acc["done"], last)).otherwise(acc["done"])

    folded = F.aggregate(F.split("text", "\n"), zero, step, finish)
    return docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(folded).alias("section_no", "s")).select(
        "doc_id", "section_no", "s.heading", F.regexp_replace(F.array_join("s.lines", "\n"), r"^\s+|\s+$", "").alias("content"))


def text_chunks(docs: DataFrame, limit: int = MAX_WORDS, target: int = TARGET_WORDS) -> DataFrame:
    """(doc_id, section_no, group_no, paragraphs, words, heading, text): paragraphs packed within their section."""
    paragraphs = F.filter(F.transform(F.split("content", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = sections(docs).select("doc_id", "section_no", "heading", paragraphs.alias("p"))
    groups = rows.withColumn("g", _fold(F.col("p"), T.word_count, limit, target))
    numbers = F.array_distinct("g")
    own = lambda g: F.filter("p", lambda p, i: F.get(F.col("g"), i) == g)
    each = groups.select("doc_id", "section_no", "heading", F.explode(F.transform(numbers, lambda g: F.struct(g.alias("group_no"), own(g).alias("p")))).alias("x"))
    words = F.aggregate("x.p", F.lit(0).cast("bigint"), lambda n, p: n + T.word_count(p).cast("bigint"))
    return each.select("doc_id", "section_no", "x.group_no", F.size("x.p").cast("bigint").alias("paragraphs"), words.alias("words"), "heading", F.array_join("x.p", "\n\n").alias("text"))


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def line_chunks(docs: DataFrame, target: int = 100) -> DataFrame:
    """(doc_id, group_no, lines, words, text): lines packed until a group has `target` words; documents are read one after another."""
    src = docs.filter("text IS NOT NULL").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                lines, first, held, group = text.split("\n"), 0, 0, 0
                for i, line in enumerate(lines):
                    held += len(_WORD.findall(line))
                    if held >= target or i == len(lines) - 1:
                        out.append((doc, group, i + 1 - first, held, "\n".join(lines[first:i + 1])))
                        first, held, group = i + 1, 0, group + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "group_no", "lines", "words", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, group_no int, lines bigint, words bigint, text string")


def _streamed(rows: DataFrame, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], int]) -> DataFrame:
    """`rows` with the `group_no` that a fold over each resource gives; a resource's rows stream through one task in order.

    Rows are few numbers each and only the fold's state is held, never a resource's rows; texts are joined to the groups
    afterwards.
    """
    src = rows.repartition("resource_id").sortWithinPartitions("resource_id", *order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, begin()
        for b in batches:
            groups = []
            for r in b.to_pylist():
                if r["resource_id"] != now:
                    now, state = r["resource_id"], begin()
                groups.append(step(state, r))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(groups, pa.int32())], [*b.schema.names, "group_no"])

    return src.mapInArrow(run, f"{kinds}, group_no int")


def page_packs(pages: DataFrame, limit: int = 4000, target: int = 2000) -> DataFrame:
    """(resource_id, pack_no, chunk_id, page_start, page_end, chars, label, text) of pages (resource_id, page, text) in page order.

    Blank pages are left out, a page above `limit` stands alone. The id names the first page, the label the pages.
    """
    own = pages.filter("resource_id IS NOT NULL AND page IS NOT NULL").filter(~F.col("text").rlike(r"^\s*$"))

    def step(s: dict, r: dict) -> int:
        big = r["n"] > limit
        if s["some"] and (big or s["held"] + r["n"] > limit or s["held"] >= target):
            s["group"], s["held"] = s["group"] + 1, 0
        group = s["group"]
        s["held"] += r["n"]
        s["some"] = not big
        if big:
            s["group"], s["held"] = group + 1, 0
        return group

    numbered = own.select("resource_id", "page", F.length("text").alias("n"), F.xxhash64("text").alias("mark"))
    grouped = _streamed(numbered, ["page", "n", "mark"], lambda: {"held": 0, "group": 0, "some": False}, step)
    texts = grouped.dropDuplicates(["resource_id", "page", "mark"]).join(own.select("resource_id", "page", F.xxhash64("text").alias("mark"), "text").dropDuplicates(["resource_id", "page", "mark"]), ["resource_id", "page", "mark"])
    packs = texts.groupBy("resource_id", F.col("group_no").alias("pack_no")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("n").cast("bigint").alias("chars"), F.sort_array(F.collect_list(F.struct("page", "mark", "text"))).alias("t"))
    pages_of = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), F.col("page_start"))).otherwise(F.concat(F.lit("pp. "), F.col("page_start"), F.lit("–"), F.col("page_end")))
    return packs.select("resource_id", "pack_no", F.concat("resource_id", F.lit("-p"), F.lpad(F.col("page_start").cast("string"), 4, "0")).alias("chunk_id"), "page_start", "page_end", "chars", pages_of.alias("label"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def segment_chunks(segments: DataFrame, words: int = 140, seconds: float = 90.0) -> DataFrame:
    """(resource_id, chunk_no, chunk_id, start, end, segments, label, text) of segments (resource_id, start, end, text): a chunk
    ends with the segment that brings it to `words` words or `seconds` seconds. Blank segments are left out."""
    own = segments.filter("resource_id IS NOT NULL").filter(~F.col("text").rlike(r"^\s*$"))

    def step(s: dict, r: dict) -> int:
        group = s["group"]
        s["held"] += r["n"]
        s["since"] = r["start"] if s["since"] is None else s["since"]
        if s["held"] >= words or r["end"] - s["since"] >= seconds:
            s["held"], s["since"], s["group"] = 0, None, group + 1
        return group

    numbered = own.select("resource_id", "start", "end", T.word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("mark"))
    grouped = _streamed(numbered, ["start", "end", "n", "mark"], lambda: {"held": 0, "since": None, "group": 0}, step)
    counted = grouped.groupBy("resource_id", "group_no", "start", "end", "mark").agg(F.count("*").alias("copies"))
    texts = counted.join(own.select("resource_id", "start", "end", F.xxhash64("text").alias("mark"), "text").distinct(), ["resource_id", "start", "end", "mark"])
    packs = texts.groupBy("resource_id", F.col("group_no").alias("chunk_no")).agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.sum("copies").alias("segments"), F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("t"))
    return packs.select("resource_id", "chunk_no", F.concat("resource_id", F.lit("-c"), F.lpad(F.col("chunk_no").cast("string"), 4, "0")).alias("chunk_id"), "start", "end", "segments",
                        T.format_seconds(F.col("start")).alias("label"), F.array_join(F.transform("t", lambda x: F.trim(x["text"])), " ").alias("text"))


def projection(chunks: DataFrame) -> DataFrame:
    """The derived columns of the unified chunk index."""
    return chunks.select("chunk_id", F.length("text").cast("bigint").alias("char_count"), T.word_count(F.col("text")).alias("word_count"), T.token_estimate(F.col("text")).alias("token_estimate"),
                         F.sha2("text", 256).alias("content_hash"), T.route("/resources/", F.col("resource_id")).alias("resource_route"), T.short_label(F.col("chunk_id")).alias("short_label")).distinct()


def manifest(chunks: DataFrame) -> DataFrame:
    """(resource_id, chunks, first_chunk, last_chunk): by place in the resource; repeated rows count once."""
    once = chunks.select("chunk_id", "resource_id", "chunk_index").distinct()
    at = F.struct("chunk_index", "chunk_id")
    return once.groupBy("resource_id").agg(F.count("*").alias("chunks"), F.min_by("chunk_id", at).alias("first_chunk"), F.max_by("chunk_id", at).alias("last_chunk"))
