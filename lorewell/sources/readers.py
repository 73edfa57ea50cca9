"""Readers: JSON Lines strict and lenient, front matter, transcript lines, URL lists, Markdown folders, media types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

CHUNK_SCHEMA = """chunk_id STRING, resource_id STRING, source_type STRING, title STRING, text STRING, citation_label STRING,
source_ref STRUCT<kind: STRING, page_start: INT, page_end: INT, file_path: STRING, start_seconds: DOUBLE, end_seconds: DOUBLE, url: STRING, source_url: STRING, section_title: STRING, paragraph_index: INT>,
start_time DOUBLE, end_time DOUBLE, resource_route STRING, char_count BIGINT, word_count BIGINT, token_estimate BIGINT, chunk_index INT, content_hash STRING,
metadata STRUCT<source_url: STRING, tags: ARRAY<STRING>, topics: ARRAY<STRING>, extraction_method: STRING, extraction_warnings: ARRAY<STRING>, extra: MAP<STRING, STRING>>"""

# Media types by file extension.
MEDIA = {"mp3": "local_audio", "wav": "local_audio", "m4a": "local_audio", "flac": "local_audio", "ogg": "local_audio", "mp4": "local_video", "mkv": "local_video", "mov": "local_video", "webm": "local_video", "avi": "local_video"}


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON Lines file; a malformed line is left out, or with `strict` fails the read."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    rows = spark.read.schema(f"{schema}, _bad STRING").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def read_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """The chunk index from several JSON Lines files; columns that a file lacks are null."""
    out = read_json_lines(spark, paths[0], CHUNK_SCHEMA)
    for p in paths[1:]:
        out = out.unionByName(read_json_lines(spark, p, CHUNK_SCHEMA), allowMissingColumns=True)
    return out.filter("chunk_id IS NOT NULL")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")


def url_list_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, blank lines, comments, addresses."""
    v = F.trim("value")
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(v == "").alias("blank"), F.count_if(v.startswith("#")).alias("comments"), F.count_if((v != "") & ~v.startswith("#")).alias("urls"))


def read_markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, content): one row for each Markdown file but index.md; the title is the first heading of level one."""
    rows = spark.read.text(f"{path}/*.md", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("value").alias("content"))
    return rows.filter("file <> 'index.md'").select("file", F.nullif(F.regexp_extract("content", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit("")).alias("title"), "content")


def front_matter(text: Column) -> Column:
    """struct(head, body): the block between two lines of --- at the start, and what follows; head is null without one."""
    m = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"
    return F.struct(F.when(text.rlike(m), F.regexp_extract(text, m, 1)).alias("head"), F.when(text.rlike(m), F.regexp_extract(text, m, 2)).otherwise(text).alias("body"))


def media_type(path: Column) -> Column:
    """local_audio or local_video by extension; null for other files."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


STAMP = r"^\s*\[((?:\d{1,2}:)?\d{1,2}:\d{2}(?:\.\d+)?)\]\s*(.+?)\s*$"


def transcript_segments(files: DataFrame) -> DataFrame:
    """(resource_id, id, start, end, text) of transcripts (resource_id, content): `[mm:ss] text` lines last eight seconds;
    lines without a stamp come after them, in slots of thirty seconds."""
    lines = files.select("resource_id", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("pos", "line")).filter(~F.col("line").rlike(r"^\s*$"))
    split = lines.select("resource_id", "pos", F.col("line").rlike(STAMP).alias("timed"), F.regexp_extract("line", STAMP, 1).alias("ts"), F.when(F.col("line").rlike(STAMP), F.regexp_extract("line", STAMP, 2)).otherwise(F.trim("line")).alias("text"))
    # one file's lines are numbered within the file; files are what bounds this window
    n = F.row_number().over(Window.partitionBy("resource_id", "timed").orderBy("pos")) - 1
    t = F.count_if("timed").over(Window.partitionBy("resource_id"))
    numbered = split.withColumn("n", n).withColumn("t", t)
    start = F.when(F.col("timed"), T.parse_clock(F.col("ts"))).otherwise(F.col("n") * 30.0)
    return numbered.select("resource_id", F.when(F.col("timed"), F.col("n")).otherwise(F.col("n") + F.col("t")).cast("int").alias("id"), start.alias("start"), (start + F.when(F.col("timed"), 8.0).otherwise(30.0)).alias("end"), "text")


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(F.trim(text), 1, 1000))
    return head.contains("<html") | head.contains("<!doctype html") | head.contains("<body")


def page_metadata(html: Column) -> Column:
    """struct(title, description, canonical): Open Graph, then Twitter, then plain tags, then the first heading."""
    def meta(name: str) -> Column:
        a = rf"(?is)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']"
        b = rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:property|name)=[\"']{name}[\"']"
        return F.coalesce(F.nullif(F.trim(F.regexp_extract(html, a, 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(html, b, 1)), F.lit("")))

    def tag(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"<[^>]+>", "")), F.lit(""))

    title = F.coalesce(meta("og:title"), meta("twitter:title"), tag("title"), tag("h1"))
    return F.struct(title.alias("title"), F.coalesce(meta("og:description"), meta("twitter:description"), meta("description")).alias("description"),
                    F.nullif(F.regexp_extract(html, r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']*)[\"']", 1), F.lit("")).alias("canonical"))


def page_toc(html: Column) -> Column:
    """array of struct(level, title) of headings one to three, each once."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>.*?</h[1-3]>"), 0)
    return F.array_distinct(F.transform(found, lambda h: F.struct(F.regexp_extract(h, r"(?i)^<h([1-3])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, r"<[^>]+>", "")).alias("title"))))
