import math

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import urls as U


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_tokens(spark):
    assert one(spark, "Attention is All You Need", T.tokens) == ["attention", "need"]
    assert one(spark, "paged-attention; vLLM!", T.tokens) == ["paged", "attention", "vllm"]
    assert one(spark, "  \n ", T.tokens) == [] and one(spark, None, T.tokens) == []
    assert one(spark, "rag 2024", lambda c: T.tokens(c, drop_numeric=True)) == ["rag"]


def test_token_estimates(spark):
    for s in ("", "  ", "word", "a,b;c", "x" * 41, None):
        expect = 0 if not (s or "").strip() else max(len([1 for _ in __import__("re").finditer(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", s.strip())]), math.ceil(len(s.strip()) / 4), 1)
        assert one(spark, s, T.estimate_tokens) == expect


def test_half_even(spark):
    assert [one(spark, x, T.half_even, "double") for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_trim_text(spark):
    assert one(spark, "hello wide world", lambda c: T.trim_text(c, 13)) == "hello..."
    assert one(spark, "hello", lambda c: T.trim_text(c, 3)) == "..."
    assert one(spark, "hello", lambda c: T.trim_text(c, 0)) == "hello"
    assert one(spark, "helloworldwide", lambda c: T.trim_text(c, 8)) == "hello..."


def test_clock(spark):
    assert [one(spark, x, T.format_seconds, "double") for x in (0.0, 59.9, 3599.0, 3661.0)] == ["00:00", "00:59", "59:59", "01:01:01"]
    assert [one(spark, x, T.parse_clock) for x in ("1:02:03.5", "02:03", "7")] == [3723.5, 123.0, 7.0]


def test_labels_and_slugs(spark):
    assert one(spark, "youtube:q5IF2PHA5SA-c0001", T.short_label) == "c0001" and one(spark, "no-dash-chunk", T.short_label) == "no-dash-chunk"
    assert one(spark, "RAG / Retrieval", T.slug) == "rag-retrieval" and one(spark, "webpage:ab/Cd x", T.anchor_slug) == "webpage-ab-cd-x"
    assert one(spark, "a|b\nc", T.table_cell) == "a\\|b c"


def test_redact(spark):
    assert one(spark, "token: abc Bearer x.y sk-abcdefgh1", T.redact) == "token: [redacted] [redacted] [redacted]"


def test_keyword(spark):
    assert one(spark, "a rag index", lambda c: T.contains_keyword(c, "rag")) and not one(spark, "dragging", lambda c: T.contains_keyword(c, "rag"))


def test_normalize_url(spark):
    cases = {
        "HTTPS://WWW.Site.example/a/?utm_source=x&b=2&a=1&b=3#top": "https://site.example/a?b=2&b=3&a=1",
        "http://site.example/": "http://site.example/", "https://site.example/x?q=": "https://site.example/x", "inputs/a.pdf": None, None: None,
    }
    for url, expect in cases.items():
        assert one(spark, url, U.normalize_url) == expect


def test_video_and_time(spark):
    assert one(spark, "https://t.example/watch?v=abcdefghijk&t=670s", U.video_id) == "abcdefghijk"
    assert one(spark, "https://t.example/watch?v=abcdefghijk&t=670s", U.url_seconds) == 670
    assert one(spark, "https://t.example/embed/abcdefghijk?start=40", U.url_seconds) == 40
    assert one(spark, "https://t.example/watch?v=abcdefghijk&t=1h2m", U.url_seconds) is None


def test_sections(spark):
    text = "# Top\nintro\n## Summary\n\nIt works.\n### Detail\nmore\n## Next\nother\n# Summary\nlate"
    rows = spark.createDataFrame([(text, "summary"), (text, "Top"), (text, "none"), ("", "x"), (None, "x")], "t string, h string")
    got = [r.s for r in rows.select(T.section(F.col("t"), F.col("h")).alias("s")).collect()]
    assert got[0] == "It works.\n### Detail\nmore" and got[1].startswith("intro\n## Summary") and got[1].endswith("other") and got[2:] == ["", "", ""]
