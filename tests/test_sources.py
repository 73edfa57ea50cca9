import json

from pyspark.sql import functions as F

from lorewell.sources import readers, sinks
from lorewell.streaming import ledger


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    schema = "a INT"
    assert sorted(r.a for r in readers.read_json_lines(spark, str(p), schema).collect()) == [1, 2]
    try:
        readers.read_json_lines(spark, str(p), schema, strict=True).collect()
        raise AssertionError("a malformed line must fail a strict read")
    except Exception as e:
        assert "must fail" not in str(e)


def test_chunks_and_sinks(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"chunk_id": "c1", "resource_id": "r", "source_type": "pdf", "text": "x", "chunk_index": 0, "metadata": {"tags": ["a"], "extra": {"k": "v"}}}) + "\n{bad\n")
    rows = readers.read_chunks(spark, str(p))
    assert rows.count() == 1 and rows.first().metadata.extra == {"k": "v"}
    sinks.write_chunk_index(rows, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx/chunks")).first().chunk_id == "c1"
    cards = spark.createDataFrame([("q", "a", "t", "easy", "r")], "question string, answer string, topic string, difficulty string, resource_id string")
    sinks.write_flashcards(cards, str(tmp_path / "cards"))
    assert spark.read.csv(str(tmp_path / "cards"), header=True).first().question == "q"


def test_url_list(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_text("# c\n\nhttps://a.example\n https://b.example \n")
    assert readers.read_url_list(spark, str(p)).count() == 2
    assert tuple(readers.url_list_counts(spark, str(p)).first()) == (4, 1, 1, 2)


def test_markdown_folder_and_front_matter(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\ntitle: x\n---\n# Head line\nbody")
    (tmp_path / "index.md").write_text("# no")
    r = readers.read_markdown_folder(spark, str(tmp_path)).withColumn("f", readers.front_matter(F.col("content"))).collect()
    assert len(r) == 1 and r[0].title == "Head line" and r[0].f.head == "title: x" and r[0].f.body.startswith("# Head")


def test_transcript_segments(spark):
    t = spark.createDataFrame([("r", "[00:10] first\nplain\n\n[01:00:00.5] later\nmore")], "resource_id string, content string")
    got = [(x.id, x.start, x.end, x.text) for x in readers.transcript_segments(t).orderBy("id").collect()]
    assert got == [(0, 10.0, 18.0, "first"), (1, 3600.5, 3608.5, "later"), (2, 0.0, 30.0, "plain"), (3, 30.0, 60.0, "more")]


def test_page_metadata(spark):
    html = "<html><head><title>T | Site</title><meta property='og:title' content='OG'><link rel='canonical' href='https://x.example/'></head><body><h2>A</h2><h2>A</h2><h3>B</h3></body></html>"
    r = spark.createDataFrame([(html,)], "h string").select(readers.page_metadata(F.col("h")).alias("m"), readers.page_toc(F.col("h")).alias("t"), readers.looks_like_html(F.col("h")).alias("l")).first()
    assert (r.m.title, r.m.canonical, [(x.level, x.title) for x in r.t], r.l) == ("OG", "https://x.example/", [(2, "A"), (3, "B")], True)


def test_media_type(spark):
    r = spark.createDataFrame([("a/B.MP3",), ("c.mp4",), ("d.txt",)], "p string").select(readers.media_type(F.col("p")).alias("m")).collect()
    assert [x.m for x in r] == ["local_audio", "local_video", None]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/token_ledger.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in/log"))
    rows = ledger.usage_windows(ledger.read_log(spark, str(tmp_path / "in/log"), batch.schema), late="10000 days")
    out: list = []
    q = ledger.start(rows, str(tmp_path / "cp"), lambda df, _: out.append(df.collect()), mode="update")
    q.awaitTermination()
    latest = {(r.start, r.provider): r.total_tokens for part in out for r in part}
    assert sum(latest.values()) == batch.dropDuplicates(["ledger_pos"]).agg(F.sum("total_tokens")).first()[0]
