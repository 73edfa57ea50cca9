from pyspark.sql import functions as F

from lorewell.llm import scans

SCHEMA = "chunk_id string, resource_id string, source_type string, title string, text string, citation_label string, chunk_index int, source_ref struct<page_start:int,page_end:int>, lines string"
CLEAN = "the reader keeps every sampler and the router loads a vector index before the dead-letter queue arrives with care"


def chunk(i, text, page=1, title="Notes on the vector index", label="page 1", rid="pdf:r"):
    return (f"c{i}", rid, "pdf", title, text, label, page - 1, (page, page), "x")


def test_found(spark):
    clean = [(f"w{i}", "web", "webpage", None, CLEAN, "l", i, None, "x") for i in range(40)]
    one = "Notes on the vector index\n\nthe reader keeps every sam-\npler and the roiiter loads a vect0r index\nbefore the dead-\nletter queue ■ arrives with care\n© Some Guild\n- 1 -"
    two = "NOTES ON THE VECTOR INDEX   2\nthe rea der keeps every sampler and\n42\nthe router loads a vector sam¬\n[2]"
    three = "pler before the queue arrives with care"
    rows = clean + [chunk(1, one, 1, label="Notes on the vect0r index, page 1"), chunk(1, one, 1, label="Notes on the vect0r index, page 1"), chunk(2, two, 2), chunk(3, three, 3), chunk(4, None, 4, label=None), chunk(5, "", 5), chunk(6, CLEAN, 6, title=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in scans.found_noise(df).collect()}
    assert got == {("c1", 3, "hyphen"), ("c1", 4, "glyph"), ("c1", 6, "glyph"), ("c1", 7, "header"), ("c1", 8, "page_no"), ("c1", 0, "label"), ("c2", 1, "header"), ("c2", 2, "glyph"), ("c2", 4, "hyphen"), ("c2", 5, "page_no")}
    assert scans.found_noise(df.limit(0)).count() == 0
    repaired = {r.chunk_id: r for r in scans.repaired(df).collect()}
    assert repaired["c1"].text == "Notes on the vector index\n\nthe reader keeps every sampler and the router loads a vector index before the dead-letter queue arrives with care"
    assert repaired["c1"].citation_label == "Notes on the vector index, page 1" and repaired["c6"].text == CLEAN and repaired["c2"].text.startswith("the reader keeps every sampler")


def test_page_numbers():
    for line in ("7", "- 7 -", "[7]", "Page 7", "p. 7", "page 7 of 90", "7 /", "· 7 ·", "— 7 —", "vii"):
        assert scans.page_number(line, 7, 8), line
    assert scans.page_number("l4", 14, 14) and not scans.page_number("42", 7, 8) and not scans.page_number("7", None, None) and not scans.page_number("7.1", 7, 7)
    assert scans.roman("xxiv") == 24 and scans.roman("iiii") is None


def test_running_lines():
    title = "Notes on the vector index"
    for line in ("NOTES ON THE VECTOR INDEX", "N O T E S   O N   T H E   V E C", "3   Notes on the vector index", "Notes on the vec…", "Notes on the vector index · A chapter", "© Any Guild", "Chapter 2: On shards"):
        assert scans.running(line, title, 3, 3, False), line
    for line in ("the reader keeps every sampler", "Related work", "Table 3", "memory block  79", "Notes on the vector store and its many uses"):
        assert not scans.running(line, title, 3, 3, False), line
    assert scans.near("abcdefgh", "abcdxfgh") and not scans.near("abcdefgh", "abxdxfgh") and not scans.near("", "a")


def test_anagram_differences(spark):
    w = spark.createDataFrame([("with",), ("vvith",), ("w1th",)], "w string").select("w", scans.anagram(F.col("w")).alias("v")).collect()
    v = {r.w: r.v for r in w}
    diff = {(r.seen, r.printed): r["diff"] for r in scans.confusions(spark).collect()}
    assert v["vvith"] + diff[("vv", "w")] == v["with"] == v["w1th"] + diff[("1", "i")]


def test_feet_that_come_again(spark):
    body = "the {0} keeps every sampler and\nthe {0} loads a vector index"
    words = ["reader", "router", "sampler", "shard", "index", "cohort", "ledger"]
    rows = [(f"c{i}", f"r{i}", "pdf", f"Title {'abcd'[i]}", body.format(words[i]) + "\nLeaflets of the Tidal Office", f"page {i}", i, (5, 5)) for i in range(4)]
    rows += [("d1", "s", "pdf", "Other", "Leaflets of the Harbour\n" + body.format(words[4]), "x", 1, (5, 5)), ("d2", "s", "pdf", "Other", "Leaflets of the Harbour\n" + body.format(words[5]), "x", 2, (6, 6)),
             ("d3", "s", "pdf", "Other", "Leaflets of the Quay\n" + body.format(words[6]) + "\n" + "x" * 120, "x", 90, (6, 6)), ("e1", "t", "pdf", "Twice", body.format("same"), "x", 1, (5, 5)), ("e2", "t", "pdf", "Twice", body.format("same"), "x", 2, (5, 5))]
    df = spark.createDataFrame(rows, "chunk_id string, resource_id string, source_type string, title string, text string, citation_label string, chunk_index int, source_ref struct<page_start:int,page_end:int>")
    heads = {(r.chunk_id, r.line_no) for r in scans.found_noise(df).collect() if r.kind == "header"}
    assert heads == {(f"c{i}", 3) for i in range(4)} | {("d1", 1), ("d2", 1)}


def test_copies_share_their_weight(spark):
    df = spark.createDataFrame([("c1", "one two"), ("c1", "one two"), ("c2", "two"), (None, "three"), (None, "three")], "chunk_id string, text string")
    assert {(r.word, r.n) for r in scans.lexicon(df).collect()} == {("one", 1), ("two", 2), ("three", 2)}
