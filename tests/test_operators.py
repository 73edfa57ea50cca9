import pytest
from pyspark.sql import functions as F

from lorewell.operators import chunking, dense, graph, ledger, notes, registry, retrieval, search, topics
from lorewell.plans import catalogue


def test_latest_and_first(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 5, "q")], "k string, n int, v string")
    assert {tuple(r) for r in registry.latest(rows, "k", ["n"], "v").collect()} == {("a", "z"), (None, "q")}
    assert {tuple(r) for r in registry.first_by(rows, "k", "n", "v").collect()} == {("a", "x")}
    assert {r.v for r in registry.keep_first(rows, "k", "n").collect()} == {"x", "q"}


def test_insert_or_skip(spark):
    old = spark.createDataFrame([("c1",)], "canonical_id string")
    new = spark.createDataFrame([(5, "c1"), (6, "c2"), (7, "c2"), (8, None)], "record_no bigint, canonical_id string")
    assert [tuple(r) for r in registry.insert_or_skip(old, new).collect()] == [("c2", 6)]
    assert registry.insert_or_skip(old, new.limit(0)).count() == 0


def brute_fold(sizes, limit, target):
    out, group, held, some = [], 0, 0, False
    for n in sizes:
        if some and held + n > limit:
            group, held = group + 1, 0
        out.append(group)
        held, some = held + n, True
        if held >= target:
            group, held, some = group + 1, 0, False
    return out


def test_text_chunks_fold(spark):
    sizes = [3, 9, 2, 12, 1, 1, 1, 30, 4, 4]
    text = "\n\n".join(" ".join(["w"] * n) for n in sizes)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.group_no: r.paragraphs for r in chunking.text_chunks(docs, limit=14, target=10).filter("doc_id = 1").collect()}
    groups = brute_fold(sizes, 14, 10)
    assert got == {g: groups.count(g) for g in set(groups)}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nbody\n## Empty\n# B\nlast\n# End")], "doc_id bigint, text string")
    got = [(r.heading, r.content) for r in chunking.sections(docs).orderBy("section_no").collect()]
    assert got == [(None, "intro"), ("A", "body"), ("B", "last"), ("End", "")]


def test_page_packs(spark):
    pages = spark.createDataFrame([("r", 1, "x" * 1500), ("r", 2, "x" * 1500), ("r", 3, "  "), ("r", 4, "x" * 5000), ("r", 5, "x" * 100)], "resource_id string, page int, text string")
    got = [(r.page_start, r.page_end, r.chars) for r in chunking.page_packs(pages).orderBy("pack_no").collect()]
    assert got == [(1, 2, 3000), (4, 4, 5000), (5, 5, 100)]


def test_segment_chunks(spark):
    seg = spark.createDataFrame([("r", 0.0, 40.0, "a b"), ("r", 40.0, 95.0, "c"), ("r", 95.0, 100.0, " "), ("r", 100.0, 110.0, "w " * 150), ("r", 110.0, 111.0, "end")], "resource_id string, start double, end double, text string")
    got = [(r.start, r.end, r.segments) for r in chunking.segment_chunks(seg).orderBy("chunk_no").collect()]
    assert got == [(0.0, 95.0, 2), (100.0, 110.0, 1), (110.0, 111.0, 1)]


def chunks(spark, rows):
    return spark.createDataFrame([(i, "r" + i[-1], "pdf", t, None, None) for i, t in rows], "chunk_id string, resource_id string, source_type string, text string, title string, citation_label string")


def test_bm25_ranks_and_ties(spark):
    docs = search.corpus(chunks(spark, [("c1", "vector index"), ("c2", "vector index"), ("c3", "other words"), ("c4", None), ("c1", "vector index")]))
    q = spark.createDataFrame([(1, "Vector?"), (2, "the of")], "query_id bigint, query string")
    got = [(r.query_id, r["rank"], r.chunk_id) for r in search.top(search.bm25_scores(docs, q), 10, "chunk_id").collect()]
    assert sorted(got) == [(1, 1, "c1"), (1, 2, "c2")]


def test_vectors_have_unit_length_and_find_themselves(spark):
    docs = search.corpus(chunks(spark, [("c1", "alpha beta gamma"), ("c2", "delta epsilon"), ("c3", "alpha delta")]))
    for v, key in ((search.tfidf_vectors(docs), "term"), (search.hashed_vectors(docs, 64), "dim")):
        assert all(abs(r.s - 1) < 1e-9 for r in v.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()) and key in v.columns
    q = spark.createDataFrame([(1, "alpha beta gamma")], "query_id bigint, query string")
    assert search.top(search.cosine_scores(docs, q), 1, "chunk_id").first().chunk_id == "c1"


def test_dense_top(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [2.0, 0.2])], "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, r["rank"]) for r in dense.top_cosine(rows, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (4, 2)]
    assert dense.top_cosine(rows.limit(0), 2).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "query_id bigint, rank int, resource_id string")
    expected = spark.createDataFrame([(1, "b"), (1, "z"), (2, "a")], "query_id bigint, resource_id string")
    got = {(r.query_id, r.k): (r.recall, r.precision, r.hit, r.mrr) for r in retrieval.metrics(ranked, expected, [1, 3]).collect()}
    assert got == {(1, 1): (0.0, 0.0, 0.0, 0.0), (1, 3): (0.5, 0.333333, 1.0, 0.5), (2, 1): (0.0,) * 4, (2, 3): (0.0,) * 4}


def test_sentences(spark):
    t = spark.createDataFrame([("One two. Three four! five? Six.",)], "t string")
    assert t.select(retrieval.sentences(F.col("t")).alias("s")).first().s == ["One two.", "Three four! five?", "Six."]


def test_paths(spark):
    e = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("u", "a", "c"), ("t", "x", "y")], "type string, source string, target string")
    walk = lambda *a, **k: [r.node_id for r in graph.shortest_path(e, *a, **k).orderBy("step").collect()]
    assert walk("a", "c") == ["a", "c"] and walk("a", "c", ["t"]) == ["a", "b", "c"] and walk("a", "a") == ["a"] and walk("a", "y") == []


def test_relationship_classes_equal_pairs(spark):
    res = spark.createDataFrame([("r1", "Intro to rag", "pdf"), ("r2", "Advanced rag", "pdf"), ("r3", "Cooking", "webpage")], "id string, title string, source_type string").withColumn("canonical_id", F.col("id"))
    res = res.withColumns({"tags": F.array().cast("array<string>"), "description": F.lit(None).cast("string"), "notes_from_user": F.lit(None).cast("string"), "author": F.lit(None).cast("string")})
    rel = graph.class_relationships(graph.relationship_classes(res, topics.resource_topics(res))).filter("prerequisite").collect()
    assert len(rel) == 1 and rel[0].shared == 1 and rel[0].score == 2.5


def test_usage(spark):
    rows = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "completion_tokens": "4"}}',), ('{"input_tokens": true}',), (None,)], "u string")
    assert [(r.input_tokens, r.output_tokens, r.total_tokens) for r in ledger.provider_usage(rows, "u").collect()] == [(3, 4, 7), (None, None, None), (None, None, None)]


def test_rollup_of_nothing(spark):
    empty = spark.createDataFrame([], "provider string, model string, usage_source string, total_tokens bigint, estimated_cost double")
    assert ledger.token_rollup(empty).filter("level < 7").count() == 0


def test_stale_reasons(spark):
    r = spark.createDataFrame([("failed_retryable", None, "v1", "mock", "m"), ("processed", "p", "v5", "Cloud-B", "wide-2")], "status string, generated_note_path string, prompt_version string, llm_provider string, llm_model string")
    got = [x.r for x in r.select(registry.stale_reasons("cloud_b", "wide-2", "v5").alias("r")).collect()]
    assert got[0] == ["failed_retryable", "missing_note_path", "prompt_version:v1", "provider_mismatch:mock→real"] and got[1] == []


def test_context_pack_holds_whole_texts(spark):
    long = "Nothing here. " * 60 + "The cache is warm."
    docs = spark.createDataFrame([("c1", "r1", long)], "chunk_id string, resource_id string, text string")
    ranked = spark.createDataFrame([(1, 1, "c1")], "query_id long, rank int, chunk_id string")
    asked = spark.createDataFrame([(1, "cache")], "query_id long, query string")
    whole, part = retrieval.context_pack(ranked, docs, 0), retrieval.context_pack(ranked, docs, 600)
    assert [(r.text, r.truncated) for r in whole.collect()] == [(long, False)]
    assert [(len(r.text) <= 600, r.truncated) for r in part.collect()] == [(True, True)]
    assert [r.answer for r in retrieval.extract_answers(whole, asked).collect()] == ["The cache is warm. [cite:1]"]
    assert [r.answer for r in retrieval.extract_answers(part, asked).collect()] == ["Nothing here. [cite:1] Nothing here. [cite:1] Nothing here. [cite:1]"]


def test_pack_query_cuts_no_text(spark, sf):
    pack = catalogue.context_pack_chunks(spark, sf)
    full = spark.read.parquet(f"{sf}/chunks.parquet").selectExpr("chunk_id", "coalesce(text, '') AS full").distinct()
    assert pack.join(full, "chunk_id", "left_anti").count() == 0 and pack.join(full, "chunk_id").filter("text = full").select("query_id", "rank").distinct().count() == pack.count()
    assert pack.filter("truncated").count() == 0 and pack.selectExpr("max(rank)").first()[0] == 10


def test_concepts_of_prose_and_repeated_bullets(spark):
    said = "\n".join(["- Alpha: one", "* ALPHA: two"] * 15 + ["- Beta: three"])
    rows = spark.createDataFrame([(1, said), (2, "We speak of embeddings and fine-tuning."), (3, "\n".join(f"- name {i}" for i in range(25)) + "\nAn LLM."), (4, None)], "doc_id long, text string")
    got = {r.slug: (r.name, r.notes) for r in notes.concepts(rows).collect()}
    assert {k: v for k, v in got.items() if not k.startswith("name-")} == {"alpha": ("Alpha", 1), "beta": ("Beta", 1), "embeddings": ("Embeddings", 1), "fine-tuning": ("Fine-tuning", 1)}
    assert sum(k.startswith("name-") for k in got) == 20


def test_index_is_read_and_checked(spark, tmp_path):
    docs = search.corpus(chunks(spark, [("c1", "vector index"), ("c2", "vector store store"), ("c3", "other words")]))
    q = spark.createDataFrame([(1, "vector store")], "query_id bigint, query string")
    search.Index.build(docs, str(tmp_path / "i"))
    index = search.Index(spark, str(tmp_path / "i"))
    assert [r.chunk_id for r in search.top(index.bm25(q), 5, "chunk_id").orderBy("rank").collect()] == ["c2", "c1"]
    index.stats.withColumn("version", F.lit("other")).coalesce(1).write.parquet(str(tmp_path / "s"))
    import shutil

    shutil.rmtree(tmp_path / "i" / "stats")
    shutil.move(tmp_path / "s", tmp_path / "i" / "stats")
    with pytest.raises(ValueError):
        search.Index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        retrieval.retrieve(index, q, "dense")
    empty = search.Index.build(docs.limit(0), str(tmp_path / "e"))
    assert empty.bm25(q).count() == 0 and empty.cosine(q).count() == 0


def test_filters_apply_after_scoring(spark, tmp_path):
    rows = chunks(spark, [("c1", "vector index"), ("c2", "vector store"), ("c3", "other words")])
    index = search.Index.build(search.corpus(rows.withColumn("source_type", F.when(F.col("chunk_id") == "c2", "webpage").otherwise("pdf"))), str(tmp_path / "f"))
    q = spark.createDataFrame([(1, "vector")], "query_id bigint, query string")
    every = {r.chunk_id: r.score for r in retrieval.retrieve(index, q, "bm25").collect()}
    assert [(r.chunk_id, r.score) for r in retrieval.retrieve(index, q, "bm25", source_types=["webpage"]).collect()] == [("c2", every["c2"])]
    assert [r.chunk_id for r in retrieval.retrieve(index, q, "hybrid", resource_ids=["r1"]).collect()] == ["c1"]


def test_hashed_search_against_brute_force(spark):
    import hashlib
    import math

    texts = {"c1": "alpha beta gamma", "c2": "alpha alpha delta", "c3": "epsilon"}
    docs = search.corpus(chunks(spark, list(texts.items())))
    place = lambda t: ((v := int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")) % 64, -1.0 if v >> 63 else 1.0)
    weight = lambda t: math.log((3 - (n := sum(t in x.split() for x in texts.values())) + 0.5) / (n + 0.5) + 1)

    def vector(counts):
        v = {}
        for t, n in counts.items():
            d, s = place(t)
            v[d] = v.get(d, 0.0) + n * weight(t) * s
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {d: x / norm for d, x in v.items()}

    asked = vector({"alpha": 1, "delta": 1})
    true = {c: round(sum(w * asked.get(d, 0.0) for d, w in vector({t: x.split().count(t) for t in x.split()}).items()), 6) for c, x in texts.items()}
    q = spark.createDataFrame([(1, "Alpha delta, alpha")], "query_id bigint, query string")
    assert {r.chunk_id: r.score for r in search.hashed_scores(docs, q, 64).collect()} == {c: s for c, s in true.items() if s > 0}


def test_long_paths_and_bad_answers(spark):
    e = spark.createDataFrame([("x", f"n{i:02d}", f"n{i + 1:02d}") for i in range(23)], "type string, source string, target string")
    assert graph.shortest_path(e, "n00", "n23").count() == 24 and graph.shortest_path(e, "n00", "n23", most=20).count() == 0
    pack = spark.createDataFrame([(1, 1, "[cite:1]", "c1", "r1", "t")], "query_id long, rank int, citation_label string, chunk_id string, resource_id string, text string")
    said = spark.createDataFrame([(1, "See [cite:9].", ["[cite:9]"], ["c7"], ["r9"], False)], "query_id long, body string, labels array<string>, used_chunks array<string>, used_sources array<string>, is_mock boolean")
    asked = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, query string")
    got = {(r.query_id, r.check): (r.passed, r.score) for r in retrieval.answer_checks(said, pack, asked).collect()}
    assert [got[1, c][0] for c in retrieval.CHECKS] == [True, False, False, True, False, False, True, False, False]
    assert all(got[2, c] == (True, 1.0) for c in retrieval.CHECKS)


def test_links_outside_code(spark):
    said = "See [source: a:x-c0001] and [source:b:y-c0002].\n```\n[source: a:x-c0001]\n```\nAgain [source: a:x-c0001]."
    rows = spark.createDataFrame([(1, said), (2, "none"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([("a:x-c0001",), ("a:x-c0001",)], "chunk_id string")
    link = "[c0001](#a-x-c0001)<!-- a:x-c0001 -->"
    assert [r.text for r in notes.linked_citations(rows, known).collect()] == [f"See {link} and [missing source chunk: b:y-c0002].\n```\n[source: a:x-c0001]\n```\nAgain {link}."]


def test_chunks_have_ids_and_texts(spark):
    p = spark.createDataFrame([("r", 1, "a" * 1500), ("r", 2, "b" * 1000), ("r", 3, "c"), ("r", 3, "c"), ("r", 4, "d" * 5000), ("r", 5, " ")], "resource_id string, page int, text string")
    got = [(r.chunk_id, r.label, r.text) for r in chunking.page_packs(p).orderBy("pack_no").collect()]
    assert got[0] == ("r-p0001", "pp. 1–2", "a" * 1500 + "\n\n" + "b" * 1000) and got[-1] == ("r-p0004", "p. 4", "d" * 5000) and len(got) == 3
    s = spark.createDataFrame([("r", 0.0, 40.0, " one two"), ("r", 40.0, 95.0, "three"), ("r", 95.0, 96.0, "four")], "resource_id string, start double, end double, text string")
    assert [(r.chunk_id, r.label, r.text) for r in chunking.segment_chunks(s).orderBy("chunk_no").collect()] == [("r-c0000", "00:00", "one two three"), ("r-c0001", "01:35", "four")]
    d = spark.createDataFrame([(1, "# Head\nalpha beta\n\ngamma"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.heading, r.text, r.words) for r in chunking.text_chunks(d).filter("words > 0").collect()] == [(1, "Head", "alpha beta\n\ngamma", 3)]


def on_disk(spark):
    """Bytes of shuffle files and of the shared folder."""
    import os

    from lorewell import session

    dirs = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [session.shared_folder(spark)]
    return sum(os.path.getsize(os.path.join(d, f)) for root in dirs for d, _, files in os.walk(root) for f in files)


def test_search_writes_less_than_its_input(spark, tmp_path):
    import os
    import random

    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("lan", "ter", "mis", "qua", "vor", "dex", "pol", "sun", "rig", "hem")]
    texts = {f"webpage:{r.getrandbits(64):016x}-c{i:04d}": " ".join(r.choices(words, k=150)) for i in range(6000)}
    chunks(spark, list(texts.items())).write.parquet(str(tmp_path / "chunks"))
    docs, size = search.corpus(spark.read.parquet(str(tmp_path / "chunks"))), sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "chunks") for f in files)
    q = spark.createDataFrame([(i, " ".join(r.sample(words, 6))) for i in range(120)], "query_id bigint, query string")
    before = on_disk(spark)
    index = search.Index.build(docs, str(tmp_path / "i"))
    size_of_index = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "i") for f in files)
    found = retrieval.retrieve(index, q, "hybrid", 5).collect()
    assert len(found) == 600 and on_disk(spark) - before + size_of_index < 1.5 * size


def test_shards_and_blocks_of_queries_change_nothing(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(4)
    rows = chunks(spark, [(f"c{i:03d}", " ".join(r.choices(["vector", "index", "store", "graph", "topic", "chunk", "label"], k=r.randrange(9)))) for i in range(300)])
    q = spark.createDataFrame([(i, " ".join(r.sample(["vector", "index", "store", "graph", "nowhere"], 2))) for i in range(9)], "query_id bigint, query string")
    whole = search.Index.build(search.corpus(rows), str(tmp_path / "a"))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    parts = search.Index.build(search.corpus(rows.repartition(7)), str(tmp_path / "b"))
    shown = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score").collect()))
    for kind in ("bm25", "cosine", "hashed"):
        every = shown(whole.ranked(q, [kind]))
        assert every == shown(parts.ranked(q, [kind])) and every
        first = sorted((n, c, s) for n in range(9) for s, c in sorted((-s, c) for m, c, s in every if m == n)[:5] for s in [-s])
        assert first == shown(search.top(parts.ranked(q, [kind], 5), 5, "chunk_id"))
    assert sorted(map(tuple, whole.postings.collect())) == sorted(map(tuple, search.postings(search.corpus(rows)).select("term", "chunk_id", "tf").collect()))
    assert sorted(map(tuple, whole.vocabulary.select("term", "df", "total_tf").collect())) == sorted(map(tuple, search.vocabulary(search.postings(search.corpus(rows))).collect()))
