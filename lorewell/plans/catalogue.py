"""The registered queries of the core, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.functions import urls as U
from lorewell.operators import checks, chunking, dense, graph, ledger, notes, registry, retrieval, search, topics, views
from lorewell.plans import oracles
from lorewell.session import cut, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}


# -- registry -------------------------------------------------------------------------------------------------------
@query
def registry_scan(s, d):
    return registry.scan(table(s, d, "resources")).select("id", "status", "source_type", "first_seen_at")


@query
def registry_pending(s, d):
    return registry.pending(table(s, d, "resources")).select("id", "status")


@query
def registry_lookup(s, d):
    r = table(s, d, "resources")
    return r.join(F.broadcast(r.agg(F.min("id").alias("id"))), "id").select("id", "canonical_id", "status")  # one row


@query
def status_counts(s, d):
    return registry.count_by(table(s, d, "resources"), "status")


@query
def keep_first_by_canonical_id(s, d):
    r = table(s, d, "resources").select("canonical_id", "record_no").unionByName(table(s, d, "intake").select("canonical_id", "record_no"))
    return r.filter("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.min("record_no").alias("record_no"))


@query
def insert_or_skip(s, d):
    return registry.insert_or_skip(table(s, d, "resources"), table(s, d, "intake"))


@query
def latest_run_by_resource(s, d):
    return registry.latest(table(s, d, "processing_runs"), "resource_id", ["ledger_pos"], "run_id", "operation", "ledger_pos")


@query
def normalized_providers(s, d):
    r = table(s, d, "resources").select(T.provider_name(F.col("llm_provider")).alias("provider"))
    return r.groupBy("provider").agg(F.count("*").alias("n"))


@query
def stale_notes(s, d):
    r = table(s, d, "resources").select("id", registry.stale_reasons("cloud_b", "wide-2", "v5").alias("reasons"))
    return r.filter(F.size("reasons") > 0).select("id", F.array_join("reasons", ";").alias("reasons"))


@query
def quality_gate(s, d):
    return registry.quality_gate(table(s, d, "resources"))


@query
def resource_identity(s, d):
    return registry.identities(table(s, d, "resources"))


@query
def url_normalize(s, d):
    return table(s, d, "intake").select("record_no", U.normalize_url(F.col("original_url")).alias("url"))


@query
def url_video_and_time(s, d):
    u = F.col("original_url")
    return table(s, d, "intake").select("record_no", U.video_id(u).alias("video_id"), U.url_seconds(u).alias("seconds")).filter("video_id IS NOT NULL OR seconds IS NOT NULL")


@query
def merged_timestamps(s, d):
    r = table(s, d, "intake").withColumn("v", U.video_id(F.col("original_url"))).filter("v IS NOT NULL")
    return registry.merge_seconds(r.select("v", F.array(U.url_seconds(F.col("original_url"))).alias("x")), "v", "x").select("v", F.array_join("seconds", ",").alias("seconds"))


@query
def domain_counts(s, d):
    return table(s, d, "resources").select(U.domain(F.col("original_url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query
def extractor_route(s, d):
    h = U.domain(F.col("original_url"))
    kind = F.when(h.isNull(), "file").when(h.rlike("tube"), "video").when(F.col("original_url").rlike("/blog/|/posts/"), "blog").otherwise("generic")
    return table(s, d, "resources").select(kind.alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query
def resources_without_chunks(s, d):
    c = table(s, d, "chunks").select(F.col("resource_id").alias("id")).distinct()
    return table(s, d, "resources").join(c, "id", "left_anti").select("id", "status")


@query
def extra_fields(s, d):
    get = lambda k: F.get_json_object("extra", f"$.{k}")
    return table(s, d, "resources").groupBy(get("platform").alias("platform"), get("quality_status").alias("quality_status")).agg(F.count("*").alias("n"), F.count_if(get("requires_human_review") == "true").alias("to_review"))


@query
def newest_resources(s, d):
    return table(s, d, "resources").select("id", "first_seen_at").orderBy(F.desc("first_seen_at"), "id").limit(10)


# -- chunks ---------------------------------------------------------------------------------------------------------
@query
def chunk_projection(s, d):
    return chunking.projection(table(s, d, "chunks"))


@query
def chunk_manifest(s, d):
    return chunking.manifest(table(s, d, "chunks"))


@query
def top_resources_by_chunks(s, d):
    return chunking.manifest(table(s, d, "chunks")).select("resource_id", "chunks").orderBy(F.desc("chunks"), "resource_id").limit(20)


@query
def chunks_by_source_type(s, d):
    return table(s, d, "chunks").select("chunk_id", "source_type").distinct().groupBy("source_type").agg(F.count("*").alias("n"))


@query
def chunk_resource_join(s, d):
    r = table(s, d, "resources").select(F.col("id").alias("resource_id"), "status", "importance")
    return table(s, d, "chunks").select("chunk_id", "resource_id").distinct().join(r, "resource_id").groupBy("status", "importance").agg(F.count("*").alias("n"))


@query
def duplicate_chunks(s, d):
    return table(s, d, "chunks").groupBy("chunk_id").agg(F.count("*").alias("copies")).filter("copies > 1")


@query
def stale_char_counts(s, d):
    return table(s, d, "chunks").filter(~F.col("char_count").eqNullSafe(F.length("text").cast("bigint"))).select("chunk_id", "char_count", F.length("text").cast("bigint").alias("actual")).distinct()


@query
def chunk_issues(s, d):
    return checks.chunk_issues(table(s, d, "chunks"))


@query
def section_lines(s, d):
    return chunking.sections(table(s, d, "documents")).select("doc_id", "section_no", "heading", F.length("content").cast("bigint").alias("n"))


@query
def text_chunks(s, d):
    return chunking.text_chunks(table(s, d, "documents"))


@query
def greedy_line_chunks(s, d):
    return chunking.line_chunks(table(s, d, "documents")).drop("text")


@query
def greedy_line_texts(s, d):
    """The texts of the same groups, by their digest."""
    return chunking.line_chunks(table(s, d, "documents")).select("doc_id", "group_no", F.sha2("text", 256).alias("digest"))


@query
def pdf_page_packs(s, d):
    c = table(s, d, "chunks").filter("source_type = 'pdf'").select("resource_id", F.col("chunk_index").alias("page"), "text").distinct()
    return chunking.page_packs(c)


@query
def media_segment_chunks(s, d):
    c = table(s, d, "chunks").filter("start_time IS NOT NULL").select("resource_id", F.col("start_time").alias("start"), F.greatest(F.coalesce("end_time", "start_time"), "start_time").alias("end"), "text", "chunk_id").distinct()
    return chunking.segment_chunks(c)


@query
def transcript_vtt(s, d):
    c = table(s, d, "chunks").filter("start_time IS NOT NULL").select("chunk_id", "start_time", "end_time").distinct()
    return c.select("chunk_id", F.concat(T.format_seconds(F.col("start_time")), F.lit(" --> "), T.format_seconds(F.greatest(F.coalesce("end_time", "start_time"), "start_time"))).alias("cue"))


# -- scalar functions over whole tables -----------------------------------------------------------------------------
@query
def tokenize_vocab(s, d):
    t = table(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"), "doc_id")
    return t.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("df"))


@query
def document_estimates(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"), T.word_count(t).alias("words"), T.token_estimate(t).alias("quarter"))


@query
def content_hash_dedupe(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def trimmed_previews(s, d):
    return table(s, d, "documents").select("doc_id", T.trim_text(F.col("text"), 240).alias("preview"), F.substring("text", 1, 240).alias("first"))


@query
def slugs(s, d):
    t = F.coalesce("title", F.lit(""))
    return table(s, d, "resources").select("id", T.slug(t).alias("slug"), T.anchor_slug(t).alias("anchor"), T.table_cell(F.col("title")).alias("cell"), T.display_title(F.col("title"), F.coalesce("canonical_id", "id")).alias("shown"))


@query
def redacted_errors(s, d):
    r = table(s, d, "processing_runs").filter("error IS NOT NULL").select("ledger_pos", T.redact(F.concat(F.lit("token: abc123 Bearer xyz "), F.col("error"))).alias("error"))
    return r.distinct()


@query
def heading_toc(s, d):
    lines = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    m = lines.select("doc_id", "line_no", F.regexp_extract("line", r"^(#{1,3})[ \t]+(\S.*?)\s*$", 1).alias("marks"), F.regexp_extract("line", r"^(#{1,3})[ \t]+(\S.*?)\s*$", 2).alias("title"))
    return m.filter("marks <> ''").select("doc_id", "line_no", F.length("marks").cast("bigint").alias("level"), "title")


@query
def front_matter(s, d):
    p = F.split("text", "---\n", 3)
    return table(s, d, "documents").filter(F.col("text").startswith("---\n")).select("doc_id", F.regexp_extract(F.get(p, F.lit(1)), r"title: \"?([^\"\n]*)", 1).alias("title"), F.length(F.get(p, F.lit(2))).cast("bigint").alias("n_body"))


@query
def question_difficulty(s, d):
    q = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?\n]+\?"), 0))
    return table(s, d, "documents").select("doc_id", q.alias("q")).groupBy("doc_id", T.difficulty(F.col("q")).alias("difficulty")).agg(F.count("*").alias("n"))


@query
def bullet_counts(s, d):
    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[ \t]*[-*]")))
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", n.cast("bigint").alias("bullets"))


@query
def citation_counts(s, d):
    n = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[source: ?([^\]]+)\]"), 1)))
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", n.cast("bigint").alias("citations")).filter("citations > 0")


@query
def paywalled(s, d):
    c = table(s, d, "chunks").filter("source_type = 'medium_markdown'").groupBy("resource_id").agg(F.sum(T.word_count(F.col("text"))).cast("bigint").alias("words"), F.max(F.lower("text").rlike("sign in|member-only|get unlimited access|open in app").cast("int")).alias("marked"))
    return c.filter("words < 200 OR marked = 1").select("resource_id", "words")


# -- topics and views -----------------------------------------------------------------------------------------------
#: Tables that several queries of one application read, written once: by application, folder and name.
_kept: dict[tuple[str, str, str], object] = {}


def _once(s, d, name, make):
    key = (s.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _topics(s, d):
    return _once(s, d, "topics", lambda: cut(topics.resource_topics(table(s, d, "resources"))))


@query
def topic_assignment(s, d):
    return _topics(s, d).select("id", F.array_join("topics", ",").alias("topics"))


@query
def topics_from_tags(s, d):
    """The topics that the tags of resources name."""
    return table(s, d, "resources").select("id", F.array_join(topics.normalized_topics(F.transform("tags", lambda x: T.slug(x))), ",").alias("topics")).filter("topics <> ''")


@query
def topic_resources(s, d):
    return topics.topic_resources(_topics(s, d))


@query
def learn_chapters(s, d):
    return topics.learn_chapters(table(s, d, "resources"), _topics(s, d))


@query
def tag_index(s, d):
    return topics.tag_index(table(s, d, "resources"), _topics(s, d))


@query
def timeline_by_month(s, d):
    return views.timeline(table(s, d, "resources"), _topics(s, d))


@query
def knowledge_gaps(s, d):
    return views.gaps(table(s, d, "resources"))


@query
def review_buckets(s, d):
    return views.review_buckets(table(s, d, "resources"))


@query
def review_queue(s, d):
    return views.review_queue(table(s, d, "resources"))


@query
def status_report(s, d):
    return views.status_report(table(s, d, "resources"))


@query
def search_items(s, d):
    return views.search_items(table(s, d, "resources"), _topics(s, d))


# -- ledgers --------------------------------------------------------------------------------------------------------
@query
def token_ledger_rollup(s, d):
    return ledger.token_rollup(table(s, d, "token_ledger"))


@query
def run_status_rollup(s, d):
    return ledger.status_rollup(table(s, d, "processing_runs"))


@query
def recent_runs(s, d):
    return ledger.tail(table(s, d, "processing_runs").distinct(), 20, "run_id", "operation")


@query
def daily_usage(s, d):
    return ledger.daily_usage(table(s, d, "token_ledger"))


@query
def running_usage(s, d):
    return ledger.running_usage(table(s, d, "token_ledger"))


@query
def runs_without_ledger(s, d):
    return ledger.unlogged_runs(table(s, d, "processing_runs"), table(s, d, "token_ledger"))


@query
def usage_from_json(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit('{"usage": {"prompt_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}")).alias("u"))
    return ledger.provider_usage(e, "u").select("event_id", "input_tokens", "output_tokens", "total_tokens")


@query
def events_by_hour(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


# -- search ---------------------------------------------------------------------------------------------------------
def _docs(s, d):
    return search.corpus(table(s, d, "chunks"))


def _index(s, d):
    """The stored index of the chunks; the first query that asks for it writes it."""
    return _once(s, d, "index", lambda: search.Index.build(_docs(s, d), f"{shared_folder(s)}/index-{uuid.uuid4().hex}"))


def _queries(s, d):
    """Every document whose id is divisible by 50 asks with its title, or its first line where it has none."""
    q = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.split("text", "\n")[0], F.lit(""))
    return table(s, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), q.alias("query"))


@query
def bm25_topk(s, d):
    return search.top(_index(s, d).bm25(_queries(s, d), 10), 10, "chunk_id").select("query_id", "rank", "chunk_id", "score", F.array_join("matched_terms", " ").alias("matched_terms"))


@query
def bm25_pdf_topk(s, d):
    return retrieval.retrieve(_index(s, d), _queries(s, d), "bm25", 5, source_types=["pdf"]).select("query_id", "rank", "chunk_id", "score")


@query
def index_vocabulary(s, d):
    return search.vocabulary(search.postings(_docs(s, d)))


@query
def index_lengths(s, d):
    return search.lengths(_docs(s, d))


@query
def index_stats(s, d):
    return search.index_stats(_docs(s, d))


@query
def idf_table(s, d):
    return search.idf_table(_docs(s, d))


@query
def tfidf_cosine_topk(s, d):
    return search.top(_index(s, d).cosine(_queries(s, d), 10), 10, "chunk_id").select("query_id", "rank", "chunk_id", "score")


@query
def hashed_vector_stats(s, d):
    v = search.hashed_vectors(_docs(s, d))
    return v.groupBy("chunk_id").agg(F.count("*").alias("nnz"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


@query
def hashed_topk(s, d):
    return search.top(_index(s, d).hashed(_queries(s, d), 10), 10, "chunk_id").select("query_id", "rank", "chunk_id", "score")


@query
def index_issues(s, d):
    index = _index(s, d)
    return checks.index_issues(index.postings, index.chunks)


@query
def vector_issues(s, d):
    return checks.vector_issues(search.hashed_vectors(cut(_docs(s, d))), 1024)


@query
def dense_cosine_topk(s, d):
    return dense.top_cosine(table(s, d, "embeddings"))


@query
def hybrid_topk(s, d):
    return retrieval.retrieve(_index(s, d), _queries(s, d), "hybrid").select("query_id", "rank", "chunk_id", "score")


@query
def graph_lite_topk(s, d):
    found = retrieval.retrieve(_index(s, d), _queries(s, d), "graph_lite", topics=_topics(s, d), resources=table(s, d, "resources"), concepts=notes.resource_concepts(table(s, d, "documents")))
    return found.select("query_id", "rank", "chunk_id", "boost", "score")


@query
def retrieve_by_mode(s, d):
    """All modes over web pages and Markdown."""
    out, kinds = None, ["webpage", "markdown"]
    ready = retrieval.candidates(_index(s, d), _queries(s, d), 5, kinds)
    for mode in retrieval.MODES:
        one = retrieval.retrieve(_index(s, d), _queries(s, d), mode, 5, source_types=kinds, topics=_topics(s, d), resources=table(s, d, "resources"), concepts=notes.resource_concepts(table(s, d, "documents")), ready=ready).select("mode", "query_id", "rank", "chunk_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def _expected(s, d):
    """A document's own resource is what its title should find."""
    return table(s, d, "documents").filter("doc_id % 50 = 0 AND resource_id IS NOT NULL").select(F.col("doc_id").alias("query_id"), "resource_id")


def _ranked(s, d):
    return retrieval.retrieve(_index(s, d), _queries(s, d), "bm25", 10)


@query
def retrieval_eval_metrics(s, d):
    return retrieval.metrics(_ranked(s, d), _expected(s, d), [1, 3, 5, 10])


@query
def retrieval_eval_aggregate(s, d):
    return retrieval.mean_metrics(retrieval_eval_metrics(s, d))


@query
def retrieval_eval_terms(s, d):
    """The words of the query are what its results should hold."""
    asked = search.query_terms(_queries(s, d))
    return retrieval.term_coverage(_ranked(s, d), _docs(s, d), asked, [1, 3, 10])


@query
def context_pack_chunks(s, d):
    return retrieval.context_pack(_ranked(s, d), _docs(s, d))


@query
def context_pack_sources(s, d):
    return retrieval.pack_sources(context_pack_chunks(s, d)).select("query_id", "resource_id", "citation_label", F.array_join("chunk_ids", " ").alias("chunk_ids"))


@query
def extractive_answers(s, d):
    return retrieval.extract_answers(context_pack_chunks(s, d), _queries(s, d))


@query
def answer_grades(s, d):
    pack = cut(context_pack_chunks(s, d))
    return retrieval.grade(pack, retrieval.extract_answers(pack, _queries(s, d)))


@query
def answer_checks(s, d):
    """The nine checks of each answer."""
    pack = cut(context_pack_chunks(s, d))
    return retrieval.answer_checks(retrieval.answer_bodies(retrieval.extract_answers(pack, _queries(s, d)), pack), pack, _queries(s, d))


# -- notes ----------------------------------------------------------------------------------------------------------
@query
def missing_citations(s, d):
    return notes.missing_citations(table(s, d, "documents"), table(s, d, "chunks"))


@query
def citation_coverage(s, d):
    return notes.citation_coverage(table(s, d, "documents"), table(s, d, "chunks"))


@query
def linked_citations(s, d):
    return notes.linked_citations(table(s, d, "documents"), table(s, d, "chunks"))


@query
def note_sections(s, d):
    """What each document says under the heading of its own title."""
    return table(s, d, "documents").filter("text IS NOT NULL AND title IS NOT NULL").select("doc_id", T.section(F.col("text"), F.col("title")).alias("section")).filter("section <> ''")


@query
def weak_reasons(s, d):
    return notes.weak_reasons(table(s, d, "documents"))


@query
def concept_index(s, d):
    return notes.concepts(table(s, d, "documents"))


@query
def flashcards(s, d):
    return notes.flashcards(table(s, d, "documents"))


@query
def rag_prompts(s, d):
    return notes.prompts(context_pack_chunks(s, d), _queries(s, d))


# -- graph ----------------------------------------------------------------------------------------------------------
def _graph(s, d):
    r, t = table(s, d, "resources"), _topics(s, d)
    return graph.nodes(r, t), graph.edges(r, t)


@query
def graph_nodes(s, d):
    return _graph(s, d)[0]


@query
def graph_edges(s, d):
    return _graph(s, d)[1]


@query
def graph_stats(s, d):
    n, e = _graph(s, d)
    return graph.count_types(n.distinct()).withColumn("part", F.lit("node")).unionByName(graph.count_types(e).withColumn("part", F.lit("edge")))


@query
def graph_degree_top50(s, d):
    return graph.degrees(_graph(s, d)[1])


@query
def graph_relationships(s, d):
    return graph.class_relationships(cut(graph.relationship_classes(table(s, d, "resources"), _topics(s, d))))


@query
def graph_relationship_members(s, d):
    return graph.relationship_classes(table(s, d, "resources"), _topics(s, d))


@query
def graph_validate(s, d):
    n, e = _graph(s, d)
    return graph.validate(cut(n), cut(e))


@query
def graph_neighbourhood(s, d):
    return graph.neighbourhood(_graph(s, d)[1], "topic:agents")


@query
def graph_shortest_path(s, d):
    return graph.shortest_path(_graph(s, d)[1], "topic:agents", "topic:linear-algebra")
