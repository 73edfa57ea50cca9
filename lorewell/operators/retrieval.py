"""Hybrid retrieval, graph re-ranking, evaluation, context packs, extractive answers and their grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import search as S
from lorewell.session import cut, small

#: Fusion weights, candidate depth and boosts.
BM25_WEIGHT, VECTOR_WEIGHT, DEPTH = 0.55, 0.45, 3
SAME_TOPIC, SHARED_CONCEPT, SAME_TYPE, MOST = 0.04, 0.03, 0.02, 0.10


def max_normalized(scores: DataFrame, name: str) -> DataFrame:
    """(query_id, chunk_id, name): scores over the query's best; a query without a positive score has no rows."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("best", best).filter("best > 0").select("query_id", "chunk_id", (F.col("score") / F.col("best")).alias(name))


def fused(bm25: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, bm25, vector, score) of the union of both sides' first candidates."""
    depth = min(100, limit * DEPTH)
    a = max_normalized(S.top(bm25, depth, "chunk_id"), "bm25")
    b = max_normalized(S.top(vector, depth, "chunk_id"), "vector")
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").na.fill(0.0, ["bm25", "vector"])
    return both.withColumn("score", F.round(F.col("bm25") * BM25_WEIGHT + F.col("vector") * VECTOR_WEIGHT, 6))


def hybrid(docs: DataFrame, bm25: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each query by fused score, then resource, then chunk."""
    meta = docs.select("chunk_id", "resource_id", "source_type")
    return S.top(fused(bm25, vector, limit).join(meta, "chunk_id"), limit, "resource_id", "chunk_id")


def graph_boost(candidates: DataFrame, topics: DataFrame, resource_types: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(query_id, resource_id, boost, shared_topics): what candidates of one query gain from one another.

    Single hops only: topics, and with `concepts` (resource_id, slug) concepts, that another candidate resource has too,
    and the commonest source type (ties: the least name) if more than one candidate has it.
    """
    own = candidates.select("query_id", "resource_id").distinct()
    with_topic = own.join(topics.select(F.col("id").alias("resource_id"), F.explode("topics").alias("topic")), "resource_id")
    crowd = with_topic.groupBy("query_id", "topic").agg(F.count("*").alias("n")).filter("n > 1").select("query_id", "topic")
    shared = with_topic.join(crowd, ["query_id", "topic"]).groupBy("query_id", "resource_id").agg(F.sort_array(F.collect_set("topic")).alias("shared_topics"))
    typed = own.join(resource_types.select(F.col("id").alias("resource_id"), "source_type"), "resource_id")
    counts = typed.groupBy("query_id", "source_type").agg(F.count("*").alias("n"))
    chief = counts.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("source_type").alias("chief"))).alias("c")).filter("c.m < -1").select("query_id", "c.chief")
    joined = typed.join(chief, "query_id", "left").join(shared, ["query_id", "resource_id"], "left")
    if concepts is None:
        joined = joined.withColumn("conceptual", F.lit(False))
    else:
        with_concept = own.join(concepts.select("resource_id", "slug").distinct(), "resource_id")
        known = with_concept.groupBy("query_id", "slug").agg(F.count("*").alias("n")).filter("n > 1").select("query_id", "slug")
        joined = joined.join(with_concept.join(known, ["query_id", "slug"], "left_semi").select("query_id", "resource_id", F.lit(True).alias("conceptual")).distinct(), ["query_id", "resource_id"], "left")
    boost = F.when(F.col("conceptual"), SHARED_CONCEPT).otherwise(0.0) + F.when(F.col("shared_topics").isNotNull(), SAME_TOPIC).otherwise(0.0) + F.when(F.col("chief") == F.col("source_type"), SAME_TYPE).otherwise(0.0)
    return joined.select("query_id", "resource_id", F.round(F.least(F.lit(MOST), F.greatest(F.lit(0.0), boost)), 6).alias("boost"), F.coalesce("shared_topics", F.array().cast("array<string>")).alias("shared_topics"))


def graph_lite(docs: DataFrame, bm25: DataFrame, vector: DataFrame, topics: DataFrame, resources: DataFrame, limit: int, concepts: DataFrame | None = None) -> DataFrame:
    """Hybrid candidates re-ranked by score plus boost."""
    found = fused(bm25, vector, limit).join(docs.select("chunk_id", "resource_id"), "chunk_id")
    boosts = graph_boost(found, topics, resources.select("id", "source_type"), concepts)
    scored = found.join(boosts, ["query_id", "resource_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))).withColumn("score", F.round(F.col("score") + F.col("boost"), 6))
    return S.top(scored, limit, "resource_id", "chunk_id")


def metrics(ranked: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, recall, precision, hit, mrr): precision is over what was returned, up to k; queries with no result count."""
    cases = expected.groupBy("query_id").agg(F.count_distinct("resource_id").alias("n_expected"))
    grid = cases.select("query_id", "n_expected", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = ranked.join(expected.distinct().withColumn("is_hit", F.lit(1)), ["query_id", "resource_id"], "left")
    within = grid.join(hits, "query_id", "left").filter(F.col("rank").isNull() | (F.col("rank") <= F.col("k")))
    got = within.groupBy("query_id", "k", "n_expected").agg(F.count("rank").alias("returned"), F.count_distinct(F.when(F.col("is_hit") == 1, F.col("resource_id"))).alias("matched"), F.min(F.when(F.col("is_hit") == 1, F.col("rank"))).alias("first_rank"))
    every = grid.join(got.drop("n_expected"), ["query_id", "k"], "left").na.fill(0, ["returned", "matched"])
    return every.select("query_id", "k", F.round(F.col("matched") / F.col("n_expected"), 6).alias("recall"), F.round(F.when(F.col("returned") > 0, F.col("matched") / F.col("returned")).otherwise(0.0), 6).alias("precision"),
                        F.when(F.col("matched") > 0, 1.0).otherwise(0.0).alias("hit"), F.round(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"))


def mean_metrics(each: DataFrame) -> DataFrame:
    return each.groupBy("k").agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "hit", "mrr")))


def context_pack(ranked: DataFrame, docs: DataFrame, max_chars: int = 0) -> DataFrame:
    """(query_id, rank, citation_label, chunk_id, resource_id, text, truncated): each chunk once, with its whole text, or cut at a space to at most `max_chars` if that is positive."""
    text = docs.select("chunk_id", "resource_id", F.coalesce("text", F.lit("")).alias("full"))
    rows = text.join(small(cut(ranked.select("query_id", "rank", "chunk_id"))), "chunk_id")
    return rows.select("query_id", "rank", F.concat(F.lit("[cite:"), F.col("rank"), F.lit("]")).alias("citation_label"), "chunk_id", "resource_id", T.trim_text(F.col("full"), max_chars).alias("text"), (F.length("full") > max_chars if max_chars > 0 else F.lit(False)).alias("truncated"))


def pack_sources(pack: DataFrame) -> DataFrame:
    """(query_id, resource_id, citation_label, chunk_ids): sources with the label of their first chunk."""
    return pack.groupBy("query_id", "resource_id").agg(F.min_by("citation_label", "rank").alias("citation_label"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


QUERY_WORD = r"[a-z0-9][a-z0-9_\-]*"
SENTENCE = r"([.!?])\s+(?=[A-Z0-9\"'])"


def sentences(text):
    """Sentences of a text; a sentence begins after a mark and white space with a capital, digit or quote."""
    marked = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), SENTENCE, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def extract_answers(pack: DataFrame, queries: DataFrame, per_chunk: int = 3) -> DataFrame:
    """(query_id, rank, chunk_id, answer): up to three sentences of each chunk that share a word with the query, else its first three, each cited."""
    words = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(QUERY_WORD), 0)).alias("words"))
    rows = pack.join(words, "query_id").withColumn("s", sentences(F.col("text")))
    hit = F.filter("s", lambda s: (F.size(F.col("words")) == 0) | F.arrays_overlap(F.regexp_extract_all(F.lower(s), F.lit(QUERY_WORD), 0), F.col("words")))
    cited = F.transform(F.slice(F.when(F.size(hit) > 0, hit).otherwise(F.col("s")), 1, per_chunk), lambda s: F.concat(s, F.lit(" "), F.col("citation_label")))
    return rows.select("query_id", "rank", "chunk_id", F.array_join(cited, " ").alias("answer"))


def grade(pack: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, chunk_coverage, labels_valid, answered): checks of the answers against their packs."""
    used = answers.filter("answer <> ''")
    labels = used.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[cite:\d+\]"), 0)).alias("citation_label")).distinct()
    wrong = labels.join(pack.select("query_id", "citation_label").distinct(), ["query_id", "citation_label"], "left_anti").groupBy("query_id").agg(F.count("*").alias("wrong"))
    total = pack.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    cover = used.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("used"))
    joined = total.join(cover, "query_id", "left").join(wrong, "query_id", "left").na.fill(0, ["used", "wrong"])
    return joined.select("query_id", F.round(F.col("used") / F.col("chunks"), 6).alias("chunk_coverage"), (F.col("wrong") == 0).alias("labels_valid"), (F.col("used") > 0).alias("answered"))


MODES = ("bm25", "vector", "hybrid", "graph_lite")


def candidates(index: S.Index, queries: DataFrame, limit: int, source_types: list[str] | None = None, resource_ids: list[str] | None = None) -> DataFrame:
    """What every mode of `retrieve` needs of the index for `limit` rows, written once."""
    return cut(index.ranked(queries, ["bm25", "cosine"], max(limit, min(100, limit * DEPTH)), source_types, resource_ids))


def retrieve(index: S.Index, queries: DataFrame, mode: str, limit: int = 10, source_types: list[str] | None = None, resource_ids: list[str] | None = None, topics: DataFrame | None = None, resources: DataFrame | None = None, concepts: DataFrame | None = None, ready: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, resource_id, source_type, score, bm25, vector, boost, matched_terms, mode): the first `limit` of each query.

    Filters apply after scoring and before the cut to candidates, so that they don't change scores. `bm25` and `vector`
    are the parts of the score (fused ones over the query's best), null where the mode has none. An unknown mode raises.
    Several modes share one pass if `ready` is `candidates` of the same limit and filters.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    none = F.lit(None).cast("double")
    shown = ["query_id", "rank", "chunk_id", "resource_id", "source_type", "score", "bm25", "vector", "boost", "matched_terms"]
    if mode in ("bm25", "vector"):
        own = "bm25" if mode == "bm25" else "cosine"
        found = S.top(index.ranked(queries, [own], limit, source_types, resource_ids) if ready is None else ready.filter(F.col("kind") == own), limit, "chunk_id")
        found = found.withColumn("bm25", F.col("score") if mode == "bm25" else none).withColumn("vector", F.col("score") if mode == "vector" else none).withColumn("boost", F.lit(0.0))
        return found.select(*shown, F.lit(mode).alias("mode"))
    both = candidates(index, queries, limit, source_types, resource_ids) if ready is None else ready
    one, two = (both.filter(F.col("kind") == kind).select("query_id", "chunk_id", "score") for kind in ("bm25", "cosine"))
    meta = both.select("query_id", "chunk_id", "resource_id", "source_type", "matched_terms").dropDuplicates(["query_id", "chunk_id"])
    found = fused(one, two, limit).join(meta, ["query_id", "chunk_id"]).withColumn("boost", F.lit(0.0))
    if mode == "graph_lite":
        found = cut(found.drop("boost"))
        boosts = graph_boost(found, topics, resources.select("id", "source_type"), concepts).select("query_id", "resource_id", "boost")
        found = found.join(boosts, ["query_id", "resource_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))).withColumn("score", F.round(F.col("score") + F.col("boost"), 6))
    return S.top(found, limit, "resource_id", "chunk_id").select(*shown, F.lit(mode).alias("mode"))


def term_coverage(ranked: DataFrame, docs: DataFrame, expected_terms: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, coverage): of a query's expected terms the share that occurs in the texts of its first `k` results, whatever the case; queries without expected terms are left out."""
    terms = expected_terms.select("query_id", F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    texts = docs.select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(small(cut(ranked.select("query_id", "rank", "chunk_id"))), "chunk_id")
    seen = texts.join(terms, "query_id").filter(F.expr("contains(text, term)")).groupBy("query_id", "term").agg(F.min("rank").alias("first_rank"))
    grid = terms.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(seen, ["query_id", "term"], "left")
    return grid.groupBy("query_id", "k").agg(F.round(F.count_if(F.col("first_rank") <= F.col("k")) / F.count("*"), 6).alias("coverage"))


# The banner of an extractive answer, its body without context, the ids of the checks in their order.
BANNER = "MOCK / NO-LLM ANSWER"
NO_CONTEXT = "I don't know based on the provided context. (MOCK / NO-LLM ANSWER — no context chunks were retrieved.)"
CHECKS = ["answer_has_body", "answer_marked_mock_no_llm", "answer_is_mock_flag", "cited_answer_has_citations", "citations_exist_in_context", "no_hallucinated_source_ids", "answer_non_empty_when_context",
          "context_chunk_coverage", "context_source_coverage"]


def answer_bodies(answers: DataFrame, pack: DataFrame) -> DataFrame:
    """(query_id, body, labels, used_chunks, used_sources, is_mock): the paragraphs of a query's chunks under the banner, in the order of their rank."""
    used = answers.filter("answer <> ''").join(pack.select("query_id", "chunk_id", "citation_label", "resource_id"), ["query_id", "chunk_id"])
    rows = used.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation_label", "answer", "chunk_id", "resource_id"))).alias("r"))
    body = F.concat(F.lit(BANNER + "\n\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("From "), x["citation_label"], F.lit(":\n\n"), x["answer"])), "\n\n"))
    return rows.select("query_id", body.alias("body"), F.array_distinct(F.transform("r", lambda x: x["citation_label"])).alias("labels"), F.array_distinct(F.transform("r", lambda x: x["chunk_id"])).alias("used_chunks"),
                       F.array_distinct(F.array_compact(F.transform("r", lambda x: x["resource_id"]))).alias("used_sources"), F.lit(True).alias("is_mock"))


def answer_checks(bodies: DataFrame, pack: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, check, passed, score): the nine checks of each query's answer against its pack; a query without context passes what asks about context."""
    packs = pack.groupBy("query_id").agg(F.collect_set("citation_label").alias("pack_labels"), F.collect_set("chunk_id").alias("pack_chunks"), F.collect_set("resource_id").alias("pack_sources"))
    none = F.array().cast("array<string>")
    r = queries.select("query_id").distinct().join(packs, "query_id", "left").join(bodies, "query_id", "left")
    r = r.select("query_id", F.coalesce("body", F.lit(BANNER + "\n\n" + NO_CONTEXT)).alias("body"), F.coalesce("is_mock", F.lit(True)).alias("is_mock"), *(F.coalesce(c, none).alias(c) for c in ("pack_labels", "pack_chunks", "pack_sources", "labels", "used_chunks", "used_sources")))
    said = F.array_union(F.regexp_extract_all("body", F.lit(r"(\[cite:[0-9]+\])"), 1), F.col("labels"))
    context = F.size("pack_chunks") > 0
    share = lambda used, whole: F.when(F.size(whole) > 0, F.size(F.array_intersect(used, whole)) / F.size(whole)).otherwise(1.0)
    passed = [F.trim("body") != "", F.col("body").contains(BANNER), F.col("is_mock"), ~context | (F.size(said) > 0), F.size(F.array_except(said, "pack_labels")) == 0, F.size(F.array_except("used_sources", "pack_sources")) == 0,
              ~context | ((F.trim("body") != "") & ~F.col("body").contains(NO_CONTEXT)), share("used_chunks", "pack_chunks") > 0, share("used_sources", "pack_sources") > 0]
    score = [F.when(p, 1.0).otherwise(0.0) for p in passed[:7]] + [F.round(share("used_chunks", "pack_chunks"), 6), F.round(share("used_sources", "pack_sources"), 6)]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), p.alias("passed"), s.cast("double").alias("score")) for c, p, s in zip(CHECKS, passed, score))))
    return r.select("query_id", each.alias("x")).select("query_id", "x.check", "x.passed", "x.score")
