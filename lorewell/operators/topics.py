"""Topics: keyword assignment, learn chapters, tags, concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

# Topics and their keywords, in the order of assignment.
TOPICS: dict[str, list[str]] = {
    "rag-retrieval": ["rag", "retrieval", "hybrid search", "bm25", "dense retrieval", "sparse retrieval", "cag", "chunking", "vector database", "embedding", "embeddings", "vector"],
    "embeddings": ["embedding", "embeddings", "semantic search", "vector search", "sentence transformer", "hugging face embeddings"],
    "llm-inference": ["vllm", "inference", "serving", "openai-compatible api", "throughput", "latency", "batching", "paged attention", "prefix caching", "gpu"],
    "vllm": ["vllm", "paged attention", "continuous batching", "prefix caching"],
    "llm-evals": ["eval", "evals", "evaluation", "benchmark", "judge", "rubric", "lm-eval", "guidellm"],
    "agents": ["agent", "agents", "tool", "tooling", "agent harness", "harness", "connector"],
    "ai-security": ["security", "attack", "exfiltration", "prompt injection", "jailbreak", "connector"],
    "optimizer-training": ["adam", "optimizer", "training", "gradient", "backprop", "loss"],
    "linear-algebra": ["linear algebra", "matrix", "matrices", "vectors", "mit 18.06"],
    "transcription-asr": ["transcript", "whisper", "audio", "video", "asr", "speech"],
}


# Other names of topics.
ALIASES = {"rag": "rag-retrieval", "retrieval": "rag-retrieval", "security": "ai-security", "ai-safety": "ai-security", "optimization-training": "optimizer-training", "training": "optimizer-training"}


def normalized_topics(names: Column) -> Column:
    """Names of topics in their first order, aliases under their own name, each once; what is no topic is left out."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    own = F.transform(names, lambda x: F.coalesce(F.element_at(table, x), x))
    return F.array_distinct(F.filter(own, lambda x: x.isin(list(TOPICS))))


def matching_topics(text: Column) -> Column:
    """The topics of a lower-case text, in the order of their definition."""
    each = []
    for topic, words in TOPICS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | T.contains_keyword(text, w)
        each.append(F.when(hit, F.lit(topic)))
    return F.array_compact(F.array(*each))


def resource_topics(resources: DataFrame) -> DataFrame:
    """(id, topics) from title, tags, description, notes, author, and subtitle and site name of `extra`."""
    text = F.lower(F.concat_ws(" ", T.display_title(F.col("title"), F.coalesce("canonical_id", "id")), F.array_join("tags", " "), F.coalesce("description", F.lit("")), F.coalesce("notes_from_user", F.lit("")), F.coalesce("author", F.lit("")), *(F.coalesce(F.get_json_object("extra", f"$.{k}"), F.lit("")) for k in ("subtitle", "site_name") if "extra" in resources.columns)))
    return resources.select("id", matching_topics(text).alias("topics"))


def topic_resources(assigned: DataFrame) -> DataFrame:
    """(topic, n): resources of each topic."""
    return assigned.select("id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def learn_chapters(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(topic, n): chapters take a resource by topic or by a keyword anywhere in its title."""
    title = F.lower(T.display_title(F.col("title"), F.coalesce("canonical_id", "id")))
    each = []
    for topic, words in TOPICS.items():
        hit = F.array_contains("topics", topic)
        for w in words:
            hit = hit | title.contains(w)
        each.append(F.when(hit, F.lit(topic)))
    return resources.join(assigned, "id").select(F.explode(F.array_compact(F.array(*each))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def tag_index(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(tag, n): distinct resources of each tag from tags, type, platform, importance and topics."""
    r = resources.join(assigned, "id")
    own = lambda c: F.lower(F.trim(c))
    tags = F.concat(F.transform(F.coalesce("tags", F.array().cast("array<string>")), own), F.array(own(F.col("source_type")), own(F.get_json_object("extra", "$.platform")), own(F.col("importance"))), F.col("topics"))
    return r.select("id", F.explode(F.array_distinct(F.array_compact(tags))).alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))
