"""Notes: citations found and missing, weak-note reasons, concepts, questions, flashcards and rendered prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

CITATION = r"\[source: ?([^\]]+)\]"
FENCE = r"(?s)```.*?(?:```|$)"
# Concepts that count wherever a note names them.
KEYWORDS = ["Embeddings", "RAG", "Chunking", "Tokenization", "Vector Database", "LLM", "Transformer", "Attention", "Inference", "Fine-tuning", "Prompt Engineering", "Cosine Similarity", "Retrieval", "Context Window"]


def citations(notes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id): chunks that a note cites outside fenced code, each once."""
    plain = F.regexp_replace("text", FENCE, "")
    return notes.filter("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(CITATION), 1))).alias("chunk_id"))


def missing_citations(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of chunks that the index lacks."""
    return citations(notes).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("doc_id", "chunk_id")


def citation_coverage(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(cited, found): how many citations there are and how many of their chunks exist."""
    known = chunks.select("chunk_id").distinct().withColumn("known", F.lit(1))
    return citations(notes).join(known, "chunk_id", "left").agg(F.count("*").alias("cited"), F.count("known").alias("found"))


def linked_citations(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, text): citations outside fenced code as links to their chunk's anchor, those of unknown chunks as a remark.

    Notes without a citation are left out; null texts have none.
    """
    cited = citations(notes).join(chunks.select("chunk_id").distinct().withColumn("known", F.lit(True)), "chunk_id", "left")
    link = F.when(F.col("known"), F.concat(F.lit("["), T.short_label(F.col("chunk_id")), F.lit("](#"), T.anchor_slug(F.col("chunk_id")), F.lit(")<!-- "), F.col("chunk_id"), F.lit(" -->"))).otherwise(F.concat(F.lit("[missing source chunk: "), F.col("chunk_id"), F.lit("]")))
    links = cited.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", link.alias("link"))).alias("links"))

    def put(text, x):
        both = F.replace(text, F.concat(F.lit("[source: "), x["chunk_id"], F.lit("]")), x["link"])
        return F.replace(both, F.concat(F.lit("[source:"), x["chunk_id"], F.lit("]")), x["link"])

    # every second part between fences is code
    parts = F.transform(F.split("text", "```"), lambda p, i: F.when(i % 2 == 0, F.aggregate("links", p, put)).otherwise(p))
    return notes.select("doc_id", "text").join(links, "doc_id").select("doc_id", F.array_join(parts, "```").alias("text"))


def weak_reasons(notes: DataFrame) -> DataFrame:
    """(doc_id, reasons): why a note is weak; notes without a reason are left out."""
    cited = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(CITATION), 1)))
    why = F.array_compact(F.array(F.when(T.word_count(F.col("text")) < 250, "note is short"), F.when(cited < 3, "sparse citations"), F.when(F.lower("text").rlike("mock-generated|placeholder content|learned about this topic"), "generic phrases")))
    return notes.filter("trim(text) <> ''").select("doc_id", F.array_join(why, ";").alias("reasons")).filter("reasons <> ''")


def note_concepts(notes: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, slug, name): bullets of two to sixty characters before a colon, then KEYWORDS that a note holds anywhere.

    A name that a note repeats, in whatever case, counts once; `most` is of different names.
    """
    bullets = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[ \t]*[-*] ")), lambda x: F.trim(F.substring_index(F.regexp_replace(x, r"^[ \t]*[-*] +", ""), ":", 1)))
    held = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower("text"), F.lower(k)))
    names = notes.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.concat(F.filter(bullets, lambda x: F.length(x).between(2, 60)), held)).alias("pos", "name"))
    once = names.groupBy("doc_id", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("first")).select("doc_id", "first.pos", "first.name")
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter(F.col("n") <= most)
    return first.select("doc_id", T.slug(F.col("name")).alias("slug"), "name").filter("slug <> ''")


def concepts(notes: DataFrame, most: int = 20) -> DataFrame:
    """(slug, name, notes): the concepts of all notes, merged by slug."""
    return note_concepts(notes, most).groupBy("slug").agg(F.min("name").alias("name"), F.count_distinct("doc_id").alias("notes"))


def resource_concepts(notes: DataFrame) -> DataFrame:
    """(resource_id, slug): the concepts of each resource by the notes on it."""
    own = notes.filter("resource_id IS NOT NULL").select("doc_id", "resource_id")
    return note_concepts(notes).select("doc_id", "slug").join(own, "doc_id").select("resource_id", "slug").distinct()


def flashcards(notes: DataFrame) -> DataFrame:
    """(doc_id, question, answer, difficulty): a line that ends with a question mark and the next line as its answer."""
    lines = notes.filter("text IS NOT NULL").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("ls"))
    pairs = lines.select("doc_id", F.explode(F.transform("ls", lambda x, i: F.struct(x.alias("q"), F.get("ls", i + 1).alias("a")))).alias("p")).filter("endswith(p.q, '?')")
    return pairs.select("doc_id", F.col("p.q").alias("question"), T.trim_text(F.col("p.a"), 300).alias("answer"), T.difficulty(F.col("p.q")).alias("difficulty")).distinct()


SYSTEM = "Answer from the context only. Cite each statement with the label of its chunk."


def prompts(pack: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, system, user): one prompt for each query, the chunks in the order of their rank."""
    blocks = pack.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "citation_label", "text"))), lambda x: F.concat(x["citation_label"], F.lit("\n"), x["text"])), "\n\n").alias("context"))
    return queries.join(blocks, "query_id", "left").select("query_id", F.lit(SYSTEM).alias("system"), F.concat(F.lit("Question: "), "query", F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("(none)"))).alias("user"))
