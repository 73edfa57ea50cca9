"""Scalar text, time and predicate functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop-words of the index and of queries.
STOPWORDS = """a about above after again all also an and any are as at be because been before being below between both but by can could did do does doing
down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only
or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when
where which while who whom why will with would you your""".split()

NOT_WORD = r"[^\p{L}\p{N}_\s]+"


def tokens(text: Column, min_length: int = 2, drop_stopwords: bool = True, drop_numeric: bool = False) -> Column:
    """Lower-case words: symbols become spaces, then split; short words and stop-words are dropped. Null gives []."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), r"\s+")
    keep = lambda w: F.length(w) >= min_length
    if drop_stopwords and drop_numeric:
        return F.filter(words, lambda w: keep(w) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\p{Nd}+$"))
    if drop_stopwords:
        return F.filter(words, lambda w: keep(w) & ~w.isin(STOPWORDS))
    return F.filter(words, keep)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank or null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("bigint")


def half_even(x: Column) -> Column:
    return F.bround(x.cast("double"), 0)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half to even."""
    return half_even(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    """The larger of words-and-symbols and a quarter of the characters, at least 1; 0 for blank or null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parts = F.size(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), 0))
    return F.when(t == "", 0).otherwise(F.greatest(parts, F.ceil(F.length(t) / F.lit(4.0)), F.lit(1))).cast("bigint")


def trim_text(text: Column, cap: int) -> Column:
    """At most `cap` characters, cut back to a space where there is one, with `...`."""
    t = F.coalesce(text, F.lit(""))
    if cap <= 0:
        return t
    if cap <= 3:
        return F.when(F.length(t) <= cap, t).otherwise(F.lit("." * cap))
    head = F.substring(t, 1, cap - 3)
    back = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (back > 0), F.substring(head, F.lit(1), back)).otherwise(head)
    return F.when(F.length(t) <= cap, t).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("...")))


def slug(text: Column) -> Column:
    """Runs of other characters than ASCII letters and digits become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def anchor_slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), r"[:/]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-]", "-"), r"-+", "-"), r"^-+|-+$", "")


def short_label(chunk_id: Column) -> Column:
    hit = F.regexp_extract(chunk_id, r"-([a-z]\d{3,})$", 1)
    return F.when(hit != "", hit).otherwise(chunk_id)


def route(prefix: str, ident: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(ident, F.lit(":"), F.lit("_")))


def table_cell(text: Column) -> Column:
    """Text for a Markdown table: one line, pipes escaped."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def format_seconds(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(seconds).cast("int")
    h, m, x = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, x)).otherwise(F.format_string("%02d:%02d", m, x))


def parse_clock(text: Column) -> Column:
    """Seconds of [h:]m:s(.f)."""
    p = F.split(text, ":")
    last = F.element_at(p, -1).cast("double")
    return F.when(F.size(p) == 3, F.get(p, F.lit(0)).cast("int") * 3600 + F.get(p, F.lit(1)).cast("int") * 60 + last).when(F.size(p) == 2, F.get(p, F.lit(0)).cast("int") * 60 + last).otherwise(last)


def redact(text: Column) -> Column:
    """Secrets in a text are replaced."""
    s = F.regexp_replace(text, r"Bearer\s+[A-Za-z0-9._~+/=-]+", "[redacted]")
    s = F.regexp_replace(s, r"(?i)(api[_-]?key|token|authorization)(\s*[:=]\s*)[A-Za-z0-9._~+/=-]+", "$1$2[redacted]")
    return F.regexp_replace(s, r"sk-[A-Za-z0-9]{8,}", "[redacted]")


def replaceable_title(title: Column) -> Column:
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", "untitled", "unknown resource")


def display_title(title: Column, fallback: Column) -> Column:
    return F.when(replaceable_title(title), fallback).otherwise(F.trim(title))


def contains_keyword(text: Column, keyword: str) -> Column:
    """A phrase anywhere, or a single word as a whole."""
    if " " in keyword:
        return text.contains(keyword)
    quoted = "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in keyword)
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}($|[^\p{{L}}\p{{N}}_])")


def difficulty(question: Column) -> Column:
    q = F.lower(question)
    return F.when(q.rlike("compare|why|how would|tradeoff"), "hard").when(q.rlike("how|which"), "medium").otherwise("easy")


def humanize(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, r"[_\-]+", " "))


def provider_name(name: Column) -> Column:
    """A provider's name in one spelling; null and blank give ''."""
    n = F.replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    known = {"ollamacloud": "ollama_cloud", "ollamalocal": "ollama_local", "openai": "openai_compatible", "openaicompatible": "openai_compatible"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(table[n], n)


def section(content: Column, heading: Column) -> Column:
    """What is below the first heading of that name, up to the next one of its level or above; '' without one."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(x, "^(#*)", 1)).alias("level"), F.lower(F.trim(F.regexp_replace(x, "^#+", ""))).alias("name"))), lambda h: h["level"] > 0)
    first = F.get(F.filter(heads, lambda h: h["name"] == F.lower(F.trim(heading))), F.lit(0))
    after = F.get(F.filter(heads, lambda h: (h["i"] > first["i"]) & (h["level"] <= first["level"])), F.lit(0))["i"]
    body = F.slice(F.split(content, "\n"), first["i"] + 2, F.greatest(F.lit(0), F.coalesce(after, F.size(lines)) - first["i"] - 1))
    return F.coalesce(F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", ""), F.lit(""))
