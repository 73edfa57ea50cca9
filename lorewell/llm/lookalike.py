"""Problem 8: bring texts that look the same to one form.

Every Arrow batch runs through one embedded DuckDB query: invisible characters and compatibility forms by regular
expressions, widths, spaces and look-alike letters by `translate`, accents by `nfc_normalize`. The form depends on what
is seen only: letters that Latin shares with Cyrillic or Greek are written in the script of their word, which is Latin
unless a letter of the word exists in the other script alone.

Kept apart, as they look different: case, accents, raised, circled or styled characters, fractions, numbers of spaces,
joined and unjoined emoji, joiners between letters of scripts that join. Defined results: a null text has a null form
and is no case; a text without a visible character has the form '' and is no case; exact copies are no cases of one
another, but each of them is one with every differing text of the same look; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.bpe import _slices

# Letters of one script that are drawn like letters of another.
CYRILLIC_LIKE = "асԁеһіјорԛѕԝхуѐёїӑӓӗӧӱӯАВСЕНІЈКМОРЅТХҮԚԜЀЁЇӐӒӖӦ"
CYRILLIC_AS = "acdehijopqswxyèëïăäĕöÿȳABCEHIJKMOPSTXYQWÈËÏĂÄĔÖ"
GREEK_LIKE = "ονόΑΒΕΖΗΙΚΜΝΟΡΤΥΧΆΈΊΌΎΪΫ"
GREEK_AS = "ovóABEZHIKMNOPTYXÁÉÍÓÝÏŸ"
# Spaces of other widths, invisible characters, hyphens drawn alike, scripts in which joiners show.
SPACES = "  " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
HYPHENS = "‐‑"
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}"
EMOJI = r"\x{2190}-\x{21FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{1F000}-\x{1FAFF}"
JOINING = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{DFF}"
JOINER_MARKS = "﷐﷑"

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
WIDE_AS = "".join(map(chr, range(0x21, 0x7F)))

SEEN = WIDE + SPACES + HYPHENS + "µKÅ" + CYRILLIC_LIKE + GREEK_LIKE
SEEN_AS = WIDE_AS + " " * len(SPACES) + "-" * len(HYPHENS) + "μKÅ" + CYRILLIC_AS + GREEK_AS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _joined(e: str, joiner: str, mark: str) -> str:
    """A joiner that shows is put aside under a mark; twice, as the letters of two neighbouring cases overlap."""
    for both in (EMOJI, JOINING):
        for _ in range(2):
            e = f"regexp_replace({e}, '([{both}])\\x{{{joiner}}}([{both}])', '\\1{mark}\\2', 'g')"
    return e


def form_sql(column: str) -> str:
    """The DuckDB expression of the form of a text column."""
    zwj, zwnj = JOINER_MARKS
    e = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    e = (f"CASE WHEN regexp_matches({column}, '[\\x{{200C}}\\x{{200D}}]') THEN {_joined(_joined(e, '200D', zwj), '200C', zwnj)} ELSE {e} END")
    e = f"regexp_replace({e}, '[{INVISIBLE}]+', '', 'g')"
    e = f"translate(nfc_normalize({e}), {_quoted(SEEN)}, {_quoted(SEEN_AS)})"
    e = f"translate({e}, '{zwj}{zwnj}', chr(8205) || chr(8204))"
    # Joined letters.
    for joined, apart in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        e = f"replace({e}, '{joined}', '{apart}')"
    e = f"nfc_normalize({e})"
    e = f"regexp_replace(regexp_replace(rtrim({e}, ' ' || chr(9) || chr(10)), '[ \\t]+\\n', chr(10), 'g'), '^\\n+', '')"
    return e


def script_sql(column: str) -> str:
    """The DuckDB expression that writes shared letters in the script of their word."""
    own_c = f"[\\x{{400}}-\\x{{52F}}]"
    own_g = f"[\\x{{370}}-\\x{{3BB}}\\x{{3BD}}-\\x{{3FF}}]"
    return f"""CASE WHEN regexp_matches({column}, '[\\x{{370}}-\\x{{52F}}]') THEN array_to_string(list_transform(
        regexp_extract_all({column}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
        lambda w: CASE WHEN regexp_matches(w, '{own_c}') THEN translate(w, {_quoted(CYRILLIC_AS)}, {_quoted(CYRILLIC_LIKE)})
                       WHEN regexp_matches(w, '{own_g}') THEN translate(w, {_quoted(GREEK_AS)}, {_quoted(GREEK_LIKE)})
                       ELSE w END), '') ELSE {column} END"""


FORM_QUERY = f"SELECT doc_id, {script_sql('form')} AS form FROM (SELECT doc_id, {form_sql('text')} AS form FROM texts)"
KEY_QUERY = f"""
SELECT doc_id, md5(form) AS look, md5(text) AS spelling
FROM (SELECT doc_id, text, {form_sql('text')} AS form FROM texts WHERE text IS NOT NULL)
WHERE regexp_matches(form, '[^\\s\\p{{Z}}]')
"""

_db = None


def database():
    """This process's embedded database."""
    global _db
    if _db is None:
        import duckdb

        _db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    return _db


def _through(query: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = database()
        for whole in batches:
            for b in _slices(whole):
                db.register("texts", pa.table({"doc_id": b.column(0), "text": b.column(1).cast(pa.string())}))
                out = db.sql(query).to_arrow_table()
                db.unregister("texts")
                yield from out.select(names).combine_chunks().to_batches()

    return run


def normalize_looks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form) for every row."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_through(FORM_QUERY, ["doc_id", "form"]), f"doc_id {kind}, form string")


def look_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look, spelling): digests of the form and of the text, for rows with a visible character."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_through(KEY_QUERY, ["doc_id", "look", "spelling"]), f"doc_id {kind}, look string, spelling string")


def same_looks(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_a, doc_b) of texts that look the same and are spelled differently.

    Looks with one spelling are dropped by an aggregate first. Pairs are made between spellings and only then given
    their documents; both steps are salted, so that a spelling with very many copies is spread over tasks.
    """
    from lorewell.session import cut

    keys = cut(look_keys(docs))
    spellings = keys.groupBy("look", "spelling").agg(F.count("*").alias("copies"))
    many = spellings.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    spellings = spellings.select("look", "spelling").join(many, "look", "left_semi")
    pairs = spellings.alias("x").join(spellings.alias("y"), (F.col("x.look") == F.col("y.look")) & (F.col("x.spelling") < F.col("y.spelling"))).select(
        F.col("x.look").alias("look"), F.col("x.spelling").alias("left"), F.col("y.spelling").alias("right"))
    members = keys.join(many, "look", "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    wide = pairs.withColumn("salt", every)
    one = wide.join(members.withColumnRenamed("spelling", "left").withColumnRenamed("doc_id", "d1"), ["look", "left", "salt"])
    one = one.select("look", F.col("right"), "d1", F.pmod(F.xxhash64("d1", "left"), F.lit(salts)).alias("salt"))
    others = members.select("look", F.col("spelling").alias("right"), F.col("doc_id").alias("d2"), every.alias("salt"))
    return one.join(others, ["look", "right", "salt"]).select(F.least("d1", "d2").alias("doc_a"), F.greatest("d1", "d2").alias("doc_b")).filter("doc_a < doc_b").distinct()


def check_tables() -> None:
    """The tables pair characters one to one."""
    assert len(SEEN) == len(SEEN_AS) and len(set(SEEN)) == len(SEEN)
    assert len(CYRILLIC_LIKE) == len(CYRILLIC_AS) == len(set(CYRILLIC_AS)) and len(GREEK_LIKE) == len(GREEK_AS) == len(set(GREEK_AS))
