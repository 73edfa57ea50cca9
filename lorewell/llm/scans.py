"""Problem 1: repair text that was read from scanned pages.

Lines are told apart first: running lines at the edges of pages by the document's title, by the number of their page or
because they come again, page numbers by the pages of the chunk. What is left is body. Every word of the corpus gets an
anagram hash, the sum of its characters' hashes; a confusion of characters changes it by a fixed difference, so rare
words are joined in SQL to frequent words whose hash differs by that of a known confusion, and the candidates, checked
letter by letter, are ranked by frequency. Torn words are found the same way from the parts of frequent words. A line
end is a cut when the joined word is more frequent than the hyphenated one.

Defined results: chunks of other types and null texts are left out; null labels are no case; a chunk stored twice counts
once; a chunk without pages has no page numbers; a null title is taken from another chunk of the document if there is one;
in an empty corpus nothing is found. Clean chunks come out unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.session import cut, small

#: A word is taken for a misreading of another only if that is this many times as frequent ...
RATIO = 20
#: ... and occurs this often.
FREQUENT = 10
#: Rows of a table of corrections that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

# What a scanner reads | what is printed.
CONFUSIONS = """
1 l|1 i|| l|| i|! l|! i|í i|ì i|î i|ï i|i l|l i|0 o|ó o|ò o|ô o|6 o|é e|è e|ê e|ë e|c e|e c|ç c|@ a|á a|à a|â a|ä a|$ s|5 s|9 g|q g|g q|† t|7 t|+ t|f t|t f|ú u|ü u|v y|y v|2 z|z 2|8 b|6 b|b h|h b|n u|u n|n h|vv w|rn m|nn m|m rn|ri n|n ri|ii u|ii n|li h|h li|cl d|d cl|lc k|l< k|tl d|ln m|r' r|r ’|' l|ﬁ fi|ﬂ fl|ﬀ ff|ﬃ ffi|ﬄ ffl|l 1|i 1|o 0|s 5|b 8|g 9|ñ n|å a|ý y
""".strip()

#: Characters that stand in no word, and marks that stand alone only by misreading.
FOREIGN = r"[†‡@$|¦§¢£¥€][a-zà-ÿA-ZÀ-Ý]|[a-zà-ÿA-ZÀ-Ý][†‡@$|¦§¢£¥€]|[ﬀ-ﬆ]"
FOREIGN_FINE = r"\S+@\S+\.\S+|\$[a-zA-Z_]+\b(?=\s*[=({])|https?://\S+"
STRAY = r"(?:^|\s)[■□▪●◆^~°|¦'`´¨¤*†‡](?=\s|$)"
CUTS = "-¬­‐‑"

ROMAN = re.compile(r"(?i)^(?=[ivxlcm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
NUMBER = re.compile(r"(?i)^[\s\-–—·•|\[({<~*]*(?:p(?:age|g\.?|\.)?|seite|s\.|página|pág\.)?\s*([0-9lIi|OoSsBgqzZ]{1,6}|[ivxlcmIVXLCM]{1,8})\s*(?:(?:of|/|von|de)\s*[\dlIOo|]{1,6}|/)?[\s\-–—·•|\])}>~*.]*$")

_fold_pairs = [("rn", "m"), ("nn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")]
_fold_one = str.maketrans("1l|!íìîï0óòôéèêëcç@áàâä$59q†7úüy", "iiiiiiiiooooeeeeeeaaaaassggttuuv", "'’`´~■□▪^° \t­¬…")


def folded(line: str) -> str:
    """A line's letters with everything that scanners confuse made one."""
    s = re.sub(r"\s+", "", line.lower()).translate({0x27: None, 0x2019: None, 0x7e: None, 0x25a0: None, 0x5e: None, 0xb0: None})
    for a, b in _fold_pairs:
        s = s.replace(a, b)
    return s.translate(_fold_one)


def roman(s: str) -> int | None:
    if not ROMAN.match(s):
        return None
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s.lower()]
    return sum(-a if b > a else a for a, b in zip(v, v[1:] + [0]))


def page_number(line: str, first: int | None, last: int | None) -> bool:
    """Whether a line is only the number of one of the pages, misread digits included."""
    m = NUMBER.match(line)
    if not m or first is None:
        return False
    digits = m[1].translate(str.maketrans("lIi|OoSsBgqzZ", "1111005589922"))
    values = {int(digits)} if digits.isdigit() else set()
    if (r := roman(m[1])) is not None:
        values.add(r)
    return any(first <= v <= (last if last is not None else first) for v in values)


def spaced(line: str) -> bool:
    """Whether a line is printed with a space after every letter."""
    parts = line.split()
    return len(parts) >= 6 and sum(len(p) == 1 for p in parts) >= 0.7 * len(parts)


def without_number(line: str, first: int | None, last: int | None) -> tuple[str, bool]:
    """A running line without the page number at one of its ends, and whether there was one."""
    if first is not None:
        for p in (r"^\s*([0-9lIi|OoSs]{1,6}|[ivxlc]{1,7})\s{2,}(\S.*)$", r"^(\s*\S.*?)\s{2,}([0-9lIi|OoSs]{1,6}|[ivxlc]{1,7})\s*$"):
            if m := re.match(p, line):
                number, rest = (m[1], m[2]) if p.startswith(r"^\s*(") else (m[2], m[1])
                if page_number(number, first, last):
                    return rest, True
    return line, False


def near(a: str, b: str) -> bool:
    """Whether two folded lines differ by a letter in eight at most."""
    if a == b:
        return True
    most = max(len(a), len(b)) // 8
    if not a or not b or abs(len(a) - len(b)) > most:
        return False
    # of most + 1 parts of one line, at least one is whole in the other
    size = max(1, len(b) // (most + 1))
    if not any(b[k * size:(k + 1) * size] in a for k in range(most + 1)):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def running(line: str, title: str, first: int | None, last: int | None, heads: bool) -> bool:
    """Whether a line is a running header or footer; `heads`: it may be the title heading the first page."""
    rest, numbered = without_number(line, first, last)
    core = rest.strip()
    low = folded(core)
    if len(low) < 3:
        return False
    if core.startswith("©") or re.match(r"(?i)^\W{0,2}c[hl]{1,2}ap\W?t\W?er['’]?\s*\W{0,2}\s*[\dlIO|]+\W{0,2}:\s", core.replace("†", "t").replace("é", "e").replace("@", "a").replace("ç", "c").replace("Ç", "C")):
        return True
    own = folded(title) if title else ""
    if len(own) < 6:
        return False
    head, _, tail = core.partition(" · ")
    if tail and near(folded(head), own):
        return True
    if near(low, own):
        return not heads or numbered or spaced(core) or (core.upper() == core and title.upper() != title)
    open_end = core.endswith("…") or spaced(core) or (core.upper() == core and any(c.isalpha() for c in core)) or numbered
    return open_end and len(low) >= 6 and near(low, own[:len(low)])


#: Lines longer than this are not wrapped by a page; running lines that come again are looked for where lines that are hold half of the text.
WIDEST = 110
# Captions and numbered headings, which belong to the body.
CAPTION = re.compile(r"(?i)^\s*(?:table|figure|fig\.|tabelle|abbildung|tableau|tabla|figura|related work|references|\d+(?:\.\d+)+\b|[*•\-–]\s)")


def kinds_of(lines: list[str], title: str, first: int | None, last: int | None) -> tuple[list[str], list[tuple[int, str, bool, int]]]:
    """blank, header, page_no or body for each line, and the lines (by number from 1, 0 for what a header tells) that are
    running ones if they come again: at the top of a page, or (then True) at its foot, without an end of a sentence; with
    a digest of the line beside it, as what comes again together is text that is there twice."""
    out: list[str] = []
    again: list[tuple[int, str, bool, int]] = []
    shown = 0
    headed = first != 1
    wrapped = 2 * sum(len(x) for x in lines if len(x) <= WIDEST) >= sum(map(len, lines))
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            out.append("blank")
            continue
        shown += 1
        if page_number(line, first, last):
            out.append("page_no")
            continue
        may = len(s) <= 130 and s[-1] not in ".,;:!?"
        if may and running(line, title, first, last, not headed and shown <= 3):
            out.append("header")
            rest = without_number(line, first, last)[0]
            if " · " in rest or re.match(r"\s*\w+ \d+: ", rest):
                again.append((0, folded(re.split(r" · |^\s*\w+ \d+: ", rest, maxsplit=1)[1]), False, -1))
            continue
        rest, numbered = without_number(line, first, last) if may else (line, False)
        if numbered and wrapped and re.search(r"\S\s{3,}\S", s) and len(rest.split()) >= 2:
            out.append("header")
            again.append((0, folded(rest), False, -1))
            continue
        following = next((x for x in lines[i + 1:i + 2] if x.strip()), "")
        foot = not following or page_number(following, first, last)
        if not headed and shown <= 3 and title and near(folded(line), folded(title)):
            headed = True
        elif may and wrapped and s[-1] not in CUTS and len(s.split()) >= 3 and not CAPTION.match(s):
            if foot:
                again.append((i + 1, folded(rest), True, zlib.crc32(folded(lines[i - 1]).encode("utf-8", "replace")) if i else 0))
            elif s[0].isupper() and (i == 0 or out[-1] != "body"):
                if i == 0 and page_number(lines[1], first, last):
                    out.append("header")
                    continue
                again.append((i + 1, folded(s), False, zlib.crc32(folded(lines[i + 1]).encode("utf-8", "replace")) if i + 1 < len(lines) else 0))
        out.append("body")
    return out, again


def anagram(word: Column) -> Column:
    """The sum of the hashes of a word's characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.when(c == "", 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1_000_000_000_007))))


EDGE = r"^[.,;:()?!\"“”„…\[\]«»]+|[.,;:()?!\"“”„…\[\]«»]+$"


def words_of(text: Column) -> Column:
    """Lower-case words without the punctuation around them."""
    return F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, EDGE, ""))


def lexicon(chunks: DataFrame) -> DataFrame:
    """(word, n) over the texts of all chunks; the copies of a chunk that is stored more than once share its weight."""
    copies = chunks.groupBy("chunk_id").agg(F.count("*").alias("copies")).filter("copies > 1 AND chunk_id IS NOT NULL")
    each = chunks.select("chunk_id", "text").join(small(copies), "chunk_id", "left")
    return each.select(F.explode(words_of(F.col("text"))).alias("word"), (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight")).filter("word <> ''").groupBy("word").agg(F.round(F.sum("weight")).cast("bigint").alias("n"))


def confusions(spark) -> DataFrame:
    """(seen, printed, diff): the table of confusions with the hash difference of each."""
    pairs = [p.rsplit(" ", 1) for p in re.split(r"(?<=\S)\|(?=\S+ )", CONFUSIONS)]
    t = spark.createDataFrame([(a, b) for a, b in pairs], "seen string, printed string")
    return t.withColumn("diff", anagram(F.col("printed")) - anagram(F.col("seen")))


def corrections(words: DataFrame) -> DataFrame:
    """(word, fixed): rare words and the frequent words that they are misreadings of, by anagram hash."""
    spark = words.sparkSession
    known = words.filter("length(word) BETWEEN 3 AND 60").withColumn("value", anagram(F.col("word")))
    frequent = known.filter(F.col("n") >= FREQUENT).select(F.col("word").alias("fixed"), F.col("n").alias("m"), "value").filter(F.col("fixed").rlike("[a-zà-ÿ]{2}"))
    wrong = known.filter(F.col("word").rlike(r"[a-zà-ÿ]")).join(F.broadcast(confusions(spark)), F.expr("contains(word, seen)")).select(
        "word", "n", "seen", "printed", (F.col("value") + F.col("diff")).alias("value"))
    same = """exists(sequence(1, length(word)), i -> substr(word, i, length(seen)) = seen
        AND concat(substr(word, 1, i - 1), printed, substr(word, i + length(seen))) = fixed)"""
    found = wrong.join(frequent, "value").filter(F.col("m") >= F.col("n") * RATIO).filter(F.expr(same))
    return found.groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed"))


def torn_words(words: DataFrame) -> DataFrame:
    """(word, fixed) with `word` two parts and a space between: parts of a frequent word one of which is rare alone."""
    known = words.filter(F.col("word").rlike(r"^[a-zà-ÿ]{2,40}$"))
    whole = known.filter(F.col("n") >= FREQUENT * 3).filter("length(word) >= 5").select(F.col("word").alias("fixed"), F.col("n").alias("m"))
    parts = whole.select("fixed", "m", F.explode(F.expr("sequence(2, length(fixed) - 2)")).alias("at")).select(
        "fixed", "m", F.expr("substr(fixed, 1, at)").alias("left"), F.expr("substr(fixed, at + 1)").alias("right"))
    both = parts.join(known.select(F.col("word").alias("left"), F.col("n").alias("n_left")), "left").join(known.select(F.col("word").alias("right"), F.col("n").alias("n_right")), "right")
    return both.filter(F.least("n_left", "n_right") * RATIO <= F.col("m")).select(F.concat_ws(" ", "left", "right").alias("word"), "fixed")


LINES = "chunk_id string, resource_id string, chunk_index int, label string, n_lines int, lines array<struct<no:int,kind:string,text:string,joined:boolean>>, again array<struct<no:int,line:string,foot:boolean,beside:bigint>>"


def read_lines(chunks: DataFrame) -> DataFrame:
    """Each PDF chunk with its lines and their kinds; body lines have their text."""
    pdf = chunks.filter((F.col("source_type") == "pdf") & F.col("text").isNotNull()).select(
        "chunk_id", "resource_id", "chunk_index", "title", F.col("citation_label").alias("label"), F.col("source_ref.page_start").alias("page_start"), F.col("source_ref.page_end").alias("page_end"), "text")
    titles = pdf.filter("title IS NOT NULL AND trim(title) <> ''").groupBy("resource_id").agg(F.min("title").alias("own_title"))
    src = pdf.join(small(titles), "resource_id", "left").select("chunk_id", "resource_id", "chunk_index", F.coalesce("title", "own_title", F.lit("")).alias("title"), "label", "page_start", "page_end", "text")
    kind = pa.list_(pa.struct([("no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("joined", pa.bool_())]))
    tops = pa.list_(pa.struct([("no", pa.int32()), ("line", pa.string()), ("foot", pa.bool_()), ("beside", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, counts, seen = [], [], []
            for title, first, last, text in zip(*(b.column(c).to_pylist() for c in ("title", "page_start", "page_end", "text"))):
                lines = text.split("\n")
                kinds, again = kinds_of(lines, title, first, last)
                counts.append(len(lines))
                seen.append([{"no": n, "line": x, "foot": f, "beside": v} for n, x, f, v in again])
                lists.append([{"no": i, "kind": k, "text": x if k == "body" else None, "joined": bool(k == "body" and x.rstrip()[-1:] in CUTS and x.rstrip()[-2:-1].isalpha())}
                              for i, (x, k) in enumerate(zip(lines, kinds), 1) if k != "blank"])
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("resource_id"), b.column("chunk_index"), b.column("label"), pa.array(counts, pa.int32()), pa.array(lists, kind), pa.array(seen, tops)],
                                             ["chunk_id", "resource_id", "chunk_index", "label", "n_lines", "lines", "again"])

    return src.mapInArrow(run, LINES)


def ended_words(read: DataFrame) -> DataFrame:
    """(chunk_id, no, left, right, mark) of body lines that end with a hyphen; the next body line may be in the next chunk."""
    body = F.filter("lines", lambda x: x["kind"] == "body")
    within = read.select("chunk_id", "resource_id", "chunk_index", body.alias("body"))
    first_word = "regexp_extract(trim({}), '^[^\\\\p{{L}}\\\\p{{N}}]*([^\\\\s.,;:()?!]+)', 1)"
    ends = within.select("chunk_id", "resource_id", "chunk_index", F.expr("""
        filter(transform(body, (x, i) -> struct(x.no AS no, x.joined AS joined, x.text AS text, if(i + 1 < size(body), body[i + 1].text, NULL) AS next)), y -> y.joined)""").alias("ends"))
    ends = ends.select("chunk_id", "resource_id", "chunk_index", F.explode("ends").alias("e")).select("chunk_id", "resource_id", "chunk_index", "e.no", "e.text", "e.next")
    opening = within.filter("size(body) > 0").select("resource_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.expr("body[0].text").alias("opening")).groupBy("resource_id", "chunk_index").agg(F.min("opening").alias("opening"))
    inside = ends.filter("next IS NOT NULL").withColumn("after", F.col("next"))
    across = ends.filter("next IS NULL").join(opening, ["resource_id", "chunk_index"], "left").withColumn("after", F.col("opening")).drop("opening")
    both = inside.unionByName(across)
    return both.select("chunk_id", "no", F.expr("lower(regexp_extract(rtrim(text), '([^\\\\s]+).$', 1))").alias("left"), F.expr("right(rtrim(text), 1)").alias("mark"),
                       F.lower(F.expr(first_word.format("after"))).alias("right")).withColumn("left", F.regexp_replace("left", EDGE, "")).withColumn("right", F.regexp_replace("right", EDGE, ""))


def cut_words(read: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, no) of the body lines whose last word the layout cut."""
    ends = ended_words(read)
    ends = ends.withColumn("whole", F.concat("left", "right")).withColumn("parted", F.concat("left", F.lit("-"), "right"))
    one = words.select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    two = words.select(F.col("word").alias("parted"), F.col("n").alias("n_parted"))
    heads = words.filter(F.col("word").rlike(r"^[^-]+-[^-]")).groupBy(F.regexp_extract("word", r"^([^-]+)-", 1).alias("left")).agg(F.sum("n").alias("n_head"))
    judged = ends.join(one, "whole", "left").join(two, "parted", "left").join(heads, "left", "left").na.fill(0, ["n_whole", "n_parted", "n_head"])
    # without either word in the corpus, a hyphen is the word's own where the part before it often has one
    is_cut = (F.col("n_whole") > F.col("n_parted")) | ((F.col("n_whole") == 0) & (F.col("n_parted") == 0) & ((F.col("mark") != "-") | (F.col("n_head") < FREQUENT)))
    return judged.filter((F.coalesce(F.col("right"), F.lit("")) != "") & is_cut).select("chunk_id", "no")


def suspects(words: DataFrame) -> DataFrame:
    """(word, fixed) of misread and torn words, for a broadcast join if there are few enough."""
    return small(cut(corrections(words).unionByName(torn_words(words))), BROADCAST_ROWS)


def misread(read: DataFrame, wrong: DataFrame) -> DataFrame:
    """(chunk_id, no, word, fixed) of body lines (and labels, with no 0) with a misread or torn word; word is null for marks."""
    body = F.filter("lines", lambda x: x["kind"] == "body")
    texts = read.select("chunk_id", F.explode(F.concat(F.transform(body, lambda x: F.struct(x["no"].alias("no"), x["text"].alias("text"), x["joined"].alias("joined"))),
                                                       F.array(F.struct(F.lit(0).alias("no"), F.col("label").alias("text"), F.lit(False).alias("joined"))))).alias("x")).select("chunk_id", "x.*").filter("text IS NOT NULL")
    plain = F.regexp_replace("text", FOREIGN_FINE, " ")
    marks = texts.filter(plain.rlike(FOREIGN) | F.col("text").rlike(STRAY)).select("chunk_id", "no", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fixed"))
    tokens = texts.withColumn("w", F.split(F.lower("text"), r"\s+"))
    # the part of a cut word at a line's end is no word
    tokens = tokens.withColumn("w", F.when(F.col("joined"), F.expr("slice(w, 1, size(w) - 1)")).otherwise(F.col("w")))
    tokens = tokens.withColumn("pairs", F.expr("transform(slice(w, 2, size(w)), (x, i) -> concat(w[i], ' ', x))"))
    each = tokens.select("chunk_id", "no", F.explode(F.concat("w", "pairs")).alias("word")).withColumn("word", F.regexp_replace("word", EDGE, "")).filter("length(word) > 2")
    return marks.unionByName(each.join(wrong, "word").select("chunk_id", "no", "word", "fixed"))


#: Running lines of a chapter come again within so many chunks; the foot of a page, which names a series or a draft, also in so many documents.
CHAPTER, DOCUMENTS = 12, 3


def running_again(read: DataFrame) -> DataFrame:
    """(chunk_id, no) of lines at the top or the foot of a page that come again near by in their document; of feet also those of several documents."""
    edges = cut(read.select("resource_id", "chunk_id", "chunk_index", F.explode("again").alias("x")).select("resource_id", "chunk_id", "chunk_index", "x.no", "x.line", "x.foot", "x.beside").distinct())
    # overlapping spans of chunks, so that neighbours share at least one and no group grows with its document
    spans = edges.withColumn("span", F.explode(F.array(F.expr(f"chunk_index div {CHAPTER} * 2"), F.expr(f"(chunk_index + {CHAPTER // 2}) div {CHAPTER} * 2 + 1"))))
    often = spans.groupBy("resource_id", "line", "span").agg(F.min("beside").alias("a"), F.max("beside").alias("b")).filter("a < b").select("resource_id", "line", "span")
    near_by = spans.filter("no > 0").join(often, ["resource_id", "line", "span"], "left_semi").select("chunk_id", "no")
    feet = edges.filter("foot")
    known = feet.groupBy("line", "resource_id").agg(F.min("beside").alias("a"), F.max("beside").alias("b")).groupBy("line").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).filter((F.col("n") >= DOCUMENTS) & (F.col("a") < F.col("b"))).select("line")
    return near_by.unionByName(feet.join(small(known), "line", "left_semi").select("chunk_id", "no")).distinct()


def found_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind)."""
    words = cut(lexicon(chunks))
    read = cut(read_lines(chunks))
    edge = read.select("chunk_id", F.explode("lines").alias("x")).filter("x.kind <> 'body'").select("chunk_id", F.col("x.no").alias("line_no"), F.col("x.kind").alias("kind"))
    more = running_again(read).select("chunk_id", F.col("no").alias("line_no"), F.lit("header").alias("kind"))
    hyphens = cut_words(read, words).select("chunk_id", F.col("no").alias("line_no"), F.lit("hyphen").alias("kind"))
    glyphs = misread(read, suspects(words)).select("chunk_id", F.col("no").alias("line_no"), F.when(F.col("no") == 0, "label").otherwise("glyph").alias("kind"))
    every = edge.unionByName(more).unionByName(hyphens).unionByName(glyphs)
    # a header has no other kind
    kinds = every.groupBy("chunk_id", "line_no").agg(F.collect_set("kind").alias("kinds"))
    return kinds.select("chunk_id", "line_no", F.explode(F.when(F.array_contains("kinds", "header"), F.array(F.lit("header"))).otherwise(F.col("kinds"))).alias("kind"))


_edge = re.compile(EDGE.replace("\\\"", '"'))
_stray = re.compile(STRAY)
_cell = re.compile(r"\S\s{2,}\S")


def cased(word: str, like: str) -> str:
    """A lower-case word in the case of another."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters[:1] and letters[0].isupper() else word


def corrected(line: str, fixes: dict[str, str]) -> str:
    """A line with its misread and torn words put right and stray marks left out."""
    line = _stray.sub("", line)
    if not fixes:
        return line
    out: list[str] = []
    parts = re.split(r"(\s+)", line)
    i = 0
    while i < len(parts):
        p = parts[i]
        if i + 2 < len(parts) and p.strip():
            both = p + " " + parts[i + 2]
            core = _edge.sub("", both)
            if core.lower() in fixes and " " in core:
                out.append(both.replace(core, cased(fixes[core.lower()], core)))
                i += 3
                continue
        core = _edge.sub("", p)
        out.append(p.replace(core, cased(fixes[core.lower()], core)) if core and core.lower() in fixes else p)
        i += 1
    return "".join(out)


def flowing(lines: list[tuple[int, str]], hyphens: set[int], own: set[int]) -> str:
    """Numbered lines as paragraphs; a blank line or a table row parts them. Lines of `hyphens` end inside a word, those
    of `own` with a hyphen that the word has anyway."""
    out: list[str] = []
    last = 0
    for no, text in lines:
        text = text.rstrip()
        if not out:
            out.append(text)
        elif last in hyphens:
            out[-1] = out[-1][:-1] + text.lstrip()
        elif last in own:
            out[-1] += text.lstrip()
        elif no != last + 1:
            out.append(text)
        elif _cell.search(text.strip()) or _cell.search(out[-1].rsplit("\n", 1)[-1].strip()):
            out[-1] += "\n" + text
        else:
            out[-1] += " " + text.lstrip()
        last = no
    return "\n\n".join(out)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, citation_label) of each PDF chunk: scanned ones as continuous paragraphs, clean ones unchanged.

    A line that ends inside a word is joined with the next body line of its chunk; where that is in the next chunk, the
    part of the word stays with its mark.
    """
    words = cut(lexicon(chunks))
    read = cut(read_lines(chunks))
    notes = running_again(read).select("chunk_id", "no", F.lit("header").alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fixed"))
    notes = notes.unionByName(cut_words(read, words).select("chunk_id", "no", F.lit("hyphen").alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fixed")))
    notes = notes.unionByName(misread(read, suspects(words)).select("chunk_id", "no", F.lit("glyph").alias("kind"), "word", "fixed"))
    by_chunk = notes.groupBy("chunk_id").agg(F.collect_set(F.struct("no", "kind", "word", "fixed")).alias("notes"))
    whole = chunks.filter(F.col("source_type") == "pdf").select("chunk_id", "text", "citation_label").dropDuplicates(["chunk_id"])
    src = whole.join(read.select("chunk_id", "lines").dropDuplicates(["chunk_id"]), "chunk_id", "left").join(by_chunk, "chunk_id", "left").select("chunk_id", "text", "citation_label", "lines", "notes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for r in b.to_pylist():
                notes, lines = r["notes"] or [], r["lines"] or []
                fixes = {n["word"]: n["fixed"] for n in notes if n["word"]}
                heads = {n["no"] for n in notes if n["kind"] == "header"}
                hyphens = {n["no"] for n in notes if n["kind"] == "hyphen"}
                body = [(x["no"], x["text"]) for x in lines if x["kind"] == "body" and x["no"] not in heads]
                noisy = bool(notes) or len(body) < len(lines)
                wrapped = any(n == m + 1 and a.rstrip()[-1:] not in (".", "!", "?", ":", "") and z.lstrip()[:1].islower() for (m, a), (n, z) in zip(body, body[1:]))
                label = r["citation_label"]
                if r["text"] is not None and (noisy or wrapped):
                    # numbers close up over lines taken out, so that a paragraph goes on across them
                    gone = sorted({x["no"] for x in lines} - {n for n, _ in body})
                    shift = lambda n: n - sum(g < n for g in gone)
                    kept = {n: shift(n) for n, _ in body}
                    text = flowing([(kept[n], corrected(x, fixes)) for n, x in body], {kept[n] for n in hyphens if n in kept}, {kept[x["no"]] for x in lines if x["joined"] and x["no"] in kept and x["no"] not in hyphens})
                    label = corrected(label, fixes) if label is not None else None
                else:
                    text = r["text"]
                out[0].append(r["chunk_id"])
                out[1].append(text)
                out[2].append(label)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["chunk_id", "text", "citation_label"])

    return src.mapInArrow(run, "chunk_id string, text string, citation_label string")
