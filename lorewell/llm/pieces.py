"""Problem 2: cut oversized texts into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces that can hold a text is computed, equally long pieces are aimed at, every
target moves to the strongest boundary near it, and a piece more is taken as soon as one of them is above the limit.

Defined results: texts within the limit, null texts and types without a limit give no pieces; a chunk stored twice is
cut once; an overlap of half the limit or more is taken as just under half; neither a cut nor the start of a piece parts a base character from its
marks, joiners or a CR from its LF unless one such cluster alone is above the limit. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a match's end is a place to cut.
BOUNDARIES = [re.compile(p) for p in (
    r"\n[ \t\r]*\n\s*",
    r"\n(?=#{1,6}\s|[-*•]\s|\d+[.)]\s)|\n(?=```)",
    r"\n",
    r"[.!?…]['\"”’)\]]*\s+|[。！？]",
    r"[;:,]\s+|\s[–—-]\s|[、，；：]",
    r"\s+",
)]

#: Characters that a piece may repeat beyond the overlap, to begin with a whole word.
WORD = 40


def _inside(text: str, at: int) -> bool:
    """Whether a cut before `at` would part a cluster."""
    if not 0 < at < len(text):
        return False
    here, before = text[at], text[at - 1]
    return unicodedata.combining(here) != 0 or here in "‍︎️" or before == "‍" or "\U0001f3fb" <= here <= "\U0001f3ff" or (before == "\r" and here == "\n")


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], of several the nearest to `target`; else `target`, moved out of clusters."""
    begin = max(0, low - 80)
    while begin > 0 and text[begin - 1].isspace():  # a run of blanks is seen from its beginning
        begin -= 1
    for kind in BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, begin, min(len(text), high + 80)) if low <= m.end() <= high and not _inside(text, m.end())]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    for at in range(target, low - 1, -1):
        if not _inside(text, at):
            return at
    return target


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces of `text` end, the last at its length; piece i begins `overlap` before the end of piece i - 1."""
    n = len(text)
    if n <= limit:
        return [n]
    if limit < 2:
        return list(range(1, n + 1))
    overlap = max(0, min(overlap, (limit - 1) // 2))
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        step = (n - overlap) / count
        # how far a cut may move: the spare room of a piece, or a third of it where there is hardly any
        room = max(1, int(min(max((limit - overlap) - step, step / 3), step / 2)))
        cuts, last = [], 0
        for i in range(1, count):
            target = int(overlap + step * i)
            high = min(target + room, last + limit - (overlap if last else 0), n - 1)
            low = max(target - room, last + 1, overlap + 1)
            if low > high:
                break
            cuts.append(_snap(text, min(max(target, low), high), low, high))
            last = cuts[-1]
        else:
            if n - last + (overlap if last else 0) <= limit:
                return [*cuts, n]
        if count >= n:
            return list(range(limit, n, limit - overlap)) + [n]
        count += 1


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, repeated) of each piece in order; `repeated` characters stand at the end of the piece before.

    A piece repeats what is asked, and where the limit has room for it what is before that up to the beginning of its
    word, at most WORD characters; where it hasn't, it repeats less by what is left of a cluster.
    """
    ends = cut_points(text, limit, overlap)
    overlap = max(0, min(overlap, (limit - 1) // 2))
    out, last, before = [], 0, 0
    for end in ends:
        start = last - min(overlap, last)
        if overlap and start:
            # the start must stay behind the start of the piece before, and the piece within the limit
            least = max(before + 1, end - limit, start - WORD)
            back = next((at for at in range(start, least - 1, -1) if (text[at - 1].isspace() and not text[at].isspace()) and not _inside(text, at)), None)
            if back is None:
                back = next((at for at in range(start, least - 1, -1) if not _inside(text, at)), None)
            start = back if back is not None else next((at for at in range(start, last) if not _inside(text, at)), last)
        out.append((start, end, last - start))
        last, before = end, start
    return out


def read_limits(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """item_kind -> (max_size, overlap) for the unit char; the table of settings is checked to be small."""
    rows = limits.filter("unit = 'char' AND item_kind IS NOT NULL AND max_size > 0").select("item_kind", "max_size", F.coalesce("overlap", F.lit(0))).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("size_limits is a table of settings: at most 1000 rows")
    return {r[0]: (r[1], r[2]) for r in rows}


SCHEMA = "chunk_id string, piece_id string, piece_no int, n_pieces int, source_type string, start_char int, end_char int, repeated int, text string"


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """One row for each piece of each chunk longer than the limit of its type."""
    sizes = read_limits(limits)
    limit = F.create_map(*[F.lit(x) for k, (m, _) in sorted(sizes.items()) for x in (k, m)]) if sizes else F.create_map().cast("map<string,int>")
    long = chunks.select("chunk_id", "source_type", "text").filter(F.length("text") > limit[F.col("source_type")])
    long = long.dropDuplicates(["chunk_id", "source_type", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                m, v = sizes[r["source_type"]]
                parts = pieces(r["text"], m, v)
                mark = hashlib.sha256(r["text"].encode("utf-8", "replace")).hexdigest()[:8]
                for k, (a, z, again) in enumerate(parts):
                    rows.append((r["chunk_id"], f"{r['chunk_id']}#{mark}-{k:04d}", k, len(parts), r["source_type"], a, z, again, r["text"][a:z]))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return long.mapInArrow(run, SCHEMA)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of every chunk that had to be cut."""
    return split_oversized(chunks, limits).filter("piece_no = 0 AND n_pieces > 1").select("chunk_id").distinct()
