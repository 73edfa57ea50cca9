"""Problem 3: transcripts into ordered speaker turns.

A parsing-expression grammar reads timestamps, nested sound annotations and speaker labels of each chunk; its tree is
turned into segments, each with a speaker if a label names one. Segments are range-partitioned by resource and time, so
that a transcript of any length is spread over tasks; every partition is summed up in at most two rows, from which the
speaker and turn number at its beginning follow, and a second pass numbers the turns.

Defined results: words before any label belong to the speaker before, also across chunks; a transcript with one
speaker needs no label; words before the first label of a transcript with several belong to nobody and make no turn; a
label that names nobody or several people of the cast is ordinary text; hesitation sounds and annotations alone make no
utterance, but their label is the speaker of unlabelled words that follow; a chunk stored twice counts once; chunks
without resource or text, and transcripts without cast, give no turn; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.peg import Node, Parser, choice, many, maybe, named, nested, seq, term, unless
from lorewell.session import pin, small

KINDS = ["youtube", "local_audio", "local_video", "local_transcript"]

# Hesitation sounds, filler phrases, words of sound annotations.
HESITATION = r"u+h+|u+h*m+|e+r+m*|a+h+|h+m+|m+h*m+|e+h+|o+h+"
FILLER = rf"(?:{HESITATION}|you\s+know|i\s+mean)"
#: A bracketed word of capitals alone that is a spoken token, not a sound.
SPOKEN = r"\[(?!MUSIC\]|NOISE\]|APPLAUSE\]|LAUGHTER\]|LAUGHS\]|SILENCE\]|INAUDIBLE\]|CROSSTALK\]|COUGHS?\]|SIGHS?\])[A-Z][A-Z0-9_]*\]"

_filler_start = re.compile(rf"(?i)(?<![\w'’-]){FILLER}(?![\w'’-])(?:[,…]|\.{{2,3}})?")
_word = re.compile(r"\w")


def _swapped(a: str, b: str) -> bool:
    """Whether two words differ by one edit or one exchange of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:] or (len(ra) > 1 and len(rb) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])


class Cast:
    """The people of one transcript and the ways a label may name them."""

    def __init__(self, people: tuple[tuple[int | None, str, str | None], ...]):
        self.people = people
        self.ways: dict[str, set[str]] = {}
        self.names: list[tuple[str, str]] = []
        for slot, full, role in people:
            parts = full.split()
            first, last = parts[0], parts[-1]
            ways = {full, first, last, f"{first[0]}. {last}", f"{first[0]} {last}", f"{last}, {first}", f"{first} {last[0]}.", "".join(p[0] for p in parts)}
            if slot is not None:
                ways |= {f"speaker {slot}", f"speaker {slot:02d}", f"speaker{slot}", f"speaker_{slot:02d}", f"spk {slot}", f"s{slot}", f"s{slot:02d}"}
            if role and role.strip():
                ways.add(role.strip())
            for w in ways:
                self.ways.setdefault(w.lower(), set()).add(full)
            self.names += [(n.lower(), full) for n in {first, last, full}]
        self.found: dict[str, str | None] = {}

    def who(self, label: str) -> str | None:
        """The one person a label names, also if misspelt by a letter."""
        key = re.sub(r"\s+", " ", label).strip()
        if key not in self.found:
            low = key.lower()
            hit = self.ways.get(low, set())
            if len(low) == 2 and low.isalpha() and key != key.upper():
                hit = set()
            if not hit and len(low) >= 4:
                hit = {full for n, full in self.names if _swapped(low, n)}
            self.found[key] = next(iter(hit)) if len(hit) == 1 else None
        return self.found[key]


def grammar(cast: Cast) -> Parser:
    """item* of stamps, notes, labels, spoken tokens and runs of text."""
    clock = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
    stamp = named("stamp", choice(term(rf"\[{clock}\]"), term(rf"\({clock}\)"), term(rf"<{clock}>"), term(r"(?<![\d:.,])\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?"), term(r"(?<![\d:.,])\d{1,2}:\d{2}(?::\d{2})?[ ]+[-–—](?=\s)[ ]*")), lambda t: seconds(t))

    def person(strip: str):
        return lambda t: cast.who(t.strip(strip).removeprefix("v ").strip(" :*"))

    tag = named("label", choice(term(r"<v\s+[^<>\n]{1,60}>"), term(r"\[[^\[\]\n]{1,60}\]:?"), term(r"\([^()\n]{1,60}\):?")), person("<>[]():"))
    # a name is tried with three, two and one words, so that the last words of an unpointed sentence don't join it
    name = choice(*(term(rf"(?:[^\W\d_][\w.’'-]*[ ]+){{{k}}}[^\W_][\w.’'-]*(?=[ ]?:(?!\d))") for k in (2, 1, 0)))
    label = seq(maybe(term(r"(?:>>|[-–—•])[ ]*")), maybe(term(r"\*{1,2}|_{1,2}")), named("label", name, lambda t: cast.who(t)), term(r"[ ]?:"), maybe(term(r"\*{1,2}|_{1,2}")))
    leaf = choice(term(r"<(?!v\s)[A-Za-z][^<>\n]{0,60}>"), term(r"\*[A-Za-z][^*\n:]{0,60}\*(?!\*)"), term(r"♪[^♪\n]*♪|[♪♫]+"))
    note_body = nested({"[": "]", "(": ")", "{": "}"}, leaf, term(r"[^\[\](){}<>♪*\n]+"))
    spoken = named("text", term(SPOKEN))
    note = named("note", note_body)
    run = named("text", term(r"[^\W\d_][\w'’-]*[^\w\[({<♪*>:\-–—•]*|[\w'’-]+[^\w\[({<♪*>:\-–—•]*|[^\w\[({<♪*>\-–—•]+|."))
    special = choice(stamp, spoken, tag, note, label)
    plain = named("text", seq(unless(term(r"[\[({<♪*>\-–—•\d]|[A-Z]")), term(r"(?:[a-zà-ÿ'’,.?!;…\n]+[ \n]*)+")))
    named_word = re.compile(r"[A-Z>*_\-–—•]")

    def item(s: str, i: int):
        if i >= len(s):
            return None
        c = s[i]
        if c in "[({<♪♫*>-–—•_" or c.isdigit() or named_word.match(c):
            r = special(s, i)
            if r is not None:
                return r
        elif (c.isalpha() or c == " ") and (r := plain(s, i)) is not None:
            return r
        elif c.isalpha() and (r := label(s, i)) is not None:
            return r
        return run(s, i)

    return many(item)


def seconds(stamp: str) -> float | None:
    """The seconds of a clock in any brackets."""
    m = re.search(r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?", stamp)
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + (float("0." + m[4]) if m[4] else 0.0) if m else None


def clean(words: str) -> str:
    """Words without hesitation sounds and fillers, in one line."""
    out = _filler_start.sub(" ", words)
    out = re.sub(r"\s+", " ", out)
    out = re.sub(r"\s+([,.;:!?…])", r"\1", out)
    out = re.sub(r"^[\s,.;:!?…–—-]+", "", out)
    return out.strip()


def segments(text: str, cast: Cast, parse: Parser) -> list[tuple[str | None, str, float | None]]:
    """(speaker or None, words, start or None) of each part of a chunk; only the first can have no speaker."""
    tree: list[Node] = parse(text, 0)[1]
    out: list[tuple[str | None, list[str], float | None]] = [(None, [], None)]
    at = None
    for n in tree:
        if n.kind == "stamp":
            at = n.value
            out[-1][1].append("\n")
            if out[-1][2] is None and not any(_word.search(w) for w in out[-1][1]):
                out[-1] = (out[-1][0], out[-1][1], at)
        elif n.kind == "label":
            out.append((n.value, [], at))
        elif n.kind == "text":
            out[-1][1].append(text[n.start:n.end])
        else:
            out[-1][1].append(" ")
    return [(who, clean("".join(w)), t) for who, w, t in out]


@lru_cache(maxsize=4096)
def reader(people: tuple) -> tuple[Cast, Parser]:
    cast = Cast(people)
    return cast, grammar(cast)


SEGMENT = "array<struct<who:string,spoken:boolean,start:double,words:string>>"


def parsed_chunks(chunks: DataFrame, speakers: DataFrame, words: bool) -> DataFrame:
    """Each transcript chunk with its segments, in order over all partitions; without `words` only whether there are any.

    Chunks are put in order before they are read: the ranges are found by a pass over what is partitioned, which would
    read them a second time.
    """
    cast = speakers.filter("full_name IS NOT NULL AND trim(full_name) <> '' AND resource_id IS NOT NULL").groupBy("resource_id").agg(
        F.array_sort(F.collect_set(F.struct("slot", "full_name", "role"))).alias("people"))
    own = chunks.filter(F.col("source_type").isin(KINDS) & F.col("resource_id").isNotNull() & F.col("text").isNotNull()).select("resource_id", "chunk_id", "start_time", "end_time", "text")
    order = ("resource_id", "start_time", "chunk_id")
    src = own.join(small(cast), "resource_id").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = []
            for text, people in zip(b.column("text").to_pylist(), b.column("people").to_pylist()):
                known, parse = reader(tuple((p["slot"], p["full_name"], p["role"]) for p in people))
                only = people[0]["full_name"] if len({p["full_name"] for p in people}) == 1 else None
                segs.append([{"who": who or only, "spoken": bool(_word.search(w)), "start": t, "words": w if words else None} for who, w, t in segments(text, known, parse)])
            kind = pa.list_(pa.struct([("who", pa.string()), ("spoken", pa.bool_()), ("start", pa.float64()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("resource_id", "chunk_id", "start_time", "end_time")] + [pa.array(segs, kind)], ["resource_id", "chunk_id", "start_time", "end_time", "segs"])

    return src.mapInArrow(run, f"resource_id string, chunk_id string, start_time double, end_time double, segs {SEGMENT}")


class State:
    """Where a transcript stands: the speaker by the last label, the speaker of the last turn, the number of turns."""

    __slots__ = ("label", "turn", "count")

    def __init__(self, label: str | None = None, turn: str | None = None, count: int = 0):
        self.label, self.turn, self.count = label, turn, count

    def step(self, who: str | None, spoken: bool) -> bool:
        """Take a segment; True where a turn begins."""
        if who is not None:
            self.label = who
        if not spoken or self.label is None or self.label == self.turn:
            return False
        self.turn, self.count = self.label, self.count + 1
        return True


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of a sorted partition without the second copies of chunks."""
    last = None
    for b in batches:
        for r in b.to_pylist():
            key = (r["resource_id"], r["start_time"], r["chunk_id"])
            if key != last:
                yield r
            last = key


SUMMARY = "part int, place int, resource_id string, leading boolean, first string, runs bigint, turn string, label string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition, what its first and its last resource do to a state."""
    part = TaskContext.get().partitionId()
    done: list[dict] = []
    now: dict | None = None
    for r in _rows(batches):
        if now is None or now["resource_id"] != r["resource_id"]:
            if now is not None and not done:
                done.append(now)
            now = {"part": part, "place": len(done), "resource_id": r["resource_id"], "leading": False, "first": None, "runs": 0, "turn": None, "label": None}
        for s in r["segs"]:
            if s["who"] is not None:
                now["label"] = s["who"]
            if s["spoken"]:
                if now["label"] is None:
                    now["leading"] = True
                elif now["label"] != now["turn"]:
                    now["first"] = now["first"] or now["label"]
                    now["turn"], now["runs"] = now["label"], now["runs"] + 1
    if now is not None:
        done.append(now)
    if done:
        yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int32()), ("place", pa.int32()), ("resource_id", pa.string()), ("leading", pa.bool_()), ("first", pa.string()), ("runs", pa.int64()), ("turn", pa.string()), ("label", pa.string())]))


def states_before(rows: list[dict]) -> dict[int, tuple[str, str | None, str | None, int]]:
    """For each partition the resource it may go on with, and that resource's state so far."""
    out, resource, state = {}, None, State()
    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        if r["resource_id"] != resource:
            resource, state = r["resource_id"], State()
        if r["place"] == 0:
            out[r["part"]] = (resource, state.label, state.turn, state.count)
        if r["leading"]:
            state.step(None, True)
        if r["runs"]:
            state.count += r["runs"] - (r["first"] == state.turn)
            state.turn = r["turn"]
        state.label = r["label"] or state.label
    return out


def number_turns(parsed: DataFrame, found: bool) -> DataFrame:
    """Numbered turns of ordered chunks: with `found` one row where each begins, else one row for each turn and chunk with its words."""
    ordered = pin(parsed)
    # at most two rows a partition
    before = states_before([r.asDict() for r in ordered.mapInArrow(_summaries, SUMMARY).collect()])
    names = ["resource_id", "turn_no", "speaker", "start_chunk_id"] if found else ["resource_id", "turn_no", "speaker", "chunk_id", "start_time", "end_time", "words"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()] + ([] if found else [pa.float64(), pa.float64(), pa.string()])
    schema = "resource_id string, turn_no int, speaker string, " + ("start_chunk_id string" if found else "chunk_id string, start_time double, end_time double, words string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resource, label, turn, count = before.get(TaskContext.get().partitionId(), (None, None, None, 0))
        state, out = State(label, turn, count), []
        for r in _rows(batches):
            if r["resource_id"] != resource:
                resource, state = r["resource_id"], State()
            ends = [r["end_time"] if r["end_time"] is not None and (r["start_time"] is None or r["end_time"] >= r["start_time"]) else None]
            for s in reversed(r["segs"]):  # of each segment, the start of the next that has one
                ends.append(s["start"] if s["start"] is not None else ends[-1])
            for k, s in enumerate(r["segs"]):
                begins = state.step(s["who"], s["spoken"])
                if found:
                    if begins:
                        out.append((resource, state.count, state.turn, r["chunk_id"]))
                elif s["spoken"] and state.label is not None:
                    end = ends[len(r["segs"]) - 1 - k]
                    start = s["start"] if s["start"] is not None else r["start_time"]
                    if out and out[-1][:4] == (resource, state.count, state.turn, r["chunk_id"]):
                        out[-1] = (*out[-1][:5], end, out[-1][6] + " " + s["words"])
                    else:
                        out.append((resource, state.count, state.turn, r["chunk_id"], start, end, s["words"]))
            if len(out) >= 5000:  # chunks end here, so that no row goes on
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return ordered.mapInArrow(run, schema)


def found_turns(chunks: DataFrame, speakers: DataFrame) -> DataFrame:
    """(resource_id, turn_no, speaker, start_chunk_id)."""
    return number_turns(parsed_chunks(chunks, speakers, False), True)


def spoken_turns(chunks: DataFrame, speakers: DataFrame) -> DataFrame:
    """The words and times of each turn, in one row for each chunk it runs through."""
    return number_turns(parsed_chunks(chunks, speakers, True), False)
