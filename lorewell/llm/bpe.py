"""Problem 6: encode a corpus with a public byte-level BPE vocabulary.

Each Arrow batch is split into words by an embedded DuckDB query; words not met before by this Python worker are encoded
together by one recursive DuckDB query in which token-position rows join the merge table and every word contracts its
minimum-rank pair from the left until no pair is in the table. Documents are then gathered from the encoded words. An
ordered aggregation over the tokens decodes.

Defined results: a null or empty text has an empty id list; special-token strings are ordinary text; order of rows is
not kept; further columns are dropped; repeated rows are encoded alike.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published word pattern of the vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the word pattern means it, for an engine whose \s is ASCII only.
SPACE = r"\t-\r\x{85}\p{Z}"
#: A noncharacter put before the last white space of a run that a word follows; stands for the pattern's lookahead.
MARK = "￿"
#: Words kept by a Python worker; at the limit the memory is emptied, so that it is bounded for any corpus.
MAX_KNOWN_WORDS = 1_000_000
#: Words encoded by one recursive query.
WORDS_PER_QUERY = 20_000


def default_vocabulary() -> str:
    """The vocabulary file, from LOREWELL_TOKENIZERS or the installed public files."""
    folder = os.environ.get("LOREWELL_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: Each step contracts in every word all pairs that no pair of less rank can reach before: a token that grows out of pairs
#: of less rank until it takes in one of the pair's own tokens would be longer than the longest token there is (`radius`
#: bytes), unless one of these pairs is nearer than that. Of a run of equal pairs that overlap, every other one is taken
#: from the left. So the leftmost pair of least rank is contracted again and again, many places at once. Only the last
#: state of a word is kept: a position that was taken into the one before it has no token any more.
RECURSION = """
WITH RECURSIVE tokens(word, pos, tok, radius, live) USING KEY (word, pos) AS (
    SELECT word, pos, tok, radius, true FROM start_rows
    UNION
    (WITH now AS MATERIALIZED (
        SELECT word, pos, tok, radius, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos
        FROM recurring.tokens WHERE tok IS NOT NULL AND word IN (SELECT word FROM tokens WHERE live)
        WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS MATERIALIZED (
        SELECT p.word, p.pos, p.next_pos, p.radius, p.tok = p.next_tok AS twin, m.rank, m.made,
            m.rank = min(m.rank) OVER (PARTITION BY p.word ORDER BY p.pos RANGE BETWEEN p.radius PRECEDING AND p.radius FOLLOWING) AS least,
            lag(p.next_pos) OVER v IS NOT DISTINCT FROM p.pos AND lag(m.rank) OVER v IS NOT DISTINCT FROM m.rank AS follows
        FROM now p JOIN merges m ON m.lhs = p.tok AND m.rhs = p.next_tok
        WINDOW v AS (PARTITION BY p.word ORDER BY p.pos)
    ), runs AS (
        SELECT *, sum((NOT follows)::INT) OVER (PARTITION BY word ORDER BY pos) AS run FROM ranked
    ), taken AS MATERIALIZED (
        SELECT word, pos, next_pos, radius, made
        FROM (SELECT *, row_number() OVER r AS nth, bool_and(least) OVER (PARTITION BY word, run) AS whole FROM runs WINDOW r AS (PARTITION BY word, run ORDER BY pos))
        WHERE whole AND nth % 2 = 1
    )
    SELECT word, pos, made, radius, true FROM taken
    UNION ALL
    SELECT word, next_pos, NULL, radius, true FROM taken)
)
SELECT word, list(tok ORDER BY pos) FILTER (tok IS NOT NULL) AS ids FROM tokens GROUP BY word ORDER BY word
"""

SPLIT = f"""
SELECT regexp_extract_all(
    regexp_replace(text, '([{SPACE}]+)([{SPACE}])([^{SPACE}])', '\\1{MARK}\\2\\3', 'g'),
    '''(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}{MARK}]+|[{SPACE}]+') AS words
FROM texts
"""


class Encoder:
    """The vocabulary in an embedded database, and the words this worker has encoded so far."""

    def __init__(self, path: str):
        import duckdb
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], dtype=np.int32)
        self.vocab, self.decodes, self.byte_of = vocab, False, {c: b for b, c in enumerate(byte_symbols())}
        self.longest = max(map(len, vocab))
        self.longest_plain = max(len(v) for v in vocab if v.lstrip("Ġ").isascii() and v.lstrip("Ġ").isalpha())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({
            "lhs": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
            "rhs": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "made": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")
        self.exact = regex.compile(WORD_PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode new words and append them to what is known."""
        for at in range(0, len(words), WORDS_PER_QUERY):
            part = words[at:at + WORDS_PER_QUERY]
            raw = [w.encode("utf-8", "surrogatepass") for w in part]
            sizes = np.array([len(r) for r in raw], np.int64)
            first = np.cumsum(sizes) - sizes
            rows = pa.table({
                "word": pa.array(np.repeat(np.arange(len(part), dtype=np.int32), sizes)),
                "pos": pa.array((np.arange(sizes.sum()) - np.repeat(first, sizes)).astype(np.int32)),
                "tok": pa.array(self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]),
                "radius": pa.array(np.repeat(np.array([self.longest_plain if w.isascii() and w.lstrip(" ").isalpha() else self.longest for w in part], np.int32), sizes)),
            })
            self.db.register("start_rows", rows)
            ids = self.db.sql(RECURSION).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start_rows")
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
            self.sizes = np.concatenate([self.sizes, counts])
            self.pool = np.concatenate([self.pool, pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int32)])
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its words, and for all words in order the place among the known ones."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.db.register("texts", pa.table({"text": texts}))
        lists = self.db.sql(SPLIT).to_arrow_table().column("words").combine_chunks()
        self.db.unregister("texts")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        marked = pc.fill_null(pc.match_substring(texts, MARK), False).to_numpy(zero_copy_only=False)
        if marked.any():  # the noncharacter is in a text: split those texts by the published pattern itself
            own = lists.to_pylist()
            for i in np.flatnonzero(marked):
                own[i] = self.exact.findall(texts[int(i)].as_py())
            lists = pa.array(own, pa.list_(pa.string()))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > MAX_KNOWN_WORDS:
            self.forget()
        new = [w for w in names if w not in self.known]
        if new:
            self.learn(new)
        place = np.fromiter((self.known[w] for w in names), np.int64, len(names))
        return counts, place[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)

    def sizes_of(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        counts, place = self.words(texts)
        total = np.concatenate([[0], np.cumsum(self.sizes[place])]) if len(place) else np.zeros(1, np.int64)
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        counts, place = self.words(texts)
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(total[-1]) + np.repeat(self.starts[place] - total[:-1], sizes)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(self.pool[at]))


    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        if not self.decodes:
            table = pa.table({"id": pa.array(list(self.vocab.values()), pa.int32()), "symbols": pa.array(list(self.vocab))})
            self.db.register("vocabulary_in", table)
            self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
            self.db.unregister("vocabulary_in")
            self.decodes = True
        sizes = pc.list_value_length(ids).to_pylist()
        self.db.register("lists", pa.table({"row_no": pa.array(range(len(ids)), pa.int32()), "ids": ids}))
        found = {r: (s, n) for r, s, n in self.db.sql(DECODE).fetchall()}
        self.db.unregister("lists")
        out = []
        for i, size in enumerate(sizes):
            symbols, n = found.get(i, ("", 0))
            if size is not None and n != size:
                raise ValueError("an id that the vocabulary hasn't")
            out.append(None if size is None else bytes(self.byte_of[c] for c in symbols).decode("utf-8", "replace"))
        return pa.array(out, pa.string())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, text: int = 1, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `most` bytes of text each, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_documents(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row of `docs`."""
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(key), F.col(text))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), own.encode(b.column(1))], [key, "ids"])

    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


DECODE = """
SELECT row_no, string_agg(v.symbols, '' ORDER BY i.pos) AS symbols, count(*) AS n
FROM (SELECT row_no, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) i JOIN vocabulary v USING (id)
GROUP BY row_no
"""


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids: the tokens in their order, aggregated and read as UTF-8.

    A null list is a null text, an empty one an empty text; an id that the vocabulary hasn't raises; bytes that are no
    UTF-8 become replacement characters.
    """
    path = vocabulary or default_vocabulary()
    src = encoded.select(F.col(key), F.col(ids).cast("array<int>").alias(ids))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), own.decode(b.column(1))], [key, "text"])

    return src.mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) for every row of `docs`, by the same words and merges, without building the id lists."""
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(key), F.col(text))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.sizes_of(b.column(1)), pa.int64())], [key, "n_tokens"])

    return src.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
