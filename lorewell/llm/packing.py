"""Problem 7: fill containers of a fixed capacity with whole items.

Sizes are whole numbers up to the capacity, so the plan is made on their histogram, which has at most as many rows as
the capacity whatever the corpus holds. Exact-complement hashing: a container is begun with the largest size left, and
a single, pair or triple of sizes that exactly fills its gap is looked up among the sizes still available; where none
does, the largest size that fits goes in and the lookup is repeated. The pattern so found is used as often as its
sizes allow. Items then take their places by their number within their size, without any sorting of items.

Defined results: an item above the capacity is cut into full containers and a rest, the only items that are cut; items
of size 0 (null and empty texts) lie in container 0, where they take no room; equal sizes are exchangeable, so which of
two items of one size goes where is not defined, only how many containers there are and that none is above capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.bpe import _slices, default_vocabulary, encoder
from lorewell.session import cut


class Sums:
    """The sizes still available, indexed by their single, pair and triple sums.

    The index of pair sums is the convolution of the available sizes with themselves. Sizes only run out, so a sum that
    is not in the index never comes; one that is in it is checked against the counts, and the index is made again when
    it named sums that are gone.
    """

    def __init__(self, free: np.ndarray):
        self.free = free
        self.index()

    def index(self) -> None:
        has = (self.free > 0).astype(np.float64)
        has[0] = 0
        n = len(has)
        width = 1 << (2 * n - 1).bit_length()
        self.pairs = np.fft.irfft(np.fft.rfft(has, width) ** 2, width)[:n] > 0.5
        self.stale = 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available sizes, none above `most`, that add up to `total`; the largest first."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        ok = (self.free[a] > 0) & (self.free[total - a] > (a * 2 == total))
        k = int(np.argmax(ok)) if len(ok) and ok.any() else -1
        if k < 0:
            self.stale += most >= total - 1
            return None
        return int(a[k]), int(total - a[k])

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Up to three available sizes that add up to `gap`, the largest first; None if there are none."""
        if self.free[gap] > 0:
            return (gap,)
        if self.stale > 64:
            self.index()
        if two := self.pair(gap, gap - 1):
            return two
        sizes = np.flatnonzero(self.free[: max(1, gap - 1)] > 0)
        sizes = sizes[(sizes * 3 >= gap) & (sizes > 0)]
        for a in sizes[self.pairs[gap - sizes]][::-1]:
            self.free[a] -= 1
            two = self.pair(gap - int(a), int(a))
            self.free[a] += 1
            if two:
                return (int(a), *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> how many in one container) and how often each is used; every counted item is in one."""
    free = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        free[size] = n
    out, sums = [], Sums(free)
    while True:
        left = np.flatnonzero(free[1:] > 0)
        if not len(left):
            return out
        first = int(left[-1]) + 1
        pattern, gap = {first: 1}, capacity - first
        free[first] -= 1
        while gap:
            more = sums.exact(gap)
            if more is None:
                fits = np.flatnonzero(free[1: gap + 1] > 0)
                if not len(fits):
                    break
                more = (int(fits[-1]) + 1,)
            for s in more:
                free[s] -= 1
                pattern[s] = pattern.get(s, 0) + 1
                gap -= s
        again = min(int(free[s]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            free[s] -= k * again
        out.append((pattern, 1 + again))


def places(patterns: list[tuple[dict[int, int], int]], first: int = 0) -> np.ndarray:
    """Rows (size, first item number, first container, items of the size in a container), sorted by the first two."""
    seen: dict[int, int] = {}
    rows, base = [], first
    for pattern, times in patterns:
        for s, k in pattern.items():
            rows.append((s, seen.get(s, 0), base, k))
            seen[s] = seen.get(s, 0) + k * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


ITEMS = "doc_id {kind}, piece_no int, start_token bigint, n_tokens bigint, part int, nth bigint"


def items_of(docs: DataFrame, capacity: int, vocabulary: str | None, key: str, text: str) -> DataFrame:
    """The pieces of every document, each with its number among those of its size in its partition."""
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = ITEMS.format(kind=src.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for b in _slices(whole):
                sizes = own.sizes_of(b.column(1))
                n = np.maximum(1, -(-sizes // capacity))
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                size = np.minimum(sizes[row] - start, capacity)
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
                begins = np.flatnonzero(fresh)
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.repeat(begins, np.diff(np.append(begins, len(size)))) + seen[ordered]
                np.add.at(seen, size, 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    ["doc_id", "piece_no", "start_token", "n_tokens", "part", "nth"])

    return src.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id) for every document, containers numbered from 0."""
    items = cut(items_of(docs, capacity, vocabulary, key, text))
    kind = items.schema["doc_id"].dataType.simpleString()
    by_part = items.groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
    counts.pop(0, None)
    table = places(plan(counts, capacity))
    ranked = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("n_tokens", "part", F.coalesce(F.sum("n").over(ranked), F.lit(0)).alias("before"))
    numbered = items.join(before, ["n_tokens", "part"]).select("doc_id", "piece_no", "start_token", "n_tokens", (F.col("nth") + F.col("before")).alias("nth"))

    # items of smaller sizes come first, so that an item's number over all sizes stays a 64-bit number at any capacity
    offset = np.zeros(capacity + 2, np.int64)
    for size, n in counts.items():
        offset[size + 1] = n
    offset = np.cumsum(offset)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = offset[table[:, 0]] + table[:, 1]
        for b in batches:
            size = b.column(3).to_numpy(zero_copy_only=False)
            nth = b.column(4).to_numpy(zero_copy_only=False)
            where = np.zeros(len(size), np.int64)
            full = size > 0
            if full.any():
                at = np.searchsorted(code, offset[size[full]] + nth[full], side="right") - 1
                where[full] = table[at, 2] + (nth[full] - table[at, 1]) // table[at, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(where)], ["doc_id", "piece_no", "start_token", "n_tokens", "container_id"])

    return numbered.mapInArrow(place, f"doc_id {kind}, piece_no int, start_token bigint, n_tokens bigint, container_id bigint")


def container_capacity(limits: DataFrame) -> int:
    """The capacity in tokens that the table of settings gives."""
    rows = limits.filter("item_kind = 'container' AND unit = 'token' AND max_size > 0").select(F.min("max_size")).collect()
    if rows[0][0] is None:
        raise ValueError("size_limits has no container capacity in tokens")
    return rows[0][0]
