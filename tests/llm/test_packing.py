import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import packing


def check(counts, capacity):
    plan = packing.plan(dict(counts), capacity)
    used = {}
    for pattern, times in plan:
        assert sum(s * k for s, k in pattern.items()) <= capacity and times > 0
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * times
    assert used == {s: n for s, n in counts.items() if n}
    return sum(t for _, t in plan)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_hold_everything(counts):
    n = check(counts, 40)
    total = sum(s * k for s, k in counts.items())
    assert n >= -(-total // 40)
    # no two containers that are less than half full
    assert n <= 2 * (total / 40) + 1


def test_few_containers_and_patterns():
    rng = random.Random(1)
    counts = {}
    for _ in range(200_000):
        s = min(2048, max(1, int(rng.lognormvariate(5.5, 1))))
        counts[s] = counts.get(s, 0) + 1
    n = check(counts, 2048)
    assert n <= 1.001 * -(-sum(s * k for s, k in counts.items()) // 2048) + 1
    assert len(packing.plan(counts, 2048)) < 3 * len(counts) + 10


def test_best_fit_reached_exactly():
    assert check({6: 4, 4: 4}, 10) == 4 and check({5: 2, 3: 1, 2: 1}, 10) == 2 and check({10: 3}, 10) == 3 and check({}, 10) == 0


def test_places_cover_every_item():
    table = packing.places(packing.plan({3: 5, 7: 4, 2: 1}, 10))
    assert (np.diff(table[:, 0]) >= 0).all()


def test_documents(spark):
    rows = [(i, "word " * n, "extra") for i, n in enumerate([0, 1, 5, 5, 9, 10, 25, 40])] + [(98, None, "extra"), (99, "", "extra")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string").repartition(3)
    got = packing.pack_documents(docs, 10).collect()
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 10 and {r.doc_id for r in got} == {r[0] for r in rows}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, parts in by.items():
        parts.sort(key=lambda r: r.piece_no)
        at = 0
        for p in parts:
            assert p.start_token == at
            at += p.n_tokens
        assert len(parts) == 1 or all(p.n_tokens == 10 for p in parts[:-1])
    assert set(load) == set(range(len(load)))
    assert packing.pack_documents(docs.limit(0), 10).count() == 0


def test_great_capacity():
    rng = random.Random(5)
    capacity = 131_072
    counts = {}
    for _ in range(3000):
        s = rng.randrange(1, capacity + 1)
        counts[s] = counts.get(s, 0) + 1
    check(counts, capacity)


def test_containers_of_great_capacity(spark):
    rng = random.Random(6)
    capacity, sizes = 65_536, [rng.randrange(1, 65_537) for _ in range(800)]
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    table = packing.places(packing.plan(dict(counts), capacity))
    docs = spark.createDataFrame([(i, " a" * (s // 40)) for i, s in enumerate(sizes)], "doc_id bigint, text string")
    got = packing.pack_documents(docs, capacity).groupBy("container_id").agg({"n_tokens": "sum"}).collect()
    assert len(table) and all(r["sum(n_tokens)"] <= capacity for r in got)


def test_placing_at_great_sizes(spark, monkeypatch):
    """Sizes beyond 32,768 stay in their containers."""
    rng = random.Random(7)
    sizes = [rng.randrange(30_000, 65_537) for _ in range(500)]
    capacity = 65_536
    rows = spark.createDataFrame([(i, 0, 0, s, 0, sum(x == s for x in sizes[:i])) for i, s in enumerate(sizes)], "doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, part int, nth bigint")
    monkeypatch.setattr(packing, "items_of", lambda *a: rows)
    got = packing.pack_documents(rows, capacity).groupBy("container_id").agg({"n_tokens": "sum"}).collect()
    assert sum(r["sum(n_tokens)"] for r in got) == sum(sizes) and max(r["sum(n_tokens)"] for r in got) <= capacity
