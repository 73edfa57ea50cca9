from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import pieces


def whole(text, limit, overlap):
    parts = pieces.pieces(text, limit, overlap)
    out = ""
    for a, z, again in parts:
        assert 0 < z - a <= max(limit, 1) and (not again or out.endswith(text[a:a + again]))
        out += text[a + again:z]
    assert out == text
    return parts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .\n,é́👍🏽‍"), min_size=1, max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_hold_the_text(text, limit, overlap):
    whole(text, limit, overlap)


def test_boundaries_and_overlap():
    text = ("A sentence of words here. " * 40 + "\n\n") * 6
    parts = whole(text, 2000, 100)
    assert all(100 <= again <= 140 for _, _, again in parts[1:]) and len(parts) == -(-(len(text) - 100) // 1900)
    assert sum(text[:z].endswith(("\n", ". ")) for _, z, _ in parts) == len(parts)
    sizes = [z - a for a, z, _ in parts]
    assert max(sizes) < 1.8 * min(sizes)


def test_rows(spark):
    chunks = spark.createDataFrame([("c1", "pdf", "x " * 30, 1), ("c1", "pdf", "x " * 30, 1), ("c2", "pdf", "short", 2), ("c3", "pdf", None, 3), ("c4", "other", "y" * 500, 4), (None, "pdf", "z" * 61, 5)], "chunk_id string, source_type string, text string, piece_no int")
    limits = spark.createDataFrame([("pdf", "char", 50, 10), ("container", "token", 8, 0), (None, "char", 1, 1)], "item_kind string, unit string, max_size int, overlap int")
    got = pieces.split_oversized(chunks, limits).collect()
    assert {r.chunk_id for r in got} == {"c1", None} and all(len(r.text) <= 50 for r in got) and len({r.piece_id for r in got}) == len(got)
    assert {r.chunk_id for r in pieces.oversized(chunks, limits).collect()} == {"c1", None}
    assert pieces.split_oversized(chunks.limit(0), limits).count() == 0 and pieces.split_oversized(chunks, limits.limit(0)).count() == 0


def test_starts_are_no_marks_and_begin_words():
    marks = "e\u0301" * 400
    assert all(text[0] == "e" for text in (marks[a:z] for a, z, _ in whole(marks, 101, 21)))
    words = "several ordinary words of many lengths without any stop " * 40
    parts = whole(words, 400, 50)
    assert len(parts) > 3 and all(words[a - 1].isspace() for a, _, _ in parts[1:]) and all(50 <= again <= 90 for _, _, again in parts[1:])


def test_long_blank_run():
    text = "a" * 300 + "\n" + " " * 200 + "\n" + "b" * 300
    whole(text, 520, 0)
    assert pieces.cut_points(text, 520, 0)[0] >= 300
