import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return bpe.Encoder(bpe.default_vocabulary()), t


def same(both, texts):
    own, ref = both
    got = own.encode(pa.array(texts, pa.string()))
    expect = [ref.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert got.to_pylist() == expect
    assert own.sizes_of(pa.array(texts, pa.string())).tolist() == [len(e) for e in expect]


def test_known_cases(both):
    same(both, ["", None, "  a  b", "   's", "a  'll", "aaaaaaaaaaaaa", "<|endoftext|>", "x　　y", "x\x0b\x0cz\u0085 q", "￿  a  b", "а" * 300, "👩‍💻  ½②", "word " * 500, "ab\x00c  d", "\r\n\r\n x"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_any_text(both, texts):
    same(both, [t.replace("\x1c", " ").replace("\x1d", " ").replace("\x1e", " ").replace("\x1f", " ") for t in texts])


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(docs).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.token_counts(docs).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


def test_forgetting(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(bpe, "MAX_KNOWN_WORDS", 1)
    same(both, ["some words here", "and other words"])
    same(both, ["yet more of them"])


def test_long_words_and_twins(both):
    import random
    import time

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24_000)), "a" * 24_000, "ab" * 999 + "a" * 31, "é" * 500 + "ñ" * 333, "=-" * 400 + "=" * 77]
    same(both, words + ["".join(r.choice("aab") for _ in range(n)) for n in range(1, 200)])
    began = time.thread_time()
    both[0].forget()
    both[0].encode(pa.array([words[0]]))
    assert time.thread_time() - began < 10  # about one second alone on a machine


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_decoding(both, texts):
    own, _ = both
    assert own.decode(own.encode(pa.array(texts))).to_pylist() == texts


def test_decoding_rows(spark):
    docs = spark.createDataFrame([(1, "hello  world\n"), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()) == [(1, "hello  world\n"), (2, ""), (3, "")]
    none = spark.createDataFrame([(4, None)], "doc_id bigint, ids array<int>")
    assert [tuple(r) for r in bpe.decode_documents(none).collect()] == [(4, None)]
