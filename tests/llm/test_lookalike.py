import pytest

from lorewell.llm import lookalike


def test_tables():
    lookalike.check_tables()


@pytest.fixture(scope="module")
def form():
    import pyarrow as pa

    def run(text):
        lookalike.database().register("texts", pa.table({"doc_id": [1], "text": pa.array([text], pa.string())}))
        return lookalike.database().sql(lookalike.FORM_QUERY).fetchall()[0][1]

    return run


def test_same_look(form):
    for a, b in (("Ｗｉｄｅ １２", "Wide 12"), ("café", "café"), ("a​b­c", "abc"), ("a b", "a b"), ("раураl", "paypal"), ("ﬁne ﬂow", "fine flow"), ("x\r\ny", "x\ny"),
                 ("Größe".replace("ö", "ӧ"), "Größe"), ("end  \n", "end"), ("привет", "пpивeт"), ("ｋ́", "ḱ")):
        assert form(a) == form(b), (a, b)


def test_other_look(form):
    for a, b in (("A", "a"), ("cafe", "café"), ("x2", "x²"), ("3", "③"), ("a  b", "a b"), ("👩‍💻", "👩💻"), ("1/2", "½"), ("Й", "И"), ("l", "1")):
        assert form(a) != form(b), (a, b)


def test_script_of_a_word(form):
    assert form("пpивeт") == "привет" and form("wоrd") == "word" and form("λόγoς") == "λόγος" and form(None) is None and form("") == ""


def test_pairs(spark):
    rows = [(1, "cafe x"), (2, "cafe x"), (3, "cafe x"), (4, "ｃafe x"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "other")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, look string")
    got = {tuple(r) for r in lookalike.same_looks(docs).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    assert lookalike.same_looks(docs.limit(0)).count() == 0


def test_hot_spelling(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(300)] + [(1000, "same text")], "doc_id bigint, text string")
    assert {tuple(r) for r in lookalike.same_looks(docs).collect()} == {(i, 1000) for i in range(300)}
