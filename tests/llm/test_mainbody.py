from lorewell.llm import mainbody

PAGE = """Docs | About | Changelog
We use cookies to measure traffic. By continuing you agree.
Accept all  Reject
On tokens
A good index keeps tokens, and a better one keeps their places. It took two passes to build.

Search
* exact terms
* near terms
Cookie banners hide many words, so the crawler should skip them first.

Keep reading
Notes on the shared cache
From trace to graph

The last paragraph says what was found, in one sentence.
Share this page
Riverdesk is run by the Studio of the same name.
Privacy
Terms
© 2024 Riverdesk Press"""


def test_page():
    dropped = [x for x, k in zip(PAGE.split("\n"), mainbody.body_lines(PAGE, "riverdesk")) if not k]
    assert dropped == ["Docs | About | Changelog", "We use cookies to measure traffic. By continuing you agree.", "Accept all  Reject", "Keep reading", "Notes on the shared cache", "From trace to graph",
                       "Share this page", "Riverdesk is run by the Studio of the same name.", "Privacy", "Terms", "© 2024 Riverdesk Press"]


def test_edges():
    assert mainbody.body_lines("") == [True] and mainbody.body_lines("\n\n") == [True] * 3
    assert mainbody.body_lines("Privacy\nTerms") == [False, False] and mainbody.body_lines("Heading\n* a\n* b") == [True] * 3
    assert mainbody.body_lines("x" * 100_000) == [True]
    assert mainbody.site_of("https://www.river-desk.example:80/a") == "river-desk" and mainbody.site_of(None) == "" and mainbody.site_of("inputs/a.pdf") == ""


def test_rows(spark):
    chunks = spark.createDataFrame([("c1", "r1", "webpage", PAGE, None, "u"), ("c1", "r1", "webpage", PAGE, None, "u"), ("c2", "gone", "webpage", "Privacy", None, "u"), ("c3", "r1", "pdf", "Privacy", None, "u"), ("c4", "r1", "webpage", None, None, "u"), ("c5", None, "webpage", "A body line of some words here.", None, "u")],
                                   "chunk_id string, resource_id string, source_type string, text string, title string, url string")
    res = spark.createDataFrame([("r1", "https://riverdesk.example/a", "z")], "id string, original_url string, text string")
    got = mainbody.boilerplate(chunks, res).collect()
    assert len(got) == 12 and sum(r.chunk_id == "c2" for r in got) == 1
    bodies = {r.chunk_id: r.text for r in mainbody.main_bodies(chunks, res).collect()}
    assert set(bodies) == {"c1", "c2", "c5"} and bodies["c2"] == "" and bodies["c1"].startswith("On tokens")
    assert mainbody.boilerplate(chunks.limit(0), res).count() == 0 and mainbody.boilerplate(chunks, res.limit(0)).count() > 0


def test_score_decides():
    body = "A good index keeps tokens, and a better one keeps their places. It took two passes, and then one more, to build the whole of it."
    page = ["Gallery | Partners | Workshops | Residencies", "", "Ateliers", "Residencies", "Fellows", "", "On tokens", "", body, "", "Short, but body.", "", "* exact terms", "* near terms", "", "A line with Docs | Guides | Pricing | a way out.", "", "Ateliers", "Residencies", "Fellows"]
    dropped = [i for i, k in enumerate(mainbody.body_lines("\n".join(page))) if not k]
    assert dropped == [0, 2, 3, 4, 17, 18, 19]
    weak = mainbody.body_lines("\n".join([body * 4, "", "Of all docs | guides | pricing | a few more are there."]))
    assert weak == [True, True, False]


ENGLISH = """Products / Solutions / Enterprise / Partners / Investors

How tides are measured
A gauge keeps the height of the water, and a pen writes it down, hour by hour. The paper is changed once a week.

Returns
Shipping
Gift cards
Store locator"""
ITALIAN = """Prodotti | Soluzioni | Aziende | Investitori

Come si misurano le maree
Un galleggiante segue l'altezza dell'acqua, e una penna la scrive, ora per ora. La carta si cambia ogni settimana.

Resi
Spedizioni
Buoni regalo
Trova un negozio"""


def test_menus_in_no_list():
    for page in (ENGLISH, ITALIAN):
        assert mainbody.body_lines(page) == [False, True, True, True, True] + [False] * 4


def test_points_decide(monkeypatch):
    page = "\n".join(["A short line with Docs | Guides | Pricing here.", "", "The long one goes on, and on, and on, until its reader, tired of commas, looks up. " * 4])
    assert mainbody.body_lines(page) == [False, True, True]
    monkeypatch.setattr(mainbody, "points", lambda line: 0.0)
    assert mainbody.body_lines(page) == [True, True, True]


def test_best_of_the_whole_page(spark):
    weak, strong = "A short line with Docs | Guides | Pricing here.", "The long one goes on, and on, and on, until its reader, tired of commas, looks up. " * 4
    rows = lambda page: [("c1", "r1", "webpage", weak, None), ("c2", page, "webpage", strong, None)]
    res = spark.createDataFrame([("r1", "https://riverdesk.example/a"), ("r2", None)], "id string, original_url string")
    of = lambda page: [tuple(r) for r in mainbody.boilerplate(spark.createDataFrame(rows(page), "chunk_id string, resource_id string, source_type string, text string, title string"), res).collect()]
    assert of("r1") == [("c1", 1)] and of("r2") == []


def test_what_comes_again(spark):
    foot, body = "Riverdesk keeps the lights on since 1999", "The gauge {} was read by hand, and then by wire."
    chunks = spark.createDataFrame([(f"c{i}", f"r{i}", "webpage", body.format("abcd"[i]) + "\n\n" + foot + "\nAtelier", f"t{i}") for i in range(4)], "chunk_id string, resource_id string, source_type string, text string, title string")
    res = spark.createDataFrame([(f"r{i}", f"https://riverdesk.example/{i}") for i in range(4)], "id string, original_url string")
    assert {tuple(r) for r in mainbody.boilerplate(chunks, res).collect()} == {(f"c{i}", n) for i in range(4) for n in (3, 4)}
    found = mainbody.web_chunks(chunks, res.union(spark.createDataFrame([("r9", None)], "id string, original_url string"))).collect()
    assert {r.site for r in found} == {"riverdesk"} == {mainbody.site_of("https://riverdesk.example/0")}
