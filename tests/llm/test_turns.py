import random

from lorewell.llm import turns

CAST = ((1, "Velka Hollmere", "host"), (2, "Lumobo Drovick", "guest"), (3, "Mirel Gildwood", "guest"))


def read(text, people=CAST):
    cast, parse = turns.reader(people)
    assert parse(text, 0)[0] == len(text)
    return [(who, words) for who, words, _ in turns.segments(text, cast, parse) if who or words]


def test_ways_to_name():
    for label in ("Velka Hollmere:", "VELKA:", "Hollmere :", "V. Hollmere:", "VH:", "Speaker 1:", "SPEAKER 01:", "S1:", "Host:", "**Velka:**", "*Velka:*", ">> Velka:", "- HOST :", "<v Velka Hollmere>", "[Velka Hollmere]", "(host)", "Vekla:"):
        assert read(f"{label} well said.") == [("Velka Hollmere", "well said.")], label
    assert read("Guest: who?") == [(None, "Guest: who?")]  # two guests
    assert read("Step two: keep it. One note: done.") == [(None, "Step two: keep it. One note: done.")]


def test_stamps_notes_fillers():
    t = "[0:00:01.0] S1: Uhm, we start at 10:30 (door (loudly) closes) and keep a [MASK] token ♪ tune ♪ here. 00:05 - S2: Hmm. <00:00:09.5> S2: I mean, *coughs* yes {crosstalk}."
    assert read(t) == [("Velka Hollmere", "we start at 10:30 and keep a [MASK] token here."), ("Lumobo Drovick", ""), ("Lumobo Drovick", "yes.")]
    assert turns.seconds("[1:02:03.5]") == 3723.5 and turns.seconds("(00:07)") == 7.0
    for bad in ("((", "[", "♪", "*", "<", "x [y", "a: b :", ">> - **", "::", "\n\n", "٣"):
        read(bad)


def chunks(spark, rows):
    return spark.createDataFrame(rows, "resource_id string, chunk_id string, source_type string, start_time double, end_time double, text string, people string")


def cast_table(spark, ids):
    return spark.createDataFrame([(i, s, n, r) for i in ids for s, n, r in CAST] + [(None, 1, "X", None), ("r0", 9, None, None)], "resource_id string, slot int, full_name string, role string")


def test_turns_over_chunks(spark):
    rows = [("r0", "c0", "youtube", 0.0, None, "S1: one. still one.", "k"), ("r0", "c1", "youtube", 5.0, 1.0, "more of one. S2: Um... S1: again one.", "k"), ("r0", "c1", "youtube", 5.0, 1.0, "more of one. S2: Um... S1: again one.", "k"),
            ("r0", "c2", "youtube", 9.0, 12.0, "Lumobo: two.", "k"), ("r0", "c3", "pdf", 10.0, 12.0, "S1: no transcript", "k"), ("r0", "c4", "youtube", 20.0, 21.0, None, "k"), (None, "c5", "youtube", 1.0, 2.0, "S1: x", "k"), ("lost", "c6", "youtube", 1.0, 2.0, "S1: x", "k")]
    c, s = chunks(spark, rows), cast_table(spark, ["r0"])
    assert sorted(tuple(r) for r in turns.found_turns(c, s).collect()) == [("r0", 1, "Velka Hollmere", "c0"), ("r0", 2, "Lumobo Drovick", "c2")]
    parts = turns.spoken_turns(c, s).orderBy("turn_no", "start_time").collect()
    assert [(p.turn_no, p.chunk_id, p.words) for p in parts] == [(1, "c0", "one. still one."), (1, "c1", "more of one. again one."), (2, "c2", "two.")]
    assert turns.found_turns(c.limit(0), s).count() == 0 and turns.found_turns(c, s.limit(0)).count() == 0


def test_long_transcript_over_many_partitions(spark):
    rng = random.Random(4)
    rows, expect, state = [], [], turns.State()
    for i in range(200):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            n = rng.choice([None, None, 1, 2, 3])
            spoken = rng.random() > 0.3
            parts.append((n, spoken))
        text = " ".join(("" if n is None else f"S{n}: ") + ("word." if spoken else "Hmm.") for n, spoken in parts) or "Uh."
        rows.append(("r0", f"c{i:03d}", "local_audio", float(i), None, text, "k"))
        for n, spoken in parts:
            if state.step(dict((s, x) for s, x, _ in CAST)[n] if n else None, spoken):
                expect.append(("r0", state.count, state.turn, f"c{i:03d}"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in turns.found_turns(chunks(spark, rows), cast_table(spark, ["r0"])).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(expect)


def test_deep_and_unclosed_brackets():
    import time

    people = ((1, "Ann Bell", None), (2, "Cal Dorn", None))
    known, parse = turns.reader(people)
    deep = "Ann: one " + "[" * 1000 + "noise" + "]" * 1000 + " two. Cal: three."
    assert [(w, s) for w, s, _ in turns.segments(deep, known, parse)][1:] == [("Ann Bell", "one two."), ("Cal Dorn", "three.")]
    began = time.thread_time()
    got = turns.segments("Ann: start " + "(a " * 5000 + "end", known, parse)
    assert got[1][0] == "Ann Bell" and got[1][1].endswith("end") and time.thread_time() - began < 5
    assert [s for _, s, _ in turns.segments("Ann: x [music (loud)] y [a (b] z", known, parse)][1].startswith("x y")
