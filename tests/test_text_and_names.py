import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltrace.functions import audio, names, text
from voltrace.operators import assembly


def test_turns_of_a_glued_transcript(spark):
    t = "Good day.Executives: Hello  Operator:Welcome. Analysts:   Hi? Executives:  "
    found = spark.createDataFrame([(t,), (None,), ("  ",)], "t string").select(text.parse_turns(F.col("t")).alias("x")).collect()
    assert [(r["role"], r["text"]) for r in found[0]["x"]] == [("unknown", "Good day."), ("management", "Hello"), ("operator", "Welcome."), ("analyst", "Hi?")]
    assert found[1]["x"] == [] == found[2]["x"]


def sections(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    return text.detect_sections(spark.createDataFrame(rows, "call_id long, turn_idx long, role string, text string")).first()


CUE = "We will now begin the question-and-answer session"


@pytest.mark.parametrize(
    ("turns", "boundary", "method", "sure"),
    [
        ([("management", "a"), ("operator", CUE), ("management", "b"), ("analyst", "c")], 1, "operator_cue", True),
        ([("operator", CUE), *[("management", "a")] * 4, ("analyst", "c")], 5, "first_analyst", True),
        ([("management", "a"), ("analyst", "c")], 1, "first_analyst", False),
        ([("management", "a"), ("operator", CUE)], 1, "operator_cue", False),
        ([("unknown", "a"), ("unknown", "press star one")], 1, "text_cue", False),
        ([("unknown", "a"), (None, None)], 2, "none", False),
    ],
)
def test_section_boundaries(spark, turns, boundary, method, sure):
    r = sections(spark, turns)
    assert (r["boundary"], r["method"], r["corroborated"], r["has_qa"]) == (boundary, method, sure, method != "none")


def test_chunks_never_cross_turns_and_keep_long_sentences_whole(spark):
    long = "Long " + "word " * 12 + "end."
    rows = [(1, 0, "One two three. Four five. " + long + " Six."), (1, 1, "short"), (1, 2, None), (1, 3, "  ")]
    found = text.chunk_turns(spark.createDataFrame(rows, "call_id long, turn_idx long, text string"), 6).orderBy("turn_idx", "chunk_in_turn").collect()
    assert [(r["turn_idx"], r["chunk_in_turn"], r["text"], r["oversize"]) for r in found] == [(0, 0, "One two three. Four five.", False), (0, 1, long, True), (0, 2, "Six.", False), (1, 0, "short", False)]


def test_surface_stats(spark):
    rows = [(1, "prepared_remarks", 0, 0, 4, 18, "revenue 12% up fine"), (1, "qa", 1, 0, 1, 4, "why?"), (1, "qa", 2, 0, 1, 3, "3.4")]
    found = {r["scope"]: r for r in text.surface_stats(spark.createDataFrame(rows, "call_id long, section string, turn_idx long, chunk_in_turn int, n_words long, n_chars long, text string")).collect()}
    assert found["full"]["numeric_density"] == pytest.approx(2 / 6) and found["qa"]["question_marks"] == 1 and found["qa"]["n_turns"] == 2 and found["qa"]["words_per_turn"] == 1.0


def test_pooled_vectors(spark):
    rows = [(1, "pre", [1.0, 0.0], 0.0), (1, "qa", [0.0, 2.0], 0.0), (1, "qa", [0.0, 4.0], 0.0), (1, "qa", None, 9.0)]
    df = spark.createDataFrame(rows, "call long, section string, vector array<double>, w double")
    plain = {r["section"]: r["vector"] for r in assembly.pool_scopes(df, "call", "section").collect()}
    assert plain["full"] == pytest.approx([1 / 3, 2.0]) and plain["qa"] == [0.0, 3.0]
    weighted = {r["section"]: r["vector"] for r in assembly.pool_scopes(df, "call", "section", weight="w").collect()}
    assert weighted == plain  # a total weight of zero


def test_probability_cube(spark):
    rows = [(1, "prepared", "management", 0.8, 0.1), (1, "qa", "analyst", 0.2, 0.7), (1, "qa", "operator", 0.6, 0.2)]
    cube = assembly.probability_cube(spark.createDataFrame(rows, "call long, section string, role string, p_positive double, p_negative double"), "call", ["p_positive", "p_negative"], ["management", "analyst"])
    found = {(r["scope"], r["role"]): r for r in cube.collect()}
    assert found["qa", "analyst"]["net"] == pytest.approx(-0.5) and found["qa", "all"]["p_positive"] == pytest.approx(0.4) and found["prepared", "all"]["net"] == pytest.approx(0.7)
    assert ("qa", "operator") not in found and found["full", "all"]["n_chunks"] == 3


def test_outer_blocks_fill_zeros(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "k long, vector array<double>")
    b = spark.createDataFrame([(2, [3.0])], "k long, vector array<double>")
    found = {r["k"]: r for r in assembly.outer_blocks({"a": a, "b": b}, "k", {"a": 2, "b": 1}).collect()}
    assert found[1]["b"] == [0.0] and not found[1]["has_b"] and found[2]["a"] == [0.0, 0.0] and found[2]["has_b"]


def test_rank_percentiles_and_medians(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    r = assembly.rank_percentiles(df, "x", {"p50": 0.5, "p99": 0.99}).first()
    assert (r["n"], r["min"], r["p50"], r["p99"], r["mean"]) == (10, 0.0, 5.0, 9.0, 4.5)
    rows = spark.createDataFrame([(1, 1.0, None), (1, 3.0, None), (0, None, None), (0, 100.0, 2.0)], "t int, a double, b double")
    got = assembly.impute_medians(rows, ["a", "b"], F.col("t") == 1).orderBy("a", "b").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (100.0, 2.0)]


@pytest.mark.parametrize(
    ("name", "key"),
    [("Café Groupe S.A.", "cafe groupe sa"), ("Café Groupe SA", "cafe groupe"), ("CORP /MA/", ""), ("McDonald's Corp.", "mcdonalds"), ("C. H. Robinson Worldwide, Inc.", "ch robinson worldwide"), ("U.S. Bancorp", "us bancorp"), ("A & B Ltd", "ab"), ("The Ørsted ﬁrm", "rsted firm")],
)
def test_names(spark, name, key):
    assert spark.createDataFrame([(name,)], "x string").select(names.normalize_name(F.col("x")).alias("k")).first()["k"] == key


def test_lookups(spark):
    known = spark.createDataFrame([("capital one financial", 1, 1), ("capital one bank", 2, 2), ("align technology", 3, 3), ("kohls", 4, 4), ("financial institutions", 5, 5)], "key string, company long, rank long")
    asked = ["Capital One Fourth Quarter", "Align Technologies", "Kohl's", "Kohls's", "Financial", "Nobody Knows", "Second Align Technologies", "the Q2 2021 Kohl's"]
    found = {r["name"]: r["company"] for r in names.lookup_names(spark.createDataFrame([(a,) for a in asked], "name string"), known).collect()}
    assert found == {"Capital One Fourth Quarter": 1, "Align Technologies": 3, "Kohl's": 4, "Kohls's": 4, "Financial": None, "Nobody Knows": None, "Second Align Technologies": 3, "the Q2 2021 Kohl's": 4}


def test_mentions(spark):
    known = spark.createDataFrame([("acme tools", 1, False), ("allstate", 2, True), ("target", 3, False)], "key string, company long, single_ok boolean")
    t = "Today Acme Tools Inc's news. Allstate. Allstate, Allstate Allstate; Target Target Target. acme tools"
    found = {r["company"]: r["n"] for r in names.phrase_mentions(spark.createDataFrame([(1, t), (2, "Allstate once"), (3, None)], "call_id long, text string"), known).collect()}
    assert found == {1: 1, 2: 3}


def test_greetings_call_types_and_dates(spark):
    t = "Operator: Welcome to the Acme Tools Third Quarter 2019 Earnings Conference Call, hosted by Big Bank."
    df = spark.createDataFrame([(1, t)], "call_id long, text string")
    got = {r["kind"]: (r["weight"], r["name"]) for r in names.greeting_names(df).collect()}
    assert got[0] == (6, "Acme Tools") and got[2] == (4, "Big Bank")
    kinds = ["the monthly sales call", "annual meeting of shareholders", "a fireside chat at noon, Q3 earnings", "fireside talk on earnings", "a merger", "the forum", "hello"]
    found = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, t string").select("i", names.classify_call(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in found] == ["sales", "meeting", "earnings", "conference", "ma", "conference", "unknown"]
    day = spark.createDataFrame([("On March 4, 2021 at", dt.date(2021, 6, 1)), ("no date", None), ("February 31, 2020", dt.date(2020, 1, 1))], "p string, c date")
    out = [r["d"] for r in day.select(names.choose_date(names.long_date(F.col("p")), F.col("c")).alias("d")).collect()]
    assert [tuple(d) for d in out] == [(dt.date(2021, 3, 4), "first_page", "date_disagreement"), (None, "", "no_date"), (dt.date(2020, 1, 1), "created", "date_from_creation_stamp")]


def test_resolution_order(spark):
    rows = [(1, "a", "body", 1, True), (2, "a", "body", 9, True), (2, "b", "greeting", 6, True), (3, "a", "body", 5, True), (3, "b", "body", 4, True), (4, "a", "body", 3, False), (5, "a", "body", 3, True), (6, "a", "greeting", 6, False), (6, "a", "body", 2, False)]
    found = {r["call_id"]: (r["company"], r["flag"]) for r in names.resolve(spark.createDataFrame(rows, "call_id long, company string, kind string, points long, corroborated boolean")).collect()}
    assert found == {1: (None, "unresolved:weak_evidence"), 2: ("b", "greeting_dominant"), 3: (None, "unresolved:ambiguous"), 4: (None, "unresolved:body_only_tail"), 5: ("a", ""), 6: ("a", "")}


def test_audio_logs(spark):
    log = "Peak level dB: -3.0\nOverall\nPeak level dB: -0.05\nRMS level dB: -20.1\nPeak count: 50\nNumber of samples: 1000\nsilence_duration: 18\nsilence_duration: 12.0\n"
    found = spark.createDataFrame([(log, 60.0), ("Peak level dB: -inf", 10.0), (None, 0.0)], "l string, s double").select(audio.parse_log(F.col("l"), F.col("s")).alias("q")).collect()
    assert found[0]["q"]["clip_ratio"] == pytest.approx(0.05) and found[0]["q"]["silence_ratio"] == pytest.approx(0.5) and found[0]["q"]["peak_dbfs"] == -0.05
    assert found[1]["q"]["peak_dbfs"] is None and found[2]["q"]["silence_ratio"] == 0.0
    windows = spark.createDataFrame([(95.0,), (60.5,), (0.5,), (0.0,)], "s double").select(audio.window_count(F.col("s")).alias("n")).collect()
    assert [r["n"] for r in windows] == [4, 2, 0, 0]
