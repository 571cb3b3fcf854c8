import datetime as dt
import random

import pytest

from voltrace.operators import calendar, coverage, splits


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(0)
    start = dt.date(2010, 1, 1)
    rows = [(i, f"T{rng.randrange(40):02d}", start + dt.timedelta(5 * i), 30) for i in range(300)]
    return spark.createDataFrame(rows, "call_id long, ticker string, as_of date, longest int")


@pytest.fixture(scope="module")
def sessions(spark):
    return calendar.number_sessions(spark.createDataFrame([(dt.date(2010, 1, 1) + dt.timedelta(d),) for d in range(1600)], "session_date date"))


def test_temporal_split_keeps_the_gap(spark, cohort, sessions):
    found = {r["call_id"]: r["split"] for r in splits.temporal_split(cohort, sessions, 30).collect()}
    assert len(found) == 300
    by = {s: [5 * i for i, x in found.items() if x == s] for s in (*splits.SEGMENTS, "embargo")}
    assert max(by["train"]) + 30 <= 5 * int(0.7 * 300) and min(by["val"]) > 5 * int(0.7 * 300)
    assert min(by["test"]) > 5 * int((0.7 + 0.1) * 300) and by["embargo"]


def test_disjoint_split_keeps_entities_whole(spark, cohort):
    sides = splits.disjoint_split(cohort, "ticker", 7).join(cohort, "call_id").select("ticker", "split").distinct().collect()
    assert len(sides) == len({r["ticker"] for r in sides}) and {r["split"] for r in sides} == set(splits.SEGMENTS)


def test_combined_split(spark):
    a = spark.createDataFrame([(1, "train"), (2, "val"), (3, "embargo"), (4, "test")], "call_id long, split string")
    b = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "call_id long, split string")
    assert {r["call_id"]: r["split"] for r in splits.combined_split(a, b).collect()} == {1: "train", 2: "excluded", 3: "excluded", 4: "excluded"}


def test_no_leakage_and_strange_as_of_is_an_error(spark, cohort, sessions):
    found = splits.leakage(cohort, splits.temporal_split(cohort, sessions, 30), splits.disjoint_split(cohort, "ticker"), "ticker", sessions).first()
    assert tuple(found) == (0, 0, 0)
    odd = spark.createDataFrame([(1, "T", dt.date(1999, 1, 1), 3)], cohort.schema)
    with pytest.raises(Exception, match="not a session"):
        splits.temporal_split(cohort.unionByName(odd), sessions, 30).collect()


def test_gappy_and_missing_tickers(spark, sessions):
    days = [r["session_date"] for r in sessions.orderBy("idx").limit(60).collect()]
    bars = spark.createDataFrame([("full", d, 1.0) for d in days] + [("gap", d, 1.0) for d in days[::3]], "ticker string, date date, close double")
    first = spark.createDataFrame([("full",), ("full",), ("no.ne",)], "ticker string")
    second = spark.createDataFrame([("gap",), ("full",), (" ",)], "ticker string")
    universe = coverage.build_universe(first, second)
    found = {r["ticker"]: r for r in coverage.price_coverage(universe, bars, sessions).collect()}
    assert (found["full"]["reason"], found["gap"]["reason"], found["no.ne"]["reason"]) == ("", "gappy", "no_data")
    assert found["no.ne"]["symbol"] == "NO-NE" and found["full"]["primary_calls"] == 2 and found["full"]["in_secondary"]
    summary = coverage.coverage_summary(coverage.price_coverage(universe, bars, sessions)).first()
    assert (summary["universe_total"], summary["covered_total"], summary["no_data_tickers"], summary["gappy_tickers"]) == (3, 2, "no.ne", "gap")


def test_scaled_source_correlates_fully(spark):
    rng = random.Random(1)
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), 10 + rng.random()) for i in range(40)] + [("B", dt.date(2020, 1, 1), 1.0), ("C", dt.date(2020, 1, 1), 1.0)]
    first = spark.createDataFrame(rows, "ticker string, date date, close double")
    second = first.where("ticker != 'C'").selectExpr("ticker", "date", "close * 2 AS close")
    found = {r["ticker"]: r for r in coverage.cross_check(first, second).collect()}
    assert found["A"]["correlation"] == pytest.approx(1.0) and found["A"]["status"] == "pass" and found["A"]["n_overlap"] == 39
    assert (found["B"]["status"], found["C"]["status"]) == ("no_overlap", "second_missing")
