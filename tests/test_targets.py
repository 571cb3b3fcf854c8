import datetime as dt
import math

import pytest

from voltrace.operators import calendar, returns, targets

DAY0 = dt.date(2021, 1, 15)
CLOSES = [100.0, 120.0, 108.0, 97.2, 106.92, 101.574, 96.4953]


@pytest.fixture(scope="module")
def sessions(spark):
    """Weekdays around 2021-01-15 without the holiday on Monday the 18th."""
    days = [dt.date(2020, 11, 2) + dt.timedelta(d) for d in range(140)]
    days = [d for d in days if d.weekday() < 5 and d != dt.date(2021, 1, 18)]
    return calendar.number_sessions(spark.createDataFrame([(d,) for d in days], "session_date date"))


@pytest.fixture(scope="module")
def bars(spark, sessions):
    days = [r["session_date"] for r in sessions.orderBy("idx").collect()]
    at = days.index(DAY0)
    rows = [("AAA", days[at - 3 + i], c) for i, c in enumerate(CLOSES)]
    rows += [("FLAT", d, 5.0) for d in days[at - 10 : at + 10]]
    rows += [("GAP", d, 5.0 + i % 3) for i, d in enumerate(days[at - 10 : at + 10]) if d != days[at + 1]]
    rows += [("NOW", d, 5.0 + i % 3) for i, d in enumerate(days[at - 10 : at + 10]) if d != DAY0]
    rows += [("LATE", d, 5.0 + i % 3) for i, d in enumerate(days[at - 1 : at + 10])]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def compute(spark, bars, sessions, rows, horizons=(3,)):
    calls = spark.createDataFrame(rows, "call_id long, ticker string, call_date date, known_minute int")
    return {(r["call_id"], r["horizon"]): r for r in targets.compute_targets(calls, bars, sessions, horizons).collect()}


def test_worked_example(spark, bars, sessions):
    r = compute(spark, bars, sessions, [(1, "AAA", DAY0, None)])[1, 3]
    assert (r["status"], r["reason"], r["as_of"]) == ("ok", "", DAY0)
    assert r["v_pre"] == pytest.approx(0.5 * math.log(0.02))
    assert r["v_post"] == pytest.approx(0.5 * math.log(0.005))
    assert r["delta_v"] == pytest.approx(0.5 * math.log(0.25))
    assert r["rv_daily"] == pytest.approx(0.01) and r["rv_weekly"] is None and r["assumed_after_hours"]


@pytest.mark.parametrize(
    ("day", "minute", "want"),
    [
        (dt.date(2021, 1, 16), None, DAY0),
        (dt.date(2021, 1, 17), None, DAY0),
        (dt.date(2021, 1, 18), None, DAY0),
        (dt.date(2021, 1, 19), 8 * 60, DAY0),
        (dt.date(2021, 1, 19), 9 * 60 + 30, dt.date(2021, 1, 19)),
        (dt.date(2021, 1, 16), 8 * 60, DAY0),
        (dt.date(1999, 1, 1), None, None),
        (None, None, None),
    ],
)
def test_anchors(spark, sessions, day, minute, want):
    calls = spark.createDataFrame([(1, day, minute)], "call_id long, call_date date, known_minute int")
    assert calendar.anchor_day0(calls, sessions).first()["as_of"] == want


def test_first_failing_reason(spark, bars, sessions):
    rows = [(1, " ", DAY0, None), (2, "AAA", None, None), (3, "AAA", dt.date(1995, 1, 1), None), (4, "ZZZ", DAY0, None), (5, "GAP", DAY0, None), (6, "NOW", DAY0, None), (7, "LATE", DAY0, None), (8, "FLAT", DAY0, 600), (9, None, None, None)]
    found = {k[0]: r["reason"] for k, r in compute(spark, bars, sessions, rows).items()}
    assert found == {1: "unresolved_ticker", 2: "invalid_date", 3: "invalid_date", 4: "no_price_data", 5: "insufficient_post_history", 6: "insufficient_post_history", 7: "insufficient_pre_history", 8: "zero_variance_post", 9: "unresolved_ticker"}


def test_one_row_for_each_call_and_horizon(spark, bars, sessions):
    found = compute(spark, bars, sessions, [(1, "AAA", DAY0, None), (2, "", None, None)], (3, 7, 15, 30))
    assert len(found) == 8 and found[1, 7]["reason"] == "insufficient_post_history" and found[1, 7]["v_pre"] is None


def test_own_date_returns_skip_zero_bases(spark):
    rows = [("A", dt.date(2021, 1, d), c) for d, c in ((1, 2.0), (5, 3.0), (9, 0.0), (10, 4.0))]
    found = returns.own_date_returns(spark.createDataFrame(rows, "ticker string, date date, close double")).orderBy("date").collect()
    assert [r["ret"] for r in found] == [0.5, -1.0]


def test_sessions_between(spark, sessions):
    spans = spark.createDataFrame([(dt.date(2021, 1, 15), dt.date(2021, 1, 19)), (dt.date(2021, 1, 16), dt.date(2021, 1, 18)), (None, None)], "a date, b date")
    assert [r["n_sessions"] for r in calendar.sessions_between(spans, sessions, "a", "b").orderBy("a").collect()] == [0, 2, 0]
