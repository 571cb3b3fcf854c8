"""Queries: calendar, anchors, returns and realized-volatility targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators import calendar, returns

from . import base
from .registry import query

_VALUES = ("v_pre", "v_post", "delta_v", "rv_daily", "rv_weekly", "rv_monthly")
_TARGETS = f"SELECT call_id, ticker, call_date, as_of, horizon, {base.sql_r6(*_VALUES)}, assumed_after_hours, status, reason FROM targets"


@query(f"WITH {base.sql_sessions()} SELECT session_date, idx FROM sessions")
def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.sessions(spark, sf_dir)


@query(f"WITH {base.sql_sessions()} SELECT year(session_date)::INTEGER AS year, month(session_date)::INTEGER AS month, count(*) AS n_sessions FROM sessions GROUP BY 1, 2")
def session_count_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.sessions(spark, sf_dir)
    return found.groupBy(F.year("session_date").alias("year"), F.month("session_date").alias("month")).agg(F.count("*").alias("n_sessions"))


@query(f"WITH {base.sql_targets()} {_TARGETS}")
def realized_vol_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.targets(spark, sf_dir)
    return found.select("call_id", "ticker", "call_date", "as_of", "horizon", *base.r6(*_VALUES), "assumed_after_hours", "status", "reason")


@query(f"WITH {base.sql_targets(True)} {_TARGETS}")
def realized_vol_targets_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.targets(spark, sf_dir, mixed=True)
    return found.select("call_id", "ticker", "call_date", "as_of", "horizon", *base.r6(*_VALUES), "assumed_after_hours", "status", "reason")


@query(f"WITH {base.sql_targets(True)} SELECT horizon, status, reason, count(*) AS n_rows, count(DISTINCT call_id) AS n_calls FROM targets GROUP BY ALL")
def target_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.targets(spark, sf_dir, mixed=True)
    return found.groupBy("horizon", "status", "reason").agg(F.count("*").alias("n_rows"), F.countDistinct("call_id").alias("n_calls"))


@query(f"""WITH {base.sql_targets(True)} SELECT count(DISTINCT call_id) AS calls,
    count(DISTINCT call_id) FILTER (WHERE reason NOT IN ('unresolved_ticker', 'invalid_date')) AS resolved,
    count(DISTINCT call_id) FILTER (WHERE status = 'ok') AS joined,
    round(count(DISTINCT call_id) FILTER (WHERE status = 'ok') / nullif(count(DISTINCT call_id) FILTER (WHERE reason NOT IN ('unresolved_ticker', 'invalid_date')), 0), 6) AS join_rate FROM targets""")
def target_join_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.targets(spark, sf_dir, mixed=True)
    resolved = ~F.col("reason").isin("unresolved_ticker", "invalid_date")
    counts = found.agg(
        F.countDistinct("call_id").alias("calls"),
        F.countDistinct(F.when(resolved, F.col("call_id"))).alias("resolved"),
        F.countDistinct(F.when(F.col("status") == "ok", F.col("call_id"))).alias("joined"),
    )
    return counts.withColumn("join_rate", F.round(F.try_divide("joined", "resolved"), 6))


@query(f"WITH {base.sql_sessions()}, {base.sql_calls()}, {base.sql_anchored()} SELECT call_id, call_date, last_date, next_date FROM near")
def day0_asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of backward and forward sessions of each call date."""
    days = F.broadcast(calendar.day_map(base.sessions(spark, sf_dir)))
    asked = base.calls(spark, sf_dir)
    return asked.join(days, asked["call_date"] == days["day"], "left").select("call_id", "call_date", "last_date", "next_date")


@query(f"WITH {base.sql_sessions()}, {base.sql_calls()}, {base.sql_anchored()} SELECT call_id, call_date, known_minute::INTEGER AS known_minute, as_of, day0_idx FROM anchored")
def day0_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calendar.anchor_day0(base.calls(spark, sf_dir), base.sessions(spark, sf_dir))
    return found.select("call_id", "call_date", "known_minute", "as_of", "day0_idx")


@query(f"""WITH {base.sql_sessions()}, {base.sql_bars(base.MIXED_SERIES.replace("concat(l_returnflag, l_linestatus)", "l_returnflag || l_linestatus"))},
    {base.sql_calls(base.MIXED)}, {base.sql_anchored()}
    SELECT call_id, o AS "offset", s.session_date, round(b.close, 6) + 0.0::DOUBLE AS close
    FROM anchored a CROSS JOIN (SELECT unnest(generate_series(-3, 3))::INTEGER AS o) JOIN sessions s ON s.idx = a.day0_idx + o
    LEFT JOIN bars b ON b.ticker = a.ticker AND b.date = s.session_date""")
def session_offset_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sessions around day 0 with prices where there are any."""
    known = base.sessions(spark, sf_dir)
    around = calendar.session_offsets(calendar.anchor_day0(base.calls(spark, sf_dir, base.MIXED), known), known, 3, 3)
    prices = base.bars(spark, sf_dir, base.MIXED_SERIES).withColumnRenamed("date", "session_date")
    return around.join(prices, ["ticker", "session_date"], "left").select("call_id", "offset", "session_date", *base.r6("close"))


@query(f"""WITH {base.sql_sessions()}, {base.sql_bars("l_returnflag || l_linestatus")}
    SELECT ticker, date, round(ret, 6) + 0.0::DOUBLE AS ret FROM (
        SELECT b.ticker, b.date, CASE WHEN lag(s.idx) OVER w = s.idx - 1 THEN b.close / lag(b.close) OVER w - 1 END AS ret
        FROM bars b JOIN sessions s ON s.session_date = b.date WINDOW w AS (PARTITION BY b.ticker ORDER BY s.idx))""")
def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = returns.session_returns(base.bars(spark, sf_dir, base.MIXED_SERIES), base.sessions(spark, sf_dir))
    return found.select("ticker", "date", *base.r6("ret"))


@query(f"WITH {base.sql_targets()} SELECT call_id, {base.sql_r6('rv_daily', 'rv_weekly', 'rv_monthly', 'x_daily', 'x_weekly', 'x_monthly')} FROM (SELECT call_id, rv_daily, rv_weekly, rv_monthly, ln(rv_daily + 1e-12::DOUBLE) AS x_daily, ln(rv_weekly + 1e-12::DOUBLE) AS x_weekly, ln(rv_monthly + 1e-12::DOUBLE) AS x_monthly FROM targets WHERE horizon = 3)")
def har_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltrace.functions.numeric import log_variance

    found = base.targets(spark, sf_dir).where("horizon = 3")
    found = found.withColumns({f"x_{n}": log_variance(F.col(f"rv_{n}")) for n in ("daily", "weekly", "monthly")})
    return found.select("call_id", *base.r6("rv_daily", "rv_weekly", "rv_monthly", "x_daily", "x_weekly", "x_monthly"))
