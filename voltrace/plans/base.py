"""The supplied tables in the roles of the analytics: bars, sessions, calls and turns, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators.calendar import number_sessions
from voltrace.operators.returns import price_bars
from voltrace.operators.targets import compute_targets

#: Calls range over the order dates of the supplied tables.
FIRST_DATE, LAST_DATE = "1990-01-01", "2030-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays with a shipment, numbered."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session_date")).where(_weekday(F.col("session_date")))
    return number_sessions(days)


def bars(spark: SparkSession, sf_dir: str, series: str = "l_linestatus") -> DataFrame:
    """Daily volume-weighted prices of series of line items; series: a SQL expression."""
    items = table(spark, sf_dir, "lineitem").where(_weekday(F.col("l_shipdate")))
    return price_bars(items, F.expr(series), F.col("l_shipdate").cast("date"), F.col("l_extendedprice"), F.col("l_quantity"))


def calls(spark: SparkSession, sf_dir: str, tickers: tuple[str, ...] = ("F", "O")) -> DataFrame:
    """Orders as calls: the customer's number picks the ticker, every third call has a known time."""
    names = F.array(*map(F.lit, tickers))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.get(names, (F.col("o_custkey") % len(tickers)).cast("int")).alias("ticker"),
        F.col("o_orderdate").cast("date").alias("call_date"),
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 1440).cast("int")).alias("known_minute"),
    )


#: Six series, an unresolved ticker and one without prices.
MIXED = ("AF", "AO", "NF", "NO", "RF", "RO", "", "ZZ")
MIXED_SERIES = "concat(l_returnflag, l_linestatus)"


def targets(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    found = bars(spark, sf_dir, MIXED_SERIES if mixed else "l_linestatus")
    asked = calls(spark, sf_dir, MIXED if mixed else ("F", "O"))
    return compute_targets(asked, found, sessions(spark, sf_dir), first_date=FIRST_DATE, last_date=LAST_DATE)


def sql_sessions() -> str:
    return """sessions AS (
        SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS idx
        FROM (SELECT DISTINCT l_shipdate::DATE AS session_date FROM lineitem WHERE isodow(l_shipdate) <= 5)
    )"""


def sql_bars(series: str = "l_linestatus") -> str:
    return f"""bars AS (
        SELECT {series} AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close
        FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1, 2
    )"""


def sql_calls(tickers: tuple[str, ...] = ("F", "O")) -> str:
    return f"""calls AS (
        SELECT o_orderkey AS call_id, {list(tickers)}[o_custkey % {len(tickers)} + 1] AS ticker, o_orderdate::DATE AS call_date,
            CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1440 END AS known_minute
        FROM orders
    )"""


def sql_anchored() -> str:
    return """near AS (
        SELECT call_id, ticker, call_date, known_minute,
            (SELECT max(session_date) FROM sessions WHERE session_date BETWEEN call_date - 10 AND call_date) AS last_date,
            (SELECT min(session_date) FROM sessions WHERE session_date BETWEEN call_date AND call_date + 10) AS next_date
        FROM calls
    ),
    anchored AS (
        SELECT call_id, ticker, call_date, known_minute, s.session_date AS as_of, s.idx AS day0_idx FROM (
            SELECT *, CASE WHEN coalesce(known_minute < 570, false)
                THEN (SELECT max(session_date) FROM sessions WHERE session_date BETWEEN next_date - 10 AND next_date - 1) ELSE last_date END AS d
            FROM near
        ) LEFT JOIN sessions s ON s.session_date = d
    )"""


def sql_targets(mixed: bool = False) -> str:
    """CTEs that end with ``targets``."""
    series, tickers = ("l_returnflag || l_linestatus", MIXED) if mixed else ("l_linestatus", ("F", "O"))
    return f"""{sql_sessions()}, {sql_bars(series)}, {sql_calls(tickers)}, {sql_anchored()},
    grid AS (
        SELECT t.ticker, s.idx, b.close FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN sessions s
        LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.session_date
    ),
    rets AS (SELECT ticker, idx, close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 AS ret FROM grid),
    wide AS (
        SELECT ticker, idx, h.horizon,
            avg(ret * ret) FILTER (WHERE k = 0) AS rv_daily,
            CASE WHEN count(ret) FILTER (WHERE k BETWEEN -4 AND 0) = 5 THEN avg(ret * ret) FILTER (WHERE k BETWEEN -4 AND 0) END AS rv_weekly,
            CASE WHEN count(ret) FILTER (WHERE k BETWEEN -21 AND 0) = 22 THEN avg(ret * ret) FILTER (WHERE k BETWEEN -21 AND 0) END AS rv_monthly,
            count(ret) FILTER (WHERE k BETWEEN 1 - h.horizon AND 0) = h.horizon AS has_pre,
            count(ret) FILTER (WHERE k BETWEEN 1 AND h.horizon) = h.horizon AS has_post,
            var_pop(ret) FILTER (WHERE k BETWEEN 1 - h.horizon AND 0) AS var_pre,
            var_pop(ret) FILTER (WHERE k BETWEEN 1 AND h.horizon) AS var_post
        FROM (
            SELECT a.ticker, a.idx, r.idx - a.idx AS k, r.ret FROM (SELECT DISTINCT ticker, day0_idx AS idx FROM anchored) a
            JOIN rets r ON r.ticker = a.ticker AND r.idx BETWEEN a.idx - 29 AND a.idx + 30
        ) CROSS JOIN (VALUES (3), (7), (15), (30)) h(horizon)
        GROUP BY ticker, idx, h.horizon
    ),
    raw AS (
        SELECT a.call_id, a.ticker, a.call_date, a.as_of, h.horizon, w.rv_daily, w.rv_weekly, w.rv_monthly,
            CASE WHEN has_pre AND var_pre > 0 THEN 0.5 * ln(var_pre) END AS v_pre,
            CASE WHEN has_post AND var_post > 0 THEN 0.5 * ln(var_post) END AS v_post,
            a.known_minute IS NULL AS assumed_after_hours,
            CASE WHEN a.ticker = '' THEN 'unresolved_ticker'
                WHEN a.call_date IS NULL OR a.call_date < DATE '{FIRST_DATE}' OR a.call_date > DATE '{LAST_DATE}' OR a.day0_idx IS NULL THEN 'invalid_date'
                WHEN a.ticker NOT IN (SELECT ticker FROM bars) THEN 'no_price_data'
                WHEN NOT coalesce(has_post, false) THEN 'insufficient_post_history'
                WHEN NOT coalesce(has_pre, false) THEN 'insufficient_pre_history'
                WHEN NOT coalesce(var_post > 0, false) THEN 'zero_variance_post'
                WHEN NOT coalesce(var_pre > 0, false) THEN 'zero_variance_pre' ELSE '' END AS reason
        FROM anchored a CROSS JOIN (VALUES (3), (7), (15), (30)) h(horizon)
        LEFT JOIN wide w ON w.ticker = a.ticker AND w.idx = a.day0_idx AND w.horizon = h.horizon
    ),
    targets AS (
        SELECT call_id, ticker, call_date, CASE WHEN reason NOT IN ('unresolved_ticker', 'invalid_date') THEN as_of END AS as_of, horizon::INTEGER AS horizon,
            v_pre, v_post, v_post - v_pre AS delta_v, rv_daily, rv_weekly, rv_monthly, assumed_after_hours,
            CASE WHEN reason = '' THEN 'ok' ELSE 'excluded' END AS status, reason
        FROM raw
    )"""


def r6(*names: str) -> list[Column]:
    """Columns rounded for a result."""
    from voltrace.functions.numeric import reported

    return [reported(F.col(n)).alias(n) for n in names]


def sql_r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)
