"""Price bars, simple returns and realized-volatility windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrace.functions.numeric import log_vol

HORIZONS = (3, 7, 15, 30)
LOOKBACKS = {"rv_daily": 1, "rv_weekly": 5, "rv_monthly": 22}


def price_bars(trades: DataFrame, ticker: Column, day: Column, amount: Column, volume: Column) -> DataFrame:
    """(ticker, date, close): the volume-weighted price of each day; days without volume have none."""
    sums = trades.groupBy(ticker.alias("ticker"), day.alias("date")).agg(F.sum(amount).alias("a"), F.sum(volume).alias("v"))
    return sums.select("ticker", "date", F.try_divide("a", F.nullif("v", F.lit(0.0))).alias("close")).where("close IS NOT NULL")


def session_returns(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """bars with idx and ret, the simple return against the session before; NULL if that session has no price.

    Bars off the calendar are left out. Windows over idx are range frames, so missing sessions need no filler rows.
    """
    numbered = bars.join(F.broadcast(sessions), bars["date"] == sessions["session_date"]).drop("session_date")
    w = Window.partitionBy("ticker").orderBy("idx")
    prior = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("close").over(w))
    return numbered.withColumn("ret", F.try_divide(F.col("close") - prior, F.nullif(prior, F.lit(0.0))))


def own_date_returns(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, date, ret, *keep): returns between a series' own consecutive dates; the first date and a zero base give none."""
    w = Window.partitionBy("ticker", *keep).orderBy("date")
    prior = F.lag("close").over(w)
    return bars.select("ticker", "date", *keep, F.try_divide(F.col("close") - prior, F.nullif(prior, F.lit(0.0))).alias("ret")).where("ret IS NOT NULL")


def _frame(first: int, last: int):
    return Window.partitionBy("ticker").orderBy("idx").rangeBetween(first, last)


def volatility_windows(returns: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """For each bar: mean squared returns over the last 1, 5 and 22 sessions, and for each horizon h the log volatility of
    the h returns up to the bar (``v_pre_h``) and after it (``v_post_h``) with completeness flags (``has_pre_h``,
    ``has_post_h``). A window with any missing return is NULL; so is one without variance."""
    out = {}
    for name, n in LOOKBACKS.items():
        w = _frame(1 - n, 0)
        out[name] = F.when(F.count("ret").over(w) == n, F.avg(F.col("ret") * F.col("ret")).over(w))
    for h in horizons:
        for side, w in (("pre", _frame(1 - h, 0)), ("post", _frame(1, h))):
            full = F.count("ret").over(w) == h
            out[f"has_{side}_{h}"] = full
            out[f"v_{side}_{h}"] = F.when(full, log_vol(F.var_pop("ret").over(w))) if h > 1 else F.lit(None).cast("double")
    return returns.withColumns(out)


def n_day_volatility(returns: DataFrame, days: tuple[int, ...] = (3, 7, 15, 30), eps: float = 1e-10) -> DataFrame:
    """(ticker, date, days, log_std, log_last): for each date of own-date returns the log deviation of the ``days`` returns
    after it and the log of the last one's size; NULL where returns are missing or don't vary."""
    cells = []
    for n in days:
        w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, n)
        std = F.when(F.count("ret").over(w) == n, F.stddev_pop("ret").over(w))
        known = std > 0
        cells.append(F.struct(F.lit(n).alias("days"), F.when(known, F.ln(std)).alias("log_std"), F.when(known, F.ln(F.abs(F.last("ret").over(w)) + F.lit(eps))).alias("log_last")))
    return returns.withColumn("cells", F.array(*cells)).select("ticker", "date", F.explode("cells").alias("c")).select("ticker", "date", "c.*")
