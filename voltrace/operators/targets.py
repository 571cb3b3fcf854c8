"""Realized-volatility targets around calls: one row for each call and horizon, whatever its status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import anchor_day0
from .returns import HORIZONS, LOOKBACKS, session_returns, volatility_windows

FIRST_DATE, LAST_DATE = "2000-01-01", "2030-12-31"
EARLIEST = "1990-01-01"


def compute_targets(
    calls: DataFrame,
    bars: DataFrame,
    sessions: DataFrame,
    horizons: tuple[int, ...] = HORIZONS,
    first_date: str = FIRST_DATE,
    last_date: str = LAST_DATE,
) -> DataFrame:
    """(call_id, ticker, call_date, as_of, horizon, v_pre, v_post, delta_v, rv_*, assumed_after_hours, status, reason).

    calls has call_id, ticker, call_date and known_minute (minutes after midnight, NULL if the time isn't known). The
    reason is the first that holds: unresolved_ticker, invalid_date (none, out of range, or no session near),
    no_price_data, insufficient_post_history, insufficient_pre_history, zero_variance_post, zero_variance_pre. Windows are
    computed once for each bar and calls join the bar of their day 0; as-of dates are kept for excluded rows where known.
    """
    clean = calls.withColumn("ticker", F.trim(F.coalesce("ticker", F.lit(""))))
    anchored = anchor_day0(clean, sessions)
    windows = volatility_windows(session_returns(bars, sessions), horizons)
    per_horizon = F.array(
        *(
            F.struct(
                F.lit(h).alias("horizon"),
                *(F.col(f"{n}_{side}_{h}").alias(f"{n}_{side}") for n in ("v", "has") for side in ("pre", "post")),
            )
            for h in horizons
        )
    )
    windows = windows.select("ticker", F.col("idx").alias("day0_idx"), *LOOKBACKS, per_horizon.alias("h"))
    priced = bars.select("ticker").distinct().withColumn("priced", F.lit(True))
    joined = anchored.join(windows, ["ticker", "day0_idx"], "left").join(priced, "ticker", "left")
    none = F.array(*(F.struct(F.lit(h).alias("horizon"), *(F.lit(None).cast(t).alias(n) for n, t in (("v_pre", "double"), ("v_post", "double"), ("has_pre", "boolean"), ("has_post", "boolean")))) for h in horizons))
    rows = joined.withColumn("w", F.explode(F.coalesce("h", none))).select("*", "w.*").drop("h", "w")

    bad_date = F.col("call_date").isNull() | (F.col("call_date") < F.lit(first_date).cast("date")) | (F.col("call_date") > F.lit(last_date).cast("date"))
    reason = (
        F.when(F.col("ticker") == "", "unresolved_ticker")
        .when(bad_date | F.col("day0_idx").isNull(), "invalid_date")
        .when(F.col("priced").isNull(), "no_price_data")
        .when(~F.coalesce("has_post", F.lit(False)), "insufficient_post_history")
        .when(~F.coalesce("has_pre", F.lit(False)), "insufficient_pre_history")
        .when(F.col("v_post").isNull(), "zero_variance_post")
        .when(F.col("v_pre").isNull(), "zero_variance_pre")
        .otherwise("")
    )
    known = ~F.col("reason").isin("unresolved_ticker", "invalid_date")
    values = ("v_pre", "v_post", *LOOKBACKS)
    return (
        rows.withColumn("reason", reason)
        .withColumns({v: F.when(known, F.col(v)) for v in values} | {"as_of": F.when(known, F.col("as_of"))})
        .select(
            "call_id",
            "ticker",
            "call_date",
            "as_of",
            "horizon",
            "v_pre",
            "v_post",
            (F.col("v_post") - F.col("v_pre")).alias("delta_v"),
            *LOOKBACKS,
            F.col("known_minute").isNull().alias("assumed_after_hours"),
            F.when(F.col("reason") == "", "ok").otherwise("excluded").alias("status"),
            "reason",
        )
    )
