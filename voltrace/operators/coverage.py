"""The ticker universe, price coverage and the cross-check of two price sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.functions.numeric import pearson

from .calendar import sessions_between
from .returns import own_date_returns

GAPPY, PASS, WARN = 0.95, 0.999, 0.99


def build_universe(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("primary", "secondary")) -> DataFrame:
    """(ticker, in_*, *_calls): tickers of either source with their numbers of calls; missing tickers are left out."""

    def counted(calls: DataFrame, name: str) -> DataFrame:
        return calls.where("trim(ticker) != ''").groupBy("ticker").agg(F.count("*").alias(f"{name}_calls"))

    both = counted(first, names[0]).join(counted(second, names[1]), "ticker", "full")
    return both.select("ticker", *(c for n in names for c in (F.col(f"{n}_calls").isNotNull().alias(f"in_{n}"), F.coalesce(f"{n}_calls", F.lit(0)).alias(f"{n}_calls"))))


def listed_symbol(ticker: Column) -> Column:
    """A ticker in the form of a market-data vendor: upper case, dots and slashes as dashes."""
    return F.translate(F.upper(F.trim(ticker)), "./", "--")


def price_coverage(universe: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """universe with symbol, status, reason, n_rows, first_date, last_date, expected_sessions and completeness.

    Without bars a ticker is missing; with fewer than 95 % of the sessions between its first and last bar it is gappy.
    """
    spans = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    spans = sessions_between(spans, sessions, "first_date", "last_date").withColumnRenamed("n_sessions", "expected_sessions")
    ratio = F.bround(F.try_divide("n_rows", "expected_sessions"), 4)
    found = universe.join(spans, "ticker", "left").withColumn("completeness", F.coalesce(ratio, F.lit(0.0)))
    missing = F.col("n_rows").isNull()
    return found.select(
        *universe.columns,
        listed_symbol(F.col("ticker")).alias("symbol"),
        F.when(missing, "missing").otherwise("ok").alias("status"),
        F.when(missing, "no_data").when(F.col("completeness") < GAPPY, "gappy").otherwise("").alias("reason"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "first_date",
        "last_date",
        F.coalesce("expected_sessions", F.lit(0)).alias("expected_sessions"),
        "completeness",
    )


def coverage_summary(coverage: DataFrame, names: tuple[str, str] = ("primary", "secondary")) -> DataFrame:
    """One row: totals, covered counts and percentages, and the sorted missing and gappy tickers (a bounded report)."""

    def percent(part: Column, whole: Column) -> Column:
        return F.coalesce(F.bround(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))

    ok = F.col("status") == "ok"
    totals = [F.count("*").alias("universe_total"), F.count_if(ok).alias("covered_total"), percent(F.count_if(ok), F.count("*")).alias("coverage_pct")]
    for n in names:
        inside = F.col(f"in_{n}")
        totals += [F.count_if(inside).alias(f"{n}_total"), F.count_if(inside & ok).alias(f"{n}_covered"), percent(F.count_if(inside & ok), F.count_if(inside)).alias(f"{n}_pct")]
    listed = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("reason") == r, F.col("ticker")))), ",").alias(f"{r}_tickers") for r in ("no_data", "gappy")]
    return coverage.agg(*totals, *listed)


def cross_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ticker, correlation, n_overlap, status): returns of two sources, each on its own dates, over common dates.

    second_missing without bars in the second source, no_overlap below two common returns or without variance, then pass
    above 0.999, warn from 0.99, else investigate.
    """
    a = own_date_returns(first).withColumnRenamed("ret", "a")
    b = own_date_returns(second).withColumnRenamed("ret", "b")
    pairs = a.join(b, ["ticker", "date"]).groupBy("ticker").agg(pearson(F.col("a"), F.col("b")).alias("correlation"), F.count("*").alias("n_overlap"))
    known = first.select("ticker").distinct().join(second.select("ticker", F.lit(True).alias("there")).distinct(), "ticker", "left")
    r = F.col("correlation")
    status = F.when(F.col("there").isNull(), "second_missing").when(r.isNull(), "no_overlap").when(r > PASS, "pass").when(r >= WARN, "warn").otherwise("investigate")
    return known.join(pairs, "ticker", "left").select("ticker", "correlation", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"), status.alias("status"))


def cross_check_gate(checked: DataFrame, documented: DataFrame) -> DataFrame:
    """One row: scored and investigate counts, investigates without a documented reason, and whether the gate passes."""
    known = checked.join(documented.select("ticker", F.col("reason").alias("documented")), "ticker", "left")
    bad = F.col("status") == "investigate"
    counts = known.agg(
        F.count_if(F.col("status").isin("pass", "warn", "investigate")).alias("scored"),
        F.count_if(bad).alias("investigate"),
        F.count_if(bad & F.col("documented").isNull()).alias("undocumented"),
    )
    return counts.withColumn("passes", (F.col("scored") > 0) & (F.col("undocumented") == 0))


def sample_tickers(tickers: DataFrame, fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """A fixed sample of max(1, round(fraction * n)) distinct tickers, in the order of a salted hash."""
    pool = tickers.select("ticker").distinct()
    k = max(1, round(pool.count() * fraction))
    return pool.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "ticker").cast("binary"))).limit(k)
