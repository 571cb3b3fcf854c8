"""Forecasts: persistence, EWMA, heterogeneous autoregression, entity means, and their mapping to targets."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrace.functions.numeric import log_variance, log_vol

LAMBDA = 0.94
TARGETS = ("v", "dv", "har_resid")
REGRESSORS = ("rv_daily", "rv_weekly", "rv_monthly")


def ewma(returns: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """(ticker, date, ewma_var, ewma): the exponentially weighted variance forecast after each date of own-date returns.

    The recursion s = lam s + (1 - lam) r**2, begun at the population variance of all returns up to the date, in closed
    form: lam**n var + (1 - lam) sum(lam**(n - 1 - i) r_i**2). Powers are taken within segments over which lam falls to
    1e-27, and what the segments before leave is carried over, so series of any length stay within doubles.
    """
    length = max(1, int(27 * log(10) / -log(lam)))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    numbered = returns.where("ret IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    numbered = numbered.withColumn("segment", F.floor((F.col("n") - 1) / length)).withColumn("at", F.col("n") - F.col("segment") * length)
    square = F.col("ret") * F.col("ret")
    ends = numbered.groupBy("ticker", "segment").agg(F.sum(F.pow(F.lit(lam), length - F.col("at")) * square).alias("end"))
    # a dozen segments back is below the smallest double
    before = F.collect_list("end").over(Window.partitionBy("ticker").orderBy("segment").rowsBetween(-12, -1))
    carried = F.aggregate(before, F.lit(0.0), lambda s, e: s * F.lit(lam**length) + e)
    carries = ends.select("ticker", "segment", carried.alias("carry"))
    own = F.sum(F.pow(F.lit(lam), -F.col("at")) * square).over(Window.partitionBy("ticker", "segment").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    out = numbered.withColumns({"own": own, "var": F.var_pop("ret").over(w)}).join(carries, ["ticker", "segment"])
    var = F.pow(F.lit(lam), F.col("n")) * F.col("var") + (1 - lam) * F.pow(F.lit(lam), F.col("at")) * (F.col("own") + F.col("carry"))
    return out.withColumn("ewma_var", var).select("ticker", "date", "ewma_var", log_vol(F.col("ewma_var")).alias("ewma"))


def as_of_value(calls: DataFrame, series: DataFrame, value: str, day: str = "as_of") -> DataFrame:
    """calls with the series' value at the latest date not after ``day``: an as-of join by union and a running last value."""
    s = series.select("ticker", F.col("date").alias("at"), F.lit(0).alias("side"), F.struct(value).alias("v"), F.lit(None).cast(calls.select(F.struct("*")).schema[0].dataType).alias("c"))
    c = calls.select("ticker", F.col(day).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(s.schema["v"].dataType).alias("v"), F.struct("*").alias("c"))
    w = Window.partitionBy("ticker").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(c).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("c.*", F.col(f"v.{value}").alias(value))


def solve_least_squares(rows: DataFrame, by: list[str], features: list[Column], label: Column) -> dict[tuple, np.ndarray]:
    """Ordinary least squares with intercept for each group, from sums of products over complete rows.

    One pass sums (k + 1)**2 products a group; groups and features are few, so the systems are solved on the driver.
    Returns group -> [intercept, coefficients...]; rank-deficient systems get the solution of least norm.
    """
    columns = [F.lit(1.0), *features]
    k = len(columns)
    whole = rows.select(*by, *(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)), label.cast("double").alias("y"))
    whole = whole.dropna(subset=[*(f"x{i}" for i in range(k)), "y"])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k)]
    out = {}
    for r in whole.groupBy(*by).agg(*sums).collect():
        a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        out[tuple(r[b] for b in by)] = np.linalg.lstsq(a, np.array([r[f"t{i}"] for i in range(k)]), rcond=None)[0]
    return out


def har_forecast(targets: DataFrame, train: Column, by: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """targets with har: v_post on ln(rv + eps) of the three lookbacks, fit for each group on rows where ``train`` holds."""
    x = [log_variance(F.col(c)) for c in REGRESSORS]
    fits = solve_least_squares(targets.where(train), list(by), x, F.col("v_post"))
    har: Column = F.lit(None).cast("double")
    for key, b in fits.items():
        same = [F.col(c) == F.lit(v) for c, v in zip(by, key, strict=True)]
        value = sum((F.lit(float(w)) * c for w, c in zip(b[1:], x, strict=True)), F.lit(float(b[0])))
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        har = F.when(condition, value).otherwise(har)
    return targets.withColumn("har", har)


def entity_mean(rows: DataFrame, entity: str, value: str, train: Column, by: tuple[str, ...] = ("horizon",), name: str = "entity_mean") -> DataFrame:
    """rows with the train mean of ``value`` of their entity and group; entities not in train get the group's mean."""
    known = rows.where(train)
    own = known.groupBy(entity, *by).agg(F.avg(value).alias("own"))
    group = known.groupBy(*by).agg(F.avg(value).alias("all"))
    return rows.join(own, [entity, *by], "left").join(F.broadcast(group), list(by), "left").withColumn(name, F.coalesce("own", "all")).drop("own", "all")


def as_targets(rows: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Long predictions: for every target and model (target, model, y_true, y_pred, baseline) beside the rows' columns.

    rows has v_pre, v_post, delta_v, har and a v_post forecast for each model. v is v_post itself, dv the change from
    v_pre, har_resid what the autoregression leaves; forecasts are mapped accordingly, and the trivial forecast is v_pre
    for v and 0 for the others.
    """
    truth = {"v": F.col("v_post"), "dv": F.col("delta_v"), "har_resid": F.col("v_post") - F.col("har")}
    trivial = {"v": F.col("v_pre"), "dv": F.lit(0.0), "har_resid": F.lit(0.0)}
    shift = {"v": F.lit(0.0), "dv": F.col("v_pre"), "har_resid": F.col("har")}
    cells = [
        F.struct(
            F.lit(t).alias("target"),
            F.lit(m).alias("model"),
            truth[t].alias("y_true"),
            (trivial[t] if m == "persistence" else F.col(m) - shift[t]).alias("y_pred"),
            trivial[t].alias("baseline"),
        )
        for t in TARGETS
        for m in models
    ]
    return rows.withColumn("cell", F.explode(F.array(*cells))).select("*", "cell.*").drop("cell")
