"""Forecast comparison: Diebold-Mariano tests, cluster bootstrap intervals and Holm's correction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the regularised incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_t_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p-values of result cells: (statistic, degrees of freedom)."""
    for t, df in batches:
        yield pd.Series([student_t_p(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


def losses(error: Column, loss: str = "squared") -> Column:
    if loss not in ("squared", "absolute"):
        raise ValueError(f"unknown loss {loss!r}")
    return error * error if loss == "squared" else F.abs(error)


def diebold_mariano(pairs: DataFrame, by: list[str], order: list[str], h: int = 1, loss: str = "squared", p_value: bool = True) -> DataFrame:
    """(by, n, mean_diff, dm_stat[, dm_p]) for pairs of forecast errors ea and eb of the same calls.

    The loss difference's long-run variance has h - 1 autocovariances along ``order`` and falls back to the plain variance
    if it isn't positive; the statistic has the small-sample factor sqrt((n + 1 - 2h + h(h - 1)/n) / n) and n - 1 degrees
    of freedom. Fewer than two pairs or a constant difference: NULL. Positive: the first forecast is worse.
    """
    d = pairs.dropna(subset=["ea", "eb"]).withColumn("d", losses(F.col("ea"), loss) - losses(F.col("eb"), loss))
    mean = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.count("*").alias("n"))
    dev = d.join(F.broadcast(mean), by).withColumn("dev", F.col("d") - F.col("mean_diff"))
    lags = [f"lag{k}" for k in range(1, h)]
    w = Window.partitionBy(*by).orderBy(*order)
    for k, name in enumerate(lags, 1):
        dev = dev.withColumn(name, F.lag("dev", k).over(w))
    cells = dev.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"), F.avg(F.col("dev") * F.col("dev")).alias("g0"), *(F.avg(F.col("dev") * F.col(name)).alias(name) for name in lags)
    )
    long_run = sum((2 * F.coalesce(F.col(name), F.lit(0.0)) for name in lags), F.col("g0"))
    var = F.when(long_run > 0, long_run).when(F.col("g0") > 0, F.col("g0"))
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + F.lit(h * (h - 1)) / n) / n)
    stat = F.when((n >= 2) & (n + 1 - 2 * h + F.lit(h * (h - 1)) / n >= 0), F.col("mean_diff") / F.sqrt(var / n) * factor)
    out = cells.withColumn("dm_stat", stat).select(*by, "n", "mean_diff", "dm_stat")
    return out.withColumn("dm_p", t_p_value(F.col("dm_stat"), (n - 1).cast("double"))) if p_value else out


def against(predictions: DataFrame, reference: str, by: list[str], call: str = "call_id") -> DataFrame:
    """Error pairs (by, model, ea, eb, call): every other model's errors beside the reference model's on the same call and cell."""
    rows = predictions.withColumn("e", F.col("y_true") - F.col("y_pred"))
    ref = rows.where(F.col("model") == reference).select(*by, call, F.col("e").alias("eb"))
    return rows.where(F.col("model") != reference).withColumnRenamed("e", "ea").join(ref, [*by, call])


def holm(cells: DataFrame, family: list[str], p: str, name: str) -> DataFrame:
    """cells with Holm's step-down adjusted p-value within each family; missing p-values stay missing and don't count."""
    has = F.col(p).isNotNull()
    w = Window.partitionBy(*family, "holm_has").orderBy(p)
    m = F.count("*").over(Window.partitionBy(*family, "holm_has"))
    ranked = cells.withColumn("holm_has", has).withColumn("holm_step", (m - F.row_number().over(w) + 1) * F.col(p))
    run = F.max("holm_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(F.col("holm_has"), F.least(F.lit(1.0), run))).drop("holm_has", "holm_step")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row (point, lo, hi, n): percentile interval of the pooled mean under resampling of whole clusters.

    Rows are summed by cluster first; a replicate draws as many clusters as there are, with replacement, by a hash of
    (seed, replicate, draw), so the draws are the same on every run. Without rows: NULL.
    """
    sums = rows.dropna(subset=[value, cluster]).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy("cluster")) - 1)
    k = numbered.agg(F.count("*").alias("k"), (F.sum("s") / F.sum("c")).alias("point"), F.sum("c").alias("n"))
    draws = numbered.select(F.col("i").alias("draw")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).join(F.broadcast(k))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string")).cast("binary"))
    draws = draws.withColumn("i", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("k")).cast("int"))
    means = draws.join(numbered.select("i", "s", "c"), "i").groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    ends = means.agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    return k.join(F.broadcast(ends)).select("point", "lo", "hi", "n")


def cluster_bootstrap_statistic(rows: DataFrame, cluster: str, value: str, statistic: Callable, resamples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """As cluster_bootstrap for any statistic of a numpy array; replicates are dealt over the cluster's machines.

    The values travel once to each group of replicates, so this is for result tables, not for raw data.
    """
    schema = "rep long, m double"
    groups = max(1, min(16, resamples))
    dealt = rows.dropna(subset=[value, cluster]).select(F.col(cluster).cast("string").alias("c"), F.col(value).cast("double").alias("v"))
    dealt = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = int(pdf["g"].iloc[0])
        by = [x.to_numpy() for _, x in pdf.sort_values(["c", "v"]).groupby("c")["v"]]
        out = []
        for rep in range(g, resamples, groups):
            rng = np.random.default_rng([seed, rep])
            out.append((rep, float(statistic(np.concatenate([by[i] for i in rng.integers(0, len(by), len(by))])))))
        return pd.DataFrame(out, columns=["rep", "m"])

    means = dealt.groupBy("g").applyInPandas(run, schema)
    return means.agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
