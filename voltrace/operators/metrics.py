"""Evaluation metrics over long prediction tables: every metric cell of a grid from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrace.functions.numeric import pearson


def quarter_of(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("Q"), F.quarter(day))


def mse(true: Column, pred: Column) -> Column:
    return F.avg(F.pow(true - pred, 2))


def mae(true: Column, pred: Column) -> Column:
    return F.avg(F.abs(true - pred))


def r2_oos(true: Column, pred: Column, baseline: Column) -> Column:
    """1 - SSE / SSE of the baseline over complete triples; NULL without any baseline error."""
    whole = true.isNotNull() & pred.isNotNull() & baseline.isNotNull()
    return 1 - F.try_divide(F.sum(F.when(whole, F.pow(true - pred, 2))), F.nullif(F.sum(F.when(whole, F.pow(true - baseline, 2))), F.lit(0.0)))


def average_rank(by: list[str], x: str) -> Column:
    """Rank of x among its group from 1; ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(rows: DataFrame, by: list[str], x: str = "y_true", y: str = "y_pred", name: str = "spearman") -> DataFrame:
    """(by, name): rank correlation over complete pairs; NULL below two pairs or for a constant side."""
    ranked = rows.dropna(subset=[x, y]).withColumn("rx", average_rank(by, x)).withColumn("ry", average_rank(by, y))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return ranked.groupBy(*by).agg(F.when(~constant, pearson(F.col("rx"), F.col("ry"))).alias(name))


def spearman_by_quarter(rows: DataFrame, by: list[str], day: str = "as_of") -> DataFrame:
    """(by, spearman_q): the mean over calendar quarters of each quarter's rank correlation; quarters without one are left out."""
    quarters = spearman(rows.withColumn("quarter", quarter_of(F.col(day))), [*by, "quarter"])
    return quarters.groupBy(*by).agg(F.avg("spearman").alias("spearman_q"))


def metric_cells(rows: DataFrame, by: list[str], day: str = "as_of") -> DataFrame:
    """(by, n, mse, mae, r2_oos, spearman_q) for rows with y_true, y_pred, baseline; n counts complete pairs."""
    t, p, b = F.col("y_true"), F.col("y_pred"), F.col("baseline")
    sums = rows.groupBy(*by).agg(F.count_if(t.isNotNull() & p.isNotNull()).alias("n"), mse(t, p).alias("mse"), mae(t, p).alias("mae"), r2_oos(t, p, b).alias("r2_oos"))
    return sums.join(spearman_by_quarter(rows, by, day), by, "left")


def by_year(rows: DataFrame, by: list[str], day: str = "as_of", least: int = 5) -> DataFrame:
    """(by, year, n, r2_oos) of years with at least ``least`` rows."""
    years = rows.withColumn("year", F.year(day)).groupBy(*by, "year")
    cells = years.agg(F.count("*").alias("n"), r2_oos(F.col("y_true"), F.col("y_pred"), F.col("baseline")).alias("r2_oos"))
    return cells.where(F.col("n") >= least)


def seed_average(rows: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """(by, metric means over seeds, mse_std): the population deviation of the seeds' MSE."""
    per_seed = metric_cells(rows, [*by, seed])
    return per_seed.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("n", "mse", "mae", "r2_oos", "spearman_q")), F.stddev_pop("mse").alias("mse_std"))
