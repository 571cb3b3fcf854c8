"""Rater agreement: Cohen's kappa in its nominal, linear-weighted and present/absent forms, and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THRESHOLD = 0.6


def usable(value: Column) -> Column:
    """A rating as a string, NULL if blank or the marker NA."""
    text = F.trim(value.cast("string"))
    return F.when(~text.isin("", "NA"), text)


def kappa(pairs: DataFrame, by: list[str], a: str, b: str, kind: str = "nominal") -> DataFrame:
    """(by, n, kappa) over rows where both ratings are usable; NULL below two rows or with a single shared class.

    nominal compares strings; linear weighs a disagreement by the distance of the classes' positions in the sorted union
    of the group's observed classes (numbers); binary compares whether counts are above zero.
    """
    if kind not in ("nominal", "linear", "binary"):
        raise ValueError(f"unknown kind {kind!r}")
    x, y = usable(F.col(a)), usable(F.col(b))
    if kind == "linear":
        x, y = x.cast("double"), y.cast("double")
    if kind == "binary":
        x, y = (x.cast("double") > 0).cast("int"), (y.cast("double") > 0).cast("int")
    both = pairs.select(*by, x.alias("a"), y.alias("b")).dropna(subset=["a", "b"])
    table = both.groupBy(*by, "a", "b").agg(F.count("*").alias("o"))
    # positions of the classes, rows, columns and totals of the small contingency table
    classes = table.select(*by, F.explode(F.array("a", "b")).alias("c")).distinct()
    classes = classes.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("c")) - 1)
    rows = table.groupBy(*by, F.col("a").alias("ca")).agg(F.sum("o").alias("ra"))
    cols = table.groupBy(*by, F.col("b").alias("cb")).agg(F.sum("o").alias("rb"))
    n = table.groupBy(*by).agg(F.sum("o").alias("n"))
    keyed = by or ["one"]
    frames = [f if by else f.withColumn("one", F.lit(1)) for f in (rows, cols, n, table, classes)]
    rows, cols, n, table, classes = frames
    cells = rows.join(cols, keyed).join(n, keyed)
    cells = cells.join(table.select(*keyed, F.col("a").alias("ca"), F.col("b").alias("cb"), "o"), [*keyed, "ca", "cb"], "left")
    cells = cells.join(classes.select(*keyed, F.col("c").alias("ca"), F.col("i").alias("ia")), [*keyed, "ca"]).join(
        classes.select(*keyed, F.col("c").alias("cb"), F.col("i").alias("ib")), [*keyed, "cb"]
    )
    weight = F.abs(F.col("ia") - F.col("ib")) if kind == "linear" else (F.col("ia") != F.col("ib")).cast("int")
    observed, expected = F.sum(weight * F.coalesce("o", F.lit(0))), F.sum(weight * F.col("ra") * F.col("rb") / F.col("n"))
    out = cells.groupBy(*keyed).agg(F.first("n").alias("n"), F.try_divide(observed.cast("double"), F.nullif(expected, F.lit(0.0))).alias("d"))
    return out.select(*by, "n", F.when(F.col("n") >= 2, 1 - F.col("d")).alias("kappa"))


def pairwise(ratings: DataFrame, keys: list[str], rater: str, value: str) -> DataFrame:
    """(rater_a, rater_b, keys, a, b): every pair of raters, the smaller name first, on the keys that both rated."""
    one = ratings.select(*keys, F.col(rater).alias("rater_a"), F.col(value).alias("a"))
    two = ratings.select(*keys, F.col(rater).alias("rater_b"), F.col(value).alias("b"))
    return one.join(two, keys).where("rater_a < rater_b")


def passes_gate(scores: DataFrame, fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row (scored, passes): whether all scored ones of the confirmatory fields reach the threshold; none scored fails."""
    own = scores.where(F.col("field").isin(*fields))
    return own.agg(F.count("kappa").alias("scored"), F.coalesce(F.bool_and(F.when(F.col("kappa").isNotNull(), F.col("kappa") >= threshold)), F.lit(False)).alias("passes"))
