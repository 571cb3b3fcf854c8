"""Leakage-proof splits: temporal with an embargo, disjoint by entity, and where both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATIOS = (0.7, 0.1, 0.2)
SEGMENTS = ("train", "val", "test")


def load_cohort(targets: DataFrame) -> DataFrame:
    """One row for each call with an ok target: (call_id, ticker, as_of, longest), longest being its longest ok horizon."""
    ok = targets.where("status = 'ok'")
    return ok.groupBy("call_id").agg(F.min("ticker").alias("ticker"), F.min("as_of").alias("as_of"), F.max("horizon").alias("longest"))


def boundaries(cohort: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """One row (b1, b2): the session numbers at the ranks min(n - 1, int(share * n)) of the calls in order.

    Calls are counted by session first, so ranks are found on the small calendar and not by a sort of all calls.
    """
    counts = cohort.groupBy("idx").agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("idx"))).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))

    def rank(share: float):
        return F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))

    first, second = rank(ratios[0]), rank(ratios[0] + ratios[1])
    return run.agg(F.min(F.when(F.col("upto") > first, F.col("idx"))).alias("b1"), F.min(F.when(F.col("upto") > second, F.col("idx"))).alias("b2"))


def temporal_split(cohort: DataFrame, sessions: DataFrame, embargo: int, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(call_id, split): train, val and test in order of as_of, calls within the gap before a boundary are embargo.

    The gap is the larger of ``embargo`` and the longest ok horizon, so no target window crosses a boundary. An as_of that
    is no session is an error.
    """
    numbered = cohort.join(F.broadcast(sessions), cohort["as_of"] == sessions["session_date"], "left")
    numbered = numbered.withColumn("idx", F.when(F.col("idx").isNull(), F.raise_error(F.lit("as_of is not a session")).cast("long")).otherwise(F.col("idx")))
    edges = boundaries(numbered, ratios).crossJoin(numbered.agg(F.greatest(F.max("longest"), F.lit(embargo)).alias("gap")))
    idx, b1, b2, gap = (F.col(c) for c in ("idx", "b1", "b2", "gap"))
    split = F.when(idx <= b1 - gap, "train").when((idx > b1) & (idx <= b2 - gap), "val").when(idx > b2, "test").otherwise("embargo")
    return numbered.join(F.broadcast(edges)).select("call_id", split.alias("split"))  # edges: one row


def disjoint_split(cohort: DataFrame, entity: str, seed: int = 0, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(call_id, split): whole entities in train, val or test. Entities stand in the order of a salted hash and go by the
    number of calls before them against 0.7 n and (0.7 + 0.1) n."""
    counts = cohort.groupBy(entity).agg(F.count("*").alias("c"))
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string")).cast("binary"))).rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.sum("c").alias("n"))
    before = F.coalesce(F.col("before"), F.lit(0))
    share = F.lit(ratios[0]) * F.col("n"), F.lit(ratios[0] + ratios[1]) * F.col("n")
    split = F.when(before < share[0], "train").when(before < share[1], "val").otherwise("test")
    sides = counts.withColumn("before", F.sum("c").over(order)).join(F.broadcast(total)).select(entity, split.alias("split"))
    return cohort.join(sides, entity).select("call_id", "split")


def combined_split(one: DataFrame, other: DataFrame) -> DataFrame:
    """(call_id, split): the split on which both agree, else excluded; a call that ``other`` lacks is excluded."""
    both = one.join(other.withColumnRenamed("split", "other"), "call_id", "left")
    agree = (F.col("split") == F.col("other")) & F.col("split").isin(*SEGMENTS)
    return both.select("call_id", F.when(agree, F.col("split")).otherwise("excluded").alias("split"))


def split_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").alias("n_calls"))


def leakage(cohort: DataFrame, temporal: DataFrame, disjoint: DataFrame, entity: str, sessions: DataFrame) -> DataFrame:
    """One row of findings that must all be 0: entities on two sides, pairs of segments closer than the gap, lost calls."""
    sides = cohort.join(disjoint, "call_id").groupBy(entity).agg(F.countDistinct("split").alias("k"))
    shared = sides.agg(F.count_if(F.col("k") > 1).alias("entities_on_two_sides"))
    lost = cohort.select("call_id").exceptAll(temporal.select("call_id")).agg(F.count("*").alias("calls_without_split"))
    numbered = cohort.join(F.broadcast(sessions), cohort["as_of"] == sessions["session_date"]).join(temporal, "call_id")
    ends = numbered.groupBy().agg(
        *(F.max(F.when(F.col("split") == s, F.col("idx"))).alias(f"{s}_last") for s in SEGMENTS),
        *(F.min(F.when(F.col("split") == s, F.col("idx"))).alias(f"{s}_first") for s in SEGMENTS),
        F.max("longest").alias("gap"),
    )
    close = sum((F.coalesce((F.col(f"{b}_first") - F.col(f"{a}_last") < F.col("gap")).cast("long"), F.lit(0)) for a, b in (("train", "val"), ("val", "test"))), F.lit(0))
    return shared.join(F.broadcast(lost)).join(F.broadcast(ends.select(close.cast("long").alias("segments_too_close"))))
