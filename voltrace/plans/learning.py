"""Queries: pooled vectors, feature matrices, learned heads and their controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators import assembly, controls, models
from voltrace.operators.returns import own_date_returns

from . import base, evaluation
from . import text as text_plans
from .registry import query

DENSE = ("v_pre", "rv_daily", "rv_weekly", "rv_monthly")


@query("""WITH e AS (SELECT vec_id, label, vec_id % 5 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    p AS (SELECT label::VARCHAR AS scope, i, count(*) AS n, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END AS m FROM e GROUP BY ALL UNION ALL SELECT 'full', i, count(*), CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END FROM e GROUP BY ALL)
    SELECT scope, (i - 1)::INTEGER AS component, n, round(m, 6) + 0.0::DOUBLE AS value FROM p""")
def embedding_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings").select(F.lit(1).alias("one"), F.col("label").cast("string").alias("scope"), F.col("embedding").alias("vector"), (F.col("vec_id") % 5).alias("w"))
    found = assembly.pool_scopes(rows, "one", "scope", weight="w")
    return found.select("scope", "n", F.posexplode("vector").alias("component", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


_PROBS = "(n_words % 7 + 1)::DOUBLE / 20 AS p_positive, (n_chars % 5 + 1)::DOUBLE / 20 AS p_negative, 1 - (n_words % 7 + 1)::DOUBLE / 20 - (n_chars % 5 + 1)::DOUBLE / 20 AS p_neutral"


@query(f"""WITH RECURSIVE {text_plans._CHUNKS}, p AS (SELECT call_id, section, CASE WHEN role IN ('management', 'analyst') THEN role ELSE 'other' END AS role, {_PROBS} FROM chunks)
    SELECT call_id, scope, role, n_chunks, {base.sql_r6('p_positive', 'p_negative', 'p_neutral', 'net')} FROM (
        SELECT call_id, CASE WHEN grouping(section) = 1 THEN 'full' ELSE section END AS scope, CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role, count(*) AS n_chunks,
            avg(p_positive) AS p_positive, avg(p_negative) AS p_negative, avg(p_neutral) AS p_neutral, avg(p_positive) - avg(p_negative) AS net
        FROM p GROUP BY GROUPING SETS ((call_id, section, role), (call_id, section), (call_id, role), (call_id))) WHERE role <> 'other'""")
def sentiment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, neg = (F.col("n_words") % 7 + 1) / 20, (F.col("n_chars") % 5 + 1) / 20
    rows = text_plans.chunks(spark, sf_dir).withColumns({"p_positive": pos, "p_negative": neg, "p_neutral": 1 - pos - neg})
    found = assembly.probability_cube(rows, "call_id", ["p_positive", "p_negative", "p_neutral"], ["management", "analyst"])
    return found.select("call_id", "scope", "role", "n_chunks", *base.r6("p_positive", "p_negative", "p_neutral", "net"))


@query(f"""WITH RECURSIVE {text_plans._CHUNKS}, s AS (SELECT call_id, CASE WHEN grouping(section) = 1 THEN 'full' ELSE section END AS scope, sum(n_words)::DOUBLE AS n_words, count(DISTINCT turn_idx)::DOUBLE AS n_turns FROM chunks GROUP BY GROUPING SETS ((call_id, section), (call_id)))
    SELECT call_id, {", ".join(f"coalesce(max({v}) FILTER (WHERE scope = '{s}'), 0) AS {s}_{v}" for s in ("full", "prepared_remarks", "qa") for v in ("n_words", "n_turns"))} FROM s GROUP BY call_id""")
def design_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltrace.functions import text

    stats = text.surface_stats(text_plans.chunks(spark, sf_dir))
    return assembly.widen(stats, "call_id", ["scope"], ["n_words", "n_turns"], [("full",), ("prepared_remarks",), ("qa",)])


_BLOCKS = {"a": "true", "b": "label < 5", "c": "label >= 3"}


@query(f"""SELECT vec_id, {", ".join(f"{k} AS has_{n}" for n, k in _BLOCKS.items())}, i - 1 AS component,
    {", ".join(f"round(CASE WHEN {k} THEN embedding[i]::DOUBLE ELSE 0 END, 6) + 0.0::DOUBLE AS {n}" for n, k in _BLOCKS.items())} FROM embeddings, (SELECT unnest(generate_series(1, 64))::INTEGER AS i)""")
def feature_blocks_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of vectors, two of them held by some labels only, joined whole."""
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    found = assembly.outer_blocks({n: e.where(k).select("vec_id", "vector") for n, k in _BLOCKS.items()}, "vec_id", dict.fromkeys(_BLOCKS, 64))
    rows = found.select("vec_id", "has_a", "has_b", "has_c", F.posexplode(F.arrays_zip("a", "b", "c")).alias("component", "x"))
    return rows.select("vec_id", "has_a", "has_b", "has_c", "component", *((F.round(f"x.{n}", 6) + F.lit(0.0)).alias(n) for n in _BLOCKS))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings)
    SELECT vec_id, round(norm, 6) AS norm, i - 1 AS component, round(embedding[i] / norm, 6) + 0.0::DOUBLE AS value FROM n, (SELECT unnest(generate_series(1, 64))::INTEGER AS i)""")
def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = e.select("vec_id", F.round(norm, 6).alias("norm"), F.posexplode(assembly.l2_normalized(F.col("embedding"))).alias("component", "value"))
    return rows.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"""WITH {evaluation._SQL}
    SELECT call_id, horizon, round(coalesce(CASE WHEN call_id % 4 <> 0 THEN rv_monthly END, m2.med, 0), 9) AS rv_monthly FROM feat, (SELECT quantile_cont(CASE WHEN call_id % 4 <> 0 THEN rv_monthly END, 0.5) FILTER (WHERE segment = 'train') AS med FROM feat) m2""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.features(spark, sf_dir).withColumn("rv_monthly", F.when(F.col("call_id") % 4 != 0, F.col("rv_monthly")))
    found = assembly.impute_medians(rows, ["rv_monthly"], F.col("segment") == "train")
    return found.select("call_id", "horizon", F.round("rv_monthly", 9).alias("rv_monthly"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, any_value(n) AS n, min(n_chars) AS min, round(avg(n_chars), 6) AS mean, sum(n_chars)::BIGINT AS sum, max(n_chars) FILTER (WHERE k = least(n - 1, floor(0.05::DOUBLE * n)::BIGINT)) AS p05,
        max(n_chars) FILTER (WHERE k = least(n - 1, floor(0.5::DOUBLE * n)::BIGINT)) AS p50, max(n_chars) FILTER (WHERE k = least(n - 1, floor(0.95::DOUBLE * n)::BIGINT)) AS p95 FROM r GROUP BY lang""")
def rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assembly.rank_percentiles(base.table(spark, sf_dir, "documents"), "n_chars", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["lang"])
    return found.withColumn("mean", F.round("mean", 6))


@query("""SELECT feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (
    SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) GROUP BY feature""")
def feature_summary_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assembly.feature_summary(base.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return found.select("feature", "n", *base.r6("mean", "std"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of all horizons with a past-volatility vector and a document vector for the call."""
    rows = evaluation.features(spark, sf_dir)
    rows = assembly.impute_medians(rows, list(DENSE), F.col("segment") == "train")
    e = base.table(spark, sf_dir, "embeddings")
    k = e.count()
    e = e.select(F.col("vec_id").alias("e_id"), F.col("embedding").cast("array<double>").alias("text"))
    rows = rows.withColumn("e_id", F.col("call_id") % k).join(e, "e_id", "left").drop("e_id")
    return rows.withColumn("text", F.coalesce("text", F.array_repeat(F.lit(0.0), 64))).withColumn("dense", F.array(*(F.col(c) for c in DENSE)))


def _alpha(alphas: dict[tuple, float]) -> Column:
    """The penalty that each horizon chose."""
    return F.element_at(F.create_map(*(x for k, v in alphas.items() for x in (F.lit(k[0]), F.lit(v)))), F.col("horizon"))


def _scored(found: DataFrame, *by: str) -> DataFrame:
    return found.where("segment = 'test'").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("pred") - F.col("v_post"), 2)).alias("mse"))


@query()
def ridge_alpha_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge heads of each horizon on past volatility with and without text, scored on the test segment."""
    rows = _wide(spark, sf_dir).withColumn("both", F.concat("dense", "text"))
    out = None
    for name in ("dense", "both"):
        found, alphas = models.ridge(rows, name, "v_post", by=("horizon",))
        cell = _scored(found, "horizon").select("horizon", F.lit(name).alias("features"), _alpha(alphas).alias("alpha"), "n", *base.r6("mse"))
        out = cell if out is None else out.unionByName(cell)
    return out


@query()
def gbdt_fixed_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with the ticker as a category over two seeds, averaged with the deviation of their errors."""
    from voltrace.operators import metrics

    rows = evaluation.features(spark, sf_dir).where("horizon = 7").withColumn("one", F.lit("gbdt"))
    found = models.boosted_trees(rows, [*DENSE, "ewma"], "ticker", "v_post", F.col("segment") == "train", seeds=(0, 1), trees=8, depth=3)
    scored = found.where("segment = 'test'").select("one", "seed", "as_of", F.col("v_post").alias("y_true"), F.col("pred").alias("y_pred"), F.col("v_pre").alias("baseline"))
    return metrics.seed_average(scored, ["one"]).select(F.col("one").alias("model"), *base.r6("n", "mse", "mae", "r2_oos", "spearman_q", "mse_std"))


@query()
def mlp_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir).where("horizon = 7")
    found = models.network(rows, "dense", "v_post", F.col("segment") == "train", seeds=(0, 1), hidden=32, epochs=30)
    return found.where("segment = 'test'").groupBy("seed").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("pred") - F.col("v_post"), 2)).alias("mse")).select("seed", "n", *base.r6("mse"))


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train-fit, centered principal components of the embeddings; signs are arbitrary, so squares are returned."""
    rows = controls.holdout(base.table(spark, sf_dir, "embeddings"), "vec_id", 0.7, 5)
    found = models.centered_pca(rows, F.col("side") == "train", "embedding", 8)
    return found.select("vec_id", "side", F.transform("pca", lambda x: F.round(x * x, 6)).alias("squares"))


@query()
def gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks reduced and set to length 1, joined with dense numbers, under a network."""
    rows = _wide(spark, sf_dir).where("horizon = 7")
    fused = models.gated_blocks(rows, F.col("segment") == "train", ["text"], list(DENSE), k=8)
    net = models.network(fused, "fused", "v_post", F.col("segment") == "train", hidden=32, epochs=20)
    return net.where("segment = 'test'").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("pred") - F.col("v_post"), 2)).alias("mse")).select(F.lit("gated_fusion").alias("model"), "n", *base.r6("mse"))


@query()
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wide(spark, sf_dir)
    one, _ = models.ridge(rows, "dense", "v_post", by=("horizon",))
    two, _ = models.ridge(one.withColumnRenamed("pred", "base_dense"), "text", "v_post", by=("horizon",))
    found, alphas = models.stack(two.withColumnRenamed("pred", "base_text"), ["base_dense", "base_text"], "v_post", by=("horizon",))
    return _scored(found, "horizon").select(F.lit("stack").alias("model"), "horizon", _alpha(alphas).alias("alpha"), "n", *base.r6("mse"))


@query()
def identity_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = controls.holdout(controls.with_company(base.table(spark, sf_dir, "embeddings"), "label"), "vec_id", 0.7, 5)
    found = models.identity_probe(rows, "embedding", "label")
    return found.select("n", "n_entities", *base.r6("accuracy", "chance", "over_chance"))


@query()
def shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fitted ridge a horizon scored on test rows as they are, with text permuted within tickers, and permuted at large."""
    rows = _wide(spark, sf_dir).withColumn("both", F.concat("dense", "text")).select("call_id", "ticker", "horizon", "segment", "v_post", "dense", "text")
    test = rows.where("segment = 'test'")
    variants = {"real": test, "within_shuffle": controls.shuffle_within(test.withColumn("cell", F.struct("horizon", "ticker")), "call_id", ["text"], "cell", 3).drop("cell"), "global_shuffle": controls.shuffle_within(test, "call_id", ["text"], "horizon", 3)}
    frame = rows.where("segment != 'test'").withColumn("condition", F.lit("fit"))
    for name, part in variants.items():
        frame = frame.unionByName(part.withColumn("condition", F.lit(name)))
    found, _ = models.ridge(frame.withColumn("both", F.concat("dense", "text")), "both", "v_post", by=("horizon",))
    return _scored(found, "condition", "horizon").select("condition", "horizon", "n", *base.r6("mse"))


@query()
def garch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GARCH(1, 1) forecasts as of every day 0, by own maximum likelihood."""
    days = base.targets(spark, sf_dir).where("as_of IS NOT NULL").select("ticker", "as_of").distinct()
    found = models.garch(days, own_date_returns(base.bars(spark, sf_dir)), (3, 7, 15, 30))
    return found.select("ticker", "as_of", "horizon", F.round("garch", 4).alias("garch"), "converged")
