"""Queries: forecasts, metric grids, significance, agreement and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators import agreement, controls, forecasts, metrics, significance
from voltrace.operators import splits as split_ops
from voltrace.operators.returns import own_date_returns
from voltrace.sources.staging import stage

from . import base, splits
from .registry import query

MODELS = ("persistence", "ewma", "har", "entity_mean")
CELL = ["segment", "target", "horizon", "model"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ok targets with their temporal segment and the EWMA forecast as of day 0, staged."""
    found = stage(base.targets(spark, sf_dir), "targets")
    sides = split_ops.temporal_split(split_ops.load_cohort(found), base.sessions(spark, sf_dir), splits.EMBARGO)
    rows = found.where("status = 'ok'").join(sides.withColumnRenamed("split", "segment"), "call_id")
    vol = forecasts.ewma(own_date_returns(base.bars(spark, sf_dir)))
    days = found.where("status = 'ok'").select("ticker", "as_of").distinct()
    return stage(rows.join(forecasts.as_of_value(days, vol, "ewma"), ["ticker", "as_of"], "left"), "features")


SCHEMES = ("temporal", "disjoint", "combined")


def scheme_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of the validation and test segments of every split scheme, staged; fits are each scheme's own.

    A call that a scheme leaves out has the segment excluded and takes no part in fits or cells.
    """
    found = stage(base.targets(spark, sf_dir), "targets")
    calls = splits.cohort(spark, sf_dir)
    sides = {"temporal": splits.temporal(spark, sf_dir, calls), "disjoint": splits.disjoint(spark, sf_dir, calls)}
    sides["combined"] = split_ops.combined_split(sides["temporal"], sides["disjoint"])
    vol = forecasts.ewma(own_date_returns(base.bars(spark, sf_dir)))
    ok = found.where("status = 'ok'")
    days = forecasts.as_of_value(ok.select("ticker", "as_of").distinct(), vol, "ewma")
    rows = stage(ok.join(days, ["ticker", "as_of"], "left"), "features")
    out = None
    for name in SCHEMES:
        part = rows.join(sides[name].withColumnRenamed("split", "segment"), "call_id", "left").withColumn("segment", F.coalesce("segment", F.lit("excluded")))
        train = F.col("segment") == "train"
        part = forecasts.entity_mean(forecasts.har_forecast(part, train), "ticker", "v_post", train).where("segment IN ('val', 'test')")
        part = forecasts.as_targets(part, MODELS).select(F.lit(name).alias("split"), "call_id", "as_of", *CELL, "y_true", "y_pred", "baseline")
        out = part if out is None else out.unionByName(part)
    return stage(out, "predictions")


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    train = F.col("segment") == "train"
    return forecasts.entity_mean(forecasts.har_forecast(rows, train), "ticker", "v_post", train)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of the validation and test segments, staged."""
    rows = forecast_rows(spark, sf_dir).where("segment IN ('val', 'test')")
    return stage(forecasts.as_targets(rows, MODELS).select("call_id", "as_of", *CELL, "y_true", "y_pred", "baseline"), "predictions")


_SQL = f"""{splits.sql_splits()},
    own AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, ret FROM (
        SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
    vol AS (
        SELECT ticker, date, power(0.94::DOUBLE, n) * (var_pop(ret) OVER w + (1 - 0.94::DOUBLE) * sum(power(0.94::DOUBLE, -n) * ret * ret) OVER w) AS ewma_var
        FROM own WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    feat AS (
        SELECT t.*, s.split AS segment, ln(rv_daily + 1e-12::DOUBLE) AS x1, ln(rv_weekly + 1e-12::DOUBLE) AS x2, ln(rv_monthly + 1e-12::DOUBLE) AS x3,
            CASE WHEN ewma_var > 0 THEN 0.5 * ln(ewma_var) END AS ewma
        FROM (SELECT * FROM targets WHERE status = 'ok') t JOIN temporal s USING (call_id) ASOF LEFT JOIN vol v ON v.ticker = t.ticker AND t.as_of >= v.date
    ),
    moments AS (
        SELECT horizon, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(v_post) AS my,
            covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f,
            covar_pop(x1, v_post) AS p, covar_pop(x2, v_post) AS q, covar_pop(x3, v_post) AS r
        FROM feat WHERE segment = 'train' AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL GROUP BY horizon
    ),
    fits AS (
        SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (
            SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS b1,
                (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - q * c)) / det AS b2,
                (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS b3
            FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM moments)
        )
    ),
    rows_ AS (
        SELECT t.*, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS har, coalesce(o.m, g.m) AS entity_mean FROM feat t
        LEFT JOIN fits USING (horizon)
        LEFT JOIN (SELECT ticker, horizon, avg(v_post) AS m FROM feat WHERE segment = 'train' GROUP BY ALL) o USING (ticker, horizon)
        LEFT JOIN (SELECT horizon, avg(v_post) AS m FROM feat WHERE segment = 'train' GROUP BY ALL) g USING (horizon)
    ),
    preds AS (
        SELECT call_id, as_of, segment, horizon, target, model,
            CASE target WHEN 'v' THEN v_post WHEN 'dv' THEN delta_v ELSE v_post - har END AS y_true,
            CASE target WHEN 'v' THEN v_pre ELSE 0 END AS baseline,
            CASE WHEN model = 'persistence' THEN CASE target WHEN 'v' THEN v_pre ELSE 0 END
                ELSE CASE model WHEN 'ewma' THEN ewma WHEN 'har' THEN har ELSE entity_mean END - CASE target WHEN 'v' THEN 0 WHEN 'dv' THEN v_pre ELSE har END END AS y_pred
        FROM rows_, (SELECT unnest(['v', 'dv', 'har_resid']) AS target), (SELECT unnest({list(MODELS)}) AS model) WHERE segment IN ('val', 'test')
    ),
    ranked AS (
        SELECT *, rank() OVER (PARTITION BY segment, target, horizon, model, quarter ORDER BY y_true) + (count(*) OVER (PARTITION BY segment, target, horizon, model, quarter, y_true) - 1) / 2 AS rx,
            rank() OVER (PARTITION BY segment, target, horizon, model, quarter ORDER BY y_pred) + (count(*) OVER (PARTITION BY segment, target, horizon, model, quarter, y_pred) - 1) / 2 AS ry
        FROM (SELECT *, year(as_of) || 'Q' || quarter(as_of) AS quarter FROM preds) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL
    ),
    quarters AS (
        SELECT segment, target, horizon, model, quarter, CASE WHEN min(y_true) < max(y_true) AND min(y_pred) < max(y_pred) THEN corr(rx, ry) END AS rho
        FROM ranked GROUP BY segment, target, horizon, model, quarter
    )"""


@query(f"WITH {_SQL} SELECT call_id, horizon, segment, {base.sql_r6('ewma', 'har', 'entity_mean')} FROM rows_")
def baseline_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EWMA, heterogeneous autoregression by normal equations, and entity means with fallback."""
    return forecast_rows(spark, sf_dir).select("call_id", "horizon", "segment", *base.r6("ewma", "har", "entity_mean"))


@query(f"WITH {_SQL} SELECT ticker, date, {base.sql_r6('ewma')}, round(ewma_var, 9) AS ewma_var FROM (SELECT *, CASE WHEN ewma_var > 0 THEN 0.5 * ln(ewma_var) END AS ewma FROM vol)")
def ewma_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = forecasts.ewma(own_date_returns(base.bars(spark, sf_dir)))
    return vol.select("ticker", "date", *base.r6("ewma"), F.round("ewma_var", 9).alias("ewma_var"))


@query(f"WITH {_SQL} SELECT horizon, {base.sql_r6('b0', 'b1', 'b2', 'b3')} FROM fits")
def har_ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltrace.functions.numeric import log_variance

    rows = features(spark, sf_dir).where("segment = 'train'")
    fits = forecasts.solve_least_squares(rows, ["horizon"], [log_variance(F.col(c)) for c in forecasts.REGRESSORS], F.col("v_post"))
    found = spark.createDataFrame([(k[0], *map(float, b)) for k, b in sorted(fits.items())], "horizon int, b0 double, b1 double, b2 double, b3 double")
    return found.select("horizon", *base.r6("b0", "b1", "b2", "b3"))


@query(f"""WITH {_SQL} SELECT call_id, segment, target, horizon, model, round(y_true, 6) + 0.0::DOUBLE AS y_true, round(y_pred, 6) + 0.0::DOUBLE AS y_pred FROM preds""")
def target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("call_id", *CELL, *base.r6("y_true", "y_pred"))


@query(f"""WITH {_SQL} SELECT segment, target, horizon, model, n, {base.sql_r6('mse', 'mae', 'r2_oos', 'spearman_q')} FROM (
        SELECT segment, target, horizon, model, count_if(y_true IS NOT NULL AND y_pred IS NOT NULL)::BIGINT AS n, avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae,
            1 - sum((y_true - y_pred) ** 2) FILTER (WHERE y_pred IS NOT NULL AND baseline IS NOT NULL) / nullif(sum((y_true - baseline) ** 2) FILTER (WHERE y_pred IS NOT NULL), 0) AS r2_oos
        FROM preds GROUP BY ALL) LEFT JOIN (SELECT segment, target, horizon, model, avg(rho) AS spearman_q FROM quarters GROUP BY ALL) USING (segment, target, horizon, model)""")
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric cells from one long prediction table."""
    return metrics.metric_cells(predictions(spark, sf_dir), CELL).select(*CELL, "n", *base.r6("mse", "mae", "r2_oos", "spearman_q"))


@query(f"WITH {_SQL} SELECT segment, target, horizon, model, quarter, {base.sql_r6('rho')} FROM quarters")
def spearman_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("quarter", metrics.quarter_of(F.col("as_of")))
    return metrics.spearman(rows, [*CELL, "quarter"], name="rho").select(*CELL, "quarter", *base.r6("rho"))


@query(f"""WITH {_SQL} SELECT target, model, year, n, {base.sql_r6('r2_oos')} FROM (
    SELECT target, model, year(as_of)::INTEGER AS year, count(*) AS n, 1 - sum((y_true - y_pred) ** 2) FILTER (WHERE y_pred IS NOT NULL) / nullif(sum((y_true - baseline) ** 2) FILTER (WHERE y_pred IS NOT NULL), 0) AS r2_oos
    FROM preds WHERE segment = 'test' GROUP BY ALL HAVING count(*) >= 5)""")
def per_year_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("segment = 'test'")
    return metrics.by_year(rows, ["target", "model"]).select("target", "model", "year", "n", *base.r6("r2_oos"))


def _dm_sql(h: int, reference: str = "persistence") -> str:
    parts = " + ".join(["g0", *(f"2 * coalesce(g{k}, 0)" for k in range(1, h))])
    lags = "".join(f", lag(dev, {k}) OVER w AS l{k}" for k in range(1, h))
    gs = "".join(f", avg(dev * l{k}) AS g{k}" for k in range(1, h))
    return f"""WITH {_SQL}, err AS (SELECT *, y_true - y_pred AS e FROM preds WHERE segment = 'test'),
        d AS (
            SELECT a.target, a.horizon, a.model, a.as_of, a.call_id, a.e ** 2 - b.e ** 2 AS d FROM err a
            JOIN err b ON b.model = '{reference}' AND a.model <> '{reference}' AND a.target = b.target AND a.horizon = b.horizon AND a.call_id = b.call_id WHERE a.e IS NOT NULL AND b.e IS NOT NULL
        ),
        dev AS (SELECT *, d - avg(d) OVER (PARTITION BY target, horizon, model) AS dev FROM d),
        lagged AS (SELECT *{lags} FROM dev WINDOW w AS (PARTITION BY target, horizon, model ORDER BY as_of, call_id)),
        g AS (SELECT target, horizon, model, count(*) AS n, avg(d) AS mean_diff, avg(dev * dev) AS g0{gs} FROM lagged GROUP BY ALL)
        SELECT target, horizon, model, n, {base.sql_r6("mean_diff", "dm_stat")} FROM (
            SELECT *, CASE WHEN n >= 2 THEN mean_diff / sqrt(CASE WHEN {parts} > 0 THEN {parts} WHEN g0 > 0 THEN g0 END / n) * sqrt((n + 1 - 2 * {h} + {h * (h - 1)}.0::DOUBLE / n) / n) END AS dm_stat FROM g)"""


def _dm(spark: SparkSession, sf_dir: str, h: int, reference: str = "persistence") -> DataFrame:
    rows = predictions(spark, sf_dir).where("segment = 'test'")
    pairs = significance.against(rows, reference, ["target", "horizon"], "call_id")
    pairs = pairs.select("target", "horizon", "model", "as_of", "call_id", "ea", "eb")
    found = significance.diebold_mariano(pairs, ["target", "horizon", "model"], ["as_of", "call_id"], h=h, p_value=False)
    return found.select("target", "horizon", "model", "n", *base.r6("mean_diff", "dm_stat"))


@query(_dm_sql(1))
def diebold_mariano_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dm(spark, sf_dir, 1)


@query(_dm_sql(3))
def diebold_mariano_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dm(spark, sf_dir, 3)


@query(_dm_sql(1, "har"))
def diebold_mariano_against_har(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dm(spark, sf_dir, 1, "har")


@query()
def diebold_mariano_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-values of Student's t (no SQL function; tested against quadrature) and Holm's correction over horizons."""
    rows = predictions(spark, sf_dir).where("segment = 'test'")
    pairs = significance.against(rows, "persistence", ["target", "horizon"])
    found = significance.diebold_mariano(pairs, ["target", "horizon", "model"], ["as_of", "call_id"])
    return significance.holm(found, ["target", "model"], "dm_p", "holm_p").select("target", "horizon", "model", "n", *base.r6("dm_stat", "dm_p", "holm_p"))


_P_SQL = "SELECT source, lang, CASE WHEN sum(n_chars) % 7 <> 0 THEN (sum(n_chars) % 1000)::DOUBLE / 1000 END AS p FROM documents GROUP BY ALL"


@query(f"""WITH c AS ({_P_SQL}), s AS (SELECT *, (count(p) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source, p IS NULL ORDER BY p) + 1) * p AS step FROM c)
    SELECT source, lang, p, CASE WHEN p IS NOT NULL THEN round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY source, p IS NULL ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) END AS holm_p FROM s""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("s"))
    cells = docs.select("source", "lang", F.when(F.col("s") % 7 != 0, (F.col("s") % 1000) / 1000).alias("p"))
    return significance.holm(cells, ["source"], "p", "holm_p").withColumn("holm_p", F.round("holm_p", 6))


@query("""WITH r AS (SELECT user_id % 23 AS cluster, value FROM events), s AS (SELECT cluster, sum(value) AS s, count(*) AS c, row_number() OVER (ORDER BY cluster) - 1 AS i FROM r GROUP BY cluster),
    k AS (SELECT count(*) AS k, sum(s) / sum(c) AS point, sum(c)::BIGINT AS n FROM s),
    m AS (SELECT rep, sum(t.s) / sum(t.c) AS m FROM (SELECT rep, ('0x' || md5('3:' || rep || ':' || i)[1:12])::BIGINT % k AS pick FROM s, k, (SELECT unnest(generate_series(0, 499)) AS rep)) JOIN s t ON t.i = pick GROUP BY rep)
    SELECT round(any_value(point), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, any_value(n) AS n FROM m, k""")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "events").select((F.col("user_id") % 23).alias("cluster"), "value")
    found = significance.cluster_bootstrap(rows, "cluster", "value", resamples=500, seed=3)
    return found.select(*base.r6("point", "lo", "hi"), "n")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels beside rule-based ratings of the same documents."""
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rated = docs.join(labels, "doc_id").withColumn("n_words", words)
    return rated.select(
        "doc_id",
        "lang",
        F.col("quality").cast("string").alias("quality_h"),
        F.when(F.col("n_words") < 20, "NA").when(F.regexp_count("text", F.lit("[#*$%&!|]")) * 10 > F.col("n_words"), "0").otherwise("1").alias("quality_m"),
        F.least(F.lit(4), F.floor(F.col("n_chars") / 700)).cast("string").alias("length_h"),
        F.least(F.lit(4), F.floor(F.col("n_words") / 160)).cast("string").alias("length_m"),
    )


_RATED = r"""rated AS (
    SELECT doc_id, lang, quality::VARCHAR AS quality_h,
        CASE WHEN n_words < 20 THEN 'NA' WHEN length(regexp_replace(text, '[^#*$%&!|]', '', 'g')) * 10 > n_words THEN '0' ELSE '1' END AS quality_m,
        least(4, n_chars // 700)::VARCHAR AS length_h, least(4, n_words // 160)::VARCHAR AS length_m
    FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM documents JOIN labels USING (doc_id))
)"""


def _kappa_sql(pairs: str, keys: str, weight: str) -> str:
    """pairs: a CTE's name with the keys and a, b."""
    return f"""cls AS (SELECT {keys}, c, row_number() OVER (PARTITION BY {keys} ORDER BY c) AS i FROM (SELECT {keys}, a AS c FROM {pairs} UNION SELECT {keys}, b FROM {pairs})),
        ra AS (SELECT {keys}, a, count(*) AS ra FROM {pairs} GROUP BY ALL), rb AS (SELECT {keys}, b, count(*) AS rb FROM {pairs} GROUP BY ALL),
        oo AS (SELECT {keys}, a, b, count(*) AS o FROM {pairs} GROUP BY ALL), nn AS (SELECT {keys}, count(*) AS n FROM {pairs} GROUP BY ALL),
        kap AS (
            SELECT {keys}, any_value(n) AS n, CASE WHEN any_value(n) >= 2 THEN 1 - sum({weight} * coalesce(o, 0)) / nullif(sum({weight} * ra * rb / n), 0) END AS kappa
            FROM ra JOIN rb USING ({keys}) JOIN nn USING ({keys}) LEFT JOIN oo USING ({keys}, a, b)
            JOIN cls x ON {" AND ".join(f"x.{k} = ra.{k}" for k in keys.split(", "))} AND x.c = a JOIN cls y ON {" AND ".join(f"y.{k} = ra.{k}" for k in keys.split(", "))} AND y.c = b GROUP BY ALL
        )"""


@query(f"WITH {_RATED}, p AS (SELECT lang, quality_h AS a, quality_m AS b FROM rated WHERE quality_m <> 'NA'), {_kappa_sql('p', 'lang', '(a <> b)::INTEGER')} SELECT lang, n, {base.sql_r6('kappa')} FROM kap")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa(_rated(spark, sf_dir), ["lang"], "quality_h", "quality_m").select("lang", "n", *base.r6("kappa"))


@query(f"WITH {_RATED}, p AS (SELECT lang, length_h::DOUBLE AS a, length_m::DOUBLE AS b FROM rated), {_kappa_sql('p', 'lang', 'abs(x.i - y.i)')} SELECT lang, n, {base.sql_r6('kappa')} FROM kap")
def cohen_kappa_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa(_rated(spark, sf_dir), ["lang"], "length_h", "length_m", kind="linear").select("lang", "n", *base.r6("kappa"))


@query(f"WITH {_RATED}, p AS (SELECT lang, (length_h::DOUBLE > 0)::INTEGER AS a, (length_m::DOUBLE > 0)::INTEGER AS b FROM rated), {_kappa_sql('p', 'lang', '(a <> b)::INTEGER')} SELECT lang, n, {base.sql_r6('kappa')} FROM kap")
def cohen_kappa_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa(_rated(spark, sf_dir), ["lang"], "length_h", "length_m", kind="binary").select("lang", "n", *base.r6("kappa"))


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters of document length."""
    r = _rated(spark, sf_dir)
    chars = base.table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(4), F.floor(F.col("n_chars") / 900)).cast("string").alias("value"), F.lit("chars900").alias("rater"))
    return r.select("doc_id", F.col("length_h").alias("value"), F.lit("chars700").alias("rater")).unionByName(r.select("doc_id", F.col("length_m").alias("value"), F.lit("words160").alias("rater"))).unionByName(chars)


@query(f"""WITH {_RATED}, v AS (SELECT doc_id, 'chars700' AS rater, length_h::DOUBLE AS v FROM rated UNION ALL SELECT doc_id, 'words160', length_m::DOUBLE FROM rated UNION ALL SELECT doc_id, 'chars900', least(4, n_chars // 900)::DOUBLE FROM documents),
    p AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.v AS a, y.v AS b FROM v x JOIN v y USING (doc_id) WHERE x.rater < y.rater), {_kappa_sql('p', 'rater_a, rater_b', 'abs(x.i - y.i)')}
    SELECT rater_a, rater_b, n, {base.sql_r6('kappa')} FROM kap""")
def pairwise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = agreement.pairwise(_raters(spark, sf_dir), ["doc_id"], "rater", "value")
    return agreement.kappa(pairs, ["rater_a", "rater_b"], "a", "b", kind="linear").select("rater_a", "rater_b", "n", *base.r6("kappa"))


@query(f"""WITH {_RATED}, p AS (SELECT 1 AS one, quality_h AS a, quality_m AS b FROM rated WHERE quality_m <> 'NA'), {_kappa_sql('p', 'one', '(a <> b)::INTEGER')}
    SELECT count(kappa) AS scored, coalesce(bool_and(kappa >= 0.6), false) AS passes FROM kap""")
def kappa_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = agreement.kappa(_rated(spark, sf_dir), [], "quality_h", "quality_m").withColumn("field", F.lit("quality"))
    return agreement.passes_gate(scores, ["quality"])


@query("""WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY label ORDER BY md5('11:' || vec_id), vec_id) AS j FROM embeddings)
    SELECT a.vec_id, a.label, round(b.embedding[1]::DOUBLE, 6) AS first_component, b.vec_id AS given_by FROM e a JOIN e b ON a.label = b.label AND a.i = b.j""")
def within_group_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings").withColumn("given_by", F.col("vec_id"))
    mixed = controls.shuffle_within(rows, "vec_id", ["embedding", "given_by"], "label", seed=11)
    return mixed.select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_component"), "given_by")


@query("SELECT vec_id, label, CASE WHEN ('0x' || md5('5:' || vec_id)[1:8])::BIGINT % 10000 < 7000 THEN 'train' ELSE 'test' END AS side FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 2)")
def entity_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = controls.with_company(base.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 2)
    return controls.holdout(rows, "vec_id", 0.7, 5)


@query("""WITH s AS (SELECT doc_id FROM documents), f AS (SELECT doc_id FROM labels)
    SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM f EXCEPT ALL SELECT doc_id FROM s) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM s EXCEPT ALL SELECT doc_id FROM f)""")
def frozen_sample_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = base.table(spark, sf_dir, "documents").select("doc_id")
    return controls.frozen_difference(sample, base.table(spark, sf_dir, "labels").select("doc_id"))
