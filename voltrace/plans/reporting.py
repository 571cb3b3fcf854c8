"""Queries: reports, gates, audits, page metadata and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrace.functions.numeric import log_vol
from voltrace.operators import calendar, metrics, reports
from voltrace.sources import readers, sinks

from . import base, evaluation
from . import text as text_plans
from .registry import query

_HORIZONS = (3, 7, 15, 30)
_CELLS = f"""{evaluation._SQL}, cells AS (
    SELECT segment, target, horizon, model, avg((y_true - y_pred) ** 2) AS mse, 1 - sum((y_true - y_pred) ** 2) FILTER (WHERE y_pred IS NOT NULL) / nullif(sum((y_true - baseline) ** 2) FILTER (WHERE y_pred IS NOT NULL), 0) AS r2_oos
    FROM preds GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, b = F.col("y_true"), F.col("y_pred"), F.col("baseline")
    return evaluation.predictions(spark, sf_dir).groupBy(*evaluation.CELL).agg(metrics.mse(t, p).alias("mse"), metrics.r2_oos(t, p, b).alias("r2_oos"))


@query(f"""WITH {_CELLS} SELECT target, model, {", ".join(f"coalesce(max(CASE WHEN r2_oos IS NULL THEN '—' ELSE printf('%.3f', r2_oos) END) FILTER (WHERE horizon = {h}), '—') AS tau_{h}" for h in _HORIZONS)}
    FROM cells WHERE segment = 'test' GROUP BY ALL""")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_grid(_cells(spark, sf_dir).where("segment = 'test'"), ["target", "model"], _HORIZONS)


@query(f"""WITH {_CELLS} SELECT 'S0' AS stage, horizon, segment, target, model, round(mse, 6) AS mse, NULL::DOUBLE AS r2_oos FROM cells WHERE model = 'har' AND target = 'v'
    UNION ALL SELECT 'S1', horizon, segment, target, model, round(mse, 6), round(r2_oos, 6) + 0.0::DOUBLE FROM cells WHERE model = 'entity_mean' AND target = 'dv'""")
def stage_grid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    tables = {"S0": cells.where("target = 'v'").drop("r2_oos"), "S1": cells.where("target = 'dv'")}
    grid = reports.consolidated(tables, {"S0": "har", "S1": "entity_mean", "S2": "text_ridge"})
    return grid.select("stage", "horizon", "segment", "target", "model", *base.r6("mse", "r2_oos"))


@query(f"""WITH {_CELLS} SELECT count(*) AS cells, count_if(coalesce(a < b, false))::BIGINT AS wins, count(*) - count_if(coalesce(a < b, false)) <= 1 AS passes FROM (
    SELECT horizon, max(mse) FILTER (WHERE model = 'har') AS a, max(mse) FILTER (WHERE model = 'persistence') AS b FROM cells WHERE segment = 'test' AND target = 'v' GROUP BY horizon)""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the autoregression beats persistence at all horizons but at most one."""
    return reports.gate(_cells(spark, sf_dir).where("segment = 'test' AND target = 'v'"), "har", "persistence", allowed=1)


@query(f"WITH {base.sql_targets()} SELECT horizon, count(*) AS n, 0.0::DOUBLE AS worst_pre, 0.0::DOUBLE AS worst_post FROM targets WHERE status = 'ok' GROUP BY horizon")
def target_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference between the targets and a second implementation that explodes the sessions around each call."""
    known = base.sessions(spark, sf_dir)
    ok = base.targets(spark, sf_dir).where("status = 'ok'").select("call_id", "ticker", "as_of", "horizon", "v_pre", "v_post")
    days = ok.select("ticker", "as_of").distinct().join(F.broadcast(known.withColumnRenamed("idx", "day0_idx")), F.col("as_of") == F.col("session_date")).drop("session_date")
    around = calendar.session_offsets(days, known, 30, 30).join(base.bars(spark, sf_dir).withColumnRenamed("date", "session_date"), ["ticker", "session_date"], "left")
    w = Window.partitionBy("ticker", "as_of").orderBy("offset")
    around = around.withColumn("ret", F.when(F.col("offset") - F.lag("offset").over(w) == 1, F.col("close") / F.lag("close").over(w) - 1))
    again = None
    for h in _HORIZONS:
        pre, post = F.col("offset").between(1 - h, 0), F.col("offset").between(1, h)
        part = around.groupBy("ticker", "as_of").agg(*(log_vol(F.var_pop(F.when(c, F.col("ret")))).alias(n) for n, c in (("again_pre", pre), ("again_post", post)))).withColumn("horizon", F.lit(h))
        again = part if again is None else again.unionByName(part)
    both = ok.join(again, ["ticker", "as_of", "horizon"])
    worst = [(F.round(F.max(F.abs(F.col(f"v_{s}") - F.col(f"again_{s}"))), 6) + F.lit(0.0)).alias(f"worst_{s}") for s in ("pre", "post")]
    return both.groupBy("horizon").agg(F.count("*").alias("n"), *worst)


@query("""WITH c AS (SELECT o_orderkey AS call_id, 's.' || (o_custkey % 120) AS ticker FROM orders), p AS (SELECT DISTINCT 's.' || l_suppkey AS ticker FROM lineitem)
    SELECT count(*) AS calls, count_if(ticker IN (SELECT ticker FROM p))::BIGINT AS joined, round(count_if(ticker IN (SELECT ticker FROM p)) / count(*), 6) AS join_rate,
        count(DISTINCT ticker) FILTER (WHERE ticker NOT IN (SELECT ticker FROM p)) AS missing_tickers FROM c""")
def join_rate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with and without prices: a semi join, an anti join and their counts."""
    calls = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("s."), F.col("o_custkey") % 120).alias("ticker"))
    prices = base.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s."), "l_suppkey").alias("ticker")).distinct()
    joined = calls.join(prices, "ticker", "left_semi").agg(F.count("*").alias("joined"))
    missing = calls.join(prices, "ticker", "left_anti").agg(F.countDistinct("ticker").alias("missing_tickers"))
    out = calls.agg(F.count("*").alias("calls")).join(F.broadcast(joined)).join(F.broadcast(missing))
    return out.select("calls", "joined", F.round(F.try_divide("joined", "calls"), 6).alias("join_rate"), "missing_tickers")


@query(r"""SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1), '') AS lang,
    nullif(regexp_extract(html, '(?i)<meta[^>]*\bcharset="?([^"\s>]+)', 1), '') AS charset, len(regexp_extract_all(html, '(?i)<a[ >]')) AS n_links FROM pages""")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and languages of pages, in the role of documents' own metadata."""
    return base.table(spark, sf_dir, "pages").select("page_id", readers.page_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


@query("""SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows that don't overlap."""
    found = base.table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return found.select("event_type", F.col("w.start").alias("window_start"), "n", "value")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = base.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value * value) FILTER (WHERE value < 50), 6) AS low_mse, round(avg(value * value) FILTER (WHERE value >= 50), 6) AS high_mse FROM events GROUP BY event_type""")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and conditional means of squares by band."""
    v = F.col("value")
    return base.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.avg(F.when(v < 50, v * v)), 6).alias("low_mse"), F.round(F.avg(F.when(v >= 50, v * v)), 6).alias("high_mse")
    )


@query("SELECT 'quality' AS field, count_if(quality NOT IN (0, 1) OR quality IS NULL)::BIGINT AS n_bad FROM labels UNION ALL SELECT 'n_chars', count_if(n_chars < 0 OR n_chars <> length(text))::BIGINT FROM documents")
def range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of range; a loader raises where any count isn't 0."""
    labels, docs = base.table(spark, sf_dir, "labels"), base.table(spark, sf_dir, "documents")
    q = F.col("quality")
    one = labels.agg(F.count_if(~F.coalesce(q.isin(0, 1), F.lit(False))).alias("n_bad")).select(F.lit("quality").alias("field"), "n_bad")
    n = F.col("n_chars")
    two = docs.agg(F.count_if((n < 0) | (n != F.length("text"))).alias("n_bad")).select(F.lit("n_chars").alias("field"), "n_bad")
    return one.unionByName(two)


@query("""WITH s AS (SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents)
    SELECT 'documents' AS metric, documents::VARCHAR AS value FROM s UNION ALL SELECT 'sources', sources::VARCHAR FROM s UNION ALL SELECT 'chars', chars::VARCHAR FROM s""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as metric and value rows."""
    row = base.table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    return sinks.as_metrics(row)


@query(f"WITH {text_plans._TURNS} SELECT call_id, sha256('# ' || call_id || chr(10) || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn_idx)) AS hash FROM turns GROUP BY call_id")
def transcript_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sinks.transcript_markdown(text_plans.turns(spark, sf_dir))
    return found.select("call_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("hash"))


@query()
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the input files (no SQL over file contents; tested on files of known content)."""
    files = readers.list_files(spark, sf_dir, "*.parquet")
    listed = sinks.build_manifest(files, F.lit("supplied"), "synthetic", "2024-01-01")
    return listed.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "sha256", "license")


@query("""WITH g AS (SELECT conv_id, turn, length(text) AS n FROM conversations), m AS (SELECT DISTINCT conv_id FROM g)
    SELECT m.conv_id, p AS place, coalesce(g.n, 0) AS n_chars FROM m CROSS JOIN (SELECT unnest(generate_series(0, 522))::INTEGER AS p) LEFT JOIN g ON g.conv_id = m.conv_id AND g.turn = p""")
def sequence_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group at 523 positions, zeros where it has none."""
    turns = base.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("place"), F.length("text").cast("long").alias("n"))
    slots = turns.select("conv_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(522))))
    return slots.join(turns, ["conv_id", "place"], "left").select("conv_id", "place", F.coalesce("n", F.lit(0)).alias("n_chars"))


@query("""WITH a AS (SELECT l_returnflag || l_linestatus AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS a FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
    b AS (SELECT l_returnflag || l_linestatus AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS b FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
    SELECT ticker, date, round(coalesce(a, b), 6) AS close, round(100 * abs(a - b) / nullif(a, 0), 6) + 0.0::DOUBLE AS apart_pct, CASE WHEN a IS NULL THEN 'second' WHEN b IS NULL THEN 'first' ELSE 'both' END AS source FROM a FULL JOIN b USING (ticker, date)""")
def two_source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source's price, else the second's, with their difference in percent."""
    items = base.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity", "l_linenumber")

    def side(rest: int, name: str) -> DataFrame:
        return items.where(F.col("l_linenumber") % 2 == rest).groupBy("ticker", "date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias(name))

    both = side(0, "a").join(side(1, "b"), ["ticker", "date"], "full")
    apart = F.try_divide(100 * F.abs(F.col("a") - F.col("b")), F.nullif(F.col("a"), F.lit(0.0)))
    source = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both")
    return both.select("ticker", "date", F.round(F.coalesce("a", "b"), 6).alias("close"), (F.round(apart, 6) + F.lit(0.0)).alias("apart_pct"), source.alias("source"))


@query("SELECT CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'train' WHEN o_orderdate < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS split, count(*) AS n_calls, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date FROM orders GROUP BY 1")
def fixed_date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    split = F.when(day < "1999-01-01", "train").when(day < "2000-06-01", "val").otherwise("test")
    return base.table(spark, sf_dir, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n_calls"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))
