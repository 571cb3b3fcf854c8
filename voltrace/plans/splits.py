"""Queries: cohorts, splits, universe, coverage and cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators import coverage, splits
from voltrace.sources.staging import stage

from . import base
from .registry import query

EMBARGO, SEED = 30, 7


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an ok target and their customer as entity."""
    customers = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("entity"))
    return stage(splits.load_cohort(base.targets(spark, sf_dir)).join(customers, "call_id"), "cohort")


def temporal(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None) -> DataFrame:
    return splits.temporal_split(calls if calls is not None else cohort(spark, sf_dir), base.sessions(spark, sf_dir), EMBARGO)


def disjoint(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None) -> DataFrame:
    return splits.disjoint_split(calls if calls is not None else cohort(spark, sf_dir), "entity", SEED)


def sql_splits() -> str:
    """CTEs that end with ``cohort``, ``temporal``, ``disjoint`` and ``combined``."""
    return f"""{base.sql_targets()},
    cohort AS (
        SELECT call_id, any_value(ticker) AS ticker, any_value(as_of) AS as_of, max(horizon) AS longest, any_value(o_custkey) AS entity
        FROM targets JOIN orders ON o_orderkey = call_id WHERE status = 'ok' GROUP BY call_id
    ),
    numbered AS (SELECT c.*, s.idx, row_number() OVER (ORDER BY s.idx, c.call_id) - 1 AS k, count(*) OVER () AS n FROM cohort c JOIN sessions s ON s.session_date = c.as_of),
    edges AS (
        SELECT max(idx) FILTER (WHERE k = least(n - 1, floor(0.7::DOUBLE * n)::BIGINT)) AS b1,
            max(idx) FILTER (WHERE k = least(n - 1, floor((0.7::DOUBLE + 0.1::DOUBLE) * n)::BIGINT)) AS b2, greatest(max(longest), {EMBARGO}) AS gap FROM numbered
    ),
    temporal AS (
        SELECT call_id, CASE WHEN idx <= b1 - gap THEN 'train' WHEN idx > b1 AND idx <= b2 - gap THEN 'val' WHEN idx > b2 THEN 'test' ELSE 'embargo' END AS split
        FROM numbered, edges
    ),
    entities AS (
        SELECT entity, coalesce(sum(c) OVER (ORDER BY md5('{SEED}:' || entity::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS n
        FROM (SELECT entity, count(*) AS c FROM cohort GROUP BY entity)
    ),
    disjoint_ AS (
        SELECT call_id, CASE WHEN before < 0.7::DOUBLE * n THEN 'train' WHEN before < (0.7::DOUBLE + 0.1::DOUBLE) * n THEN 'val' ELSE 'test' END AS split
        FROM cohort JOIN entities USING (entity)
    ),
    combined AS (
        SELECT t.call_id, CASE WHEN t.split = d.split AND t.split IN ('train', 'val', 'test') THEN t.split ELSE 'excluded' END AS split
        FROM temporal t LEFT JOIN disjoint_ d USING (call_id)
    )"""


@query(f"WITH {sql_splits()} SELECT call_id, ticker, as_of, longest FROM cohort")
def cohort_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("call_id", "ticker", "as_of", "longest")


@query(f"WITH {sql_splits()} SELECT call_id, split FROM temporal")
def split_temporal_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal(spark, sf_dir)


@query(f"WITH {sql_splits()} SELECT call_id, split FROM disjoint_")
def split_ticker_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disjoint(spark, sf_dir)


@query(f"WITH {sql_splits()} SELECT call_id, split FROM combined")
def split_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cohort(spark, sf_dir)
    return splits.combined_split(temporal(spark, sf_dir, calls), disjoint(spark, sf_dir, calls))


@query(f"""WITH {sql_splits()} SELECT 'temporal' AS scheme, split, count(*) AS n_calls FROM temporal GROUP BY split
    UNION ALL SELECT 'disjoint', split, count(*) FROM disjoint_ GROUP BY split UNION ALL SELECT 'combined', split, count(*) FROM combined GROUP BY split""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cohort(spark, sf_dir)
    t, d = temporal(spark, sf_dir, calls), disjoint(spark, sf_dir, calls)
    schemes = {"temporal": t, "disjoint": d, "combined": splits.combined_split(t, d)}
    out = None
    for name, found in schemes.items():
        part = splits.split_counts(found).select(F.lit(name).alias("scheme"), "split", "n_calls")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 0::BIGINT AS entities_on_two_sides, 0::BIGINT AS calls_without_split, 0::BIGINT AS segments_too_close")
def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cohort(spark, sf_dir)
    return splits.leakage(calls, temporal(spark, sf_dir, calls), disjoint(spark, sf_dir, calls), "entity", base.sessions(spark, sf_dir))


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = base.table(spark, sf_dir, "orders").select(F.concat(F.lit("s."), F.col("o_custkey") % 120).alias("ticker"))
    second = base.table(spark, sf_dir, "events").select(F.concat(F.lit("s."), F.col("user_id") % 150 + 20).alias("ticker"))
    return coverage.build_universe(first, second)


def _supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.bars(spark, sf_dir, "concat('s.', l_suppkey)")


_UNIVERSE = """universe AS (
    SELECT ticker, a.c IS NOT NULL AS in_primary, coalesce(a.c, 0) AS primary_calls, b.c IS NOT NULL AS in_secondary, coalesce(b.c, 0) AS secondary_calls
    FROM (SELECT 's.' || (o_custkey % 120) AS ticker, count(*) AS c FROM orders GROUP BY 1) a
    FULL JOIN (SELECT 's.' || (user_id % 150 + 20) AS ticker, count(*) AS c FROM events GROUP BY 1) b USING (ticker)
)"""
_COVERAGE = f"""{base.sql_sessions()}, {base.sql_bars("'s.' || l_suppkey")}, {_UNIVERSE},
    spans AS (
        SELECT ticker, n_rows, first_date, last_date, (SELECT count(*) FROM sessions WHERE session_date BETWEEN first_date AND last_date) AS expected_sessions
        FROM (SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker)
    ),
    coverage AS (
        SELECT u.*, replace(replace(upper(ticker), '.', '-'), '/', '-') AS symbol, CASE WHEN n_rows IS NULL THEN 'missing' ELSE 'ok' END AS status,
            CASE WHEN n_rows IS NULL THEN 'no_data' WHEN round_even(n_rows / expected_sessions, 4) < 0.95::DOUBLE THEN 'gappy' ELSE '' END AS reason, coalesce(n_rows, 0) AS n_rows,
            first_date, last_date, coalesce(expected_sessions, 0) AS expected_sessions, coalesce(round_even(n_rows / expected_sessions, 4), 0) AS completeness
        FROM universe u LEFT JOIN spans USING (ticker)
    )"""


@query(f"WITH {_UNIVERSE} SELECT * FROM universe")
def universe_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir)


@query(f"WITH {_COVERAGE} SELECT * FROM coverage")
def price_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.price_coverage(_universe(spark, sf_dir), _supplier_bars(spark, sf_dir), base.sessions(spark, sf_dir))


@query(f"""WITH {_COVERAGE} SELECT count(*) AS universe_total, count_if(status = 'ok')::BIGINT AS covered_total, round_even(100.0::DOUBLE * count_if(status = 'ok') / count(*), 2) AS coverage_pct,
    count_if(in_primary)::BIGINT AS primary_total, count_if(in_primary AND status = 'ok')::BIGINT AS primary_covered, round_even(100.0::DOUBLE * count_if(in_primary AND status = 'ok') / count_if(in_primary), 2) AS primary_pct,
    count_if(in_secondary)::BIGINT AS secondary_total, count_if(in_secondary AND status = 'ok')::BIGINT AS secondary_covered, round_even(100.0::DOUBLE * count_if(in_secondary AND status = 'ok') / count_if(in_secondary), 2) AS secondary_pct,
    coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE reason = 'no_data'), '') AS no_data_tickers, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE reason = 'gappy'), '') AS gappy_tickers FROM coverage""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_summary(coverage.price_coverage(_universe(spark, sf_dir), _supplier_bars(spark, sf_dir), base.sessions(spark, sf_dir)))


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """List prices and discounted prices; one series has no second source."""
    items = base.table(spark, sf_dir, "lineitem")
    key, day = F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate").cast("date")
    from voltrace.operators.returns import price_bars

    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    first = price_bars(items, key, day, F.col("l_extendedprice"), F.col("l_quantity"))
    return first, price_bars(items.where("concat(l_returnflag, l_linestatus) != 'RO'"), key, day, net, F.col("l_quantity"))


_CHECKED = """a AS (SELECT l_returnflag || l_linestatus AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_returnflag || l_linestatus AS ticker, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS close FROM lineitem WHERE l_returnflag || l_linestatus <> 'RO' GROUP BY 1, 2),
    ra AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM a),
    rb AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM b),
    pairs AS (SELECT ticker, corr(ra.r, rb.r) AS correlation, count(*) AS n_overlap FROM ra JOIN rb USING (ticker, date) WHERE ra.r IS NOT NULL AND rb.r IS NOT NULL GROUP BY ticker),
    checked AS (
        SELECT ticker, correlation, coalesce(n_overlap, 0) AS n_overlap, CASE WHEN ticker NOT IN (SELECT ticker FROM b) THEN 'second_missing' WHEN correlation IS NULL THEN 'no_overlap'
            WHEN correlation > 0.999 THEN 'pass' WHEN correlation >= 0.99 THEN 'warn' ELSE 'investigate' END AS status
        FROM (SELECT DISTINCT ticker FROM a) LEFT JOIN pairs USING (ticker)
    )"""


@query(f"WITH {_CHECKED} SELECT ticker, round(correlation, 6) AS correlation, n_overlap, status FROM checked")
def return_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.cross_check(*_two_sources(spark, sf_dir)).withColumn("correlation", F.round("correlation", 6))


@query(f"""WITH {_CHECKED}, documented AS (SELECT * FROM (VALUES ('AF', 'low volume'), ('NF', 'few days')) t(ticker, reason))
    SELECT count_if(status IN ('pass', 'warn', 'investigate'))::BIGINT AS scored, count_if(status = 'investigate')::BIGINT AS investigate,
        count_if(status = 'investigate' AND reason IS NULL)::BIGINT AS undocumented,
        count_if(status IN ('pass', 'warn', 'investigate')) > 0 AND count_if(status = 'investigate' AND reason IS NULL) = 0 AS passes
    FROM checked LEFT JOIN documented USING (ticker)""")
def crosscheck_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documented = spark.createDataFrame([("AF", "low volume"), ("NF", "few days")], "ticker string, reason string")
    return coverage.cross_check_gate(coverage.cross_check(*_two_sources(spark, sf_dir)), documented)


@query(f"WITH {_UNIVERSE} SELECT ticker FROM universe ORDER BY md5('0:' || ticker) LIMIT greatest(1, (SELECT round_even(count(*) * 0.05::DOUBLE, 0)::BIGINT FROM universe))")
def sampled_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.sample_tickers(_universe(spark, sf_dir), 0.05, 0)
