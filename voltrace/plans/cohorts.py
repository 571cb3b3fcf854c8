"""Queries: parse gates, reasons, value rules, samples, inventories, prompts, encoders, raters and the whole text matrix."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.functions import prompts, text
from voltrace.operators import assembly, cohorts, metrics, reports
from voltrace.operators import returns as return_ops
from voltrace.sources import archives
from voltrace.sources.staging import stage

from . import base, evaluation, splits
from . import text as text_plans
from .registry import query

_GATE = "gate AS (SELECT conv_id AS call_id, count(*) AS n_turns, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(*) > 0 AND coalesce(sum(length(text)), 0) >= 50 AS parsed FROM conversations GROUP BY conv_id)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), "text")


@query(f"WITH {_GATE} SELECT * FROM gate")
def transcript_parse_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.parse_gate(_turns(spark, sf_dir))


_TICKERS, _TYPES = ("AF", "", "NF", "RF"), ("earnings", "earnings", "conference")


@query(f"""WITH {_GATE}, c AS (
        SELECT o_orderkey AS call_id, coalesce(parsed, false) AS parsed, {list(_TICKERS)}[o_custkey % 4 + 1] AS ticker, {list(_TYPES)}[o_orderkey % 3 + 1] AS call_type,
            CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS call_date FROM orders LEFT JOIN gate ON call_id = o_orderkey % 400)
    SELECT *, CASE WHEN reason = '' THEN 'ok' ELSE 'excluded' END AS status FROM (SELECT *, CASE WHEN NOT parsed THEN 'empty_transcript' WHEN ticker = '' THEN 'unresolved_ticker'
        WHEN call_type <> 'earnings' THEN 'non_earnings' WHEN call_date IS NULL THEN 'no_date' ELSE '' END AS reason FROM c)""")
def call_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the first reason that keeps them out; some transcripts and dates are missing."""
    orders = base.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        (F.col("o_orderkey") % 400).alias("conv"),
        F.get(F.array(*map(F.lit, _TICKERS)), (F.col("o_custkey") % 4).cast("int")).alias("ticker"),
        F.get(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 3).cast("int")).alias("call_type"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("date")).alias("call_date"),
    )
    gate = cohorts.parse_gate(_turns(spark, sf_dir)).select(F.col("call_id").alias("conv"), "parsed")
    calls = orders.join(gate, "conv", "left").drop("conv").withColumn("parsed", F.coalesce("parsed", F.lit(False)))
    return cohorts.classified_calls(calls).select("call_id", "parsed", "ticker", "call_type", "call_date", "reason", "status")


_FIELDS = ", ".join(f"('{s}', '{f}', {f in fields})" for s, fields in cohorts.SECTION_FIELDS.items() for f in cohorts.SECTION_FIELDS["qa"])


@query(f"""WITH RECURSIVE {text_plans._CHUNKS}, fields(section, field, applies) AS (VALUES {_FIELDS})
    SELECT DISTINCT call_id, section, field, applies FROM chunks JOIN fields USING (section)""")
def field_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rated fields apply to each section that a call has."""
    sections = text_plans.chunks(spark, sf_dir).select("call_id", "section").distinct()
    return sections.join(F.broadcast(cohorts.field_table(spark)), "section").select("call_id", "section", "field", "applies")


_VALUES = ("raise", "NA", "", "3", "5", "25", "none", "0", "lower", "x")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating of every field for every document, right or wrong by its number."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "qa").otherwise("prepared_remarks").alias("section"))
    rows = docs.withColumn("field", F.explode(F.array(*map(F.lit, cohorts.SECTION_FIELDS["qa"]))))
    at = F.pmod(F.col("doc_id") + F.length("field"), F.lit(len(_VALUES))).cast("int")
    return rows.withColumn("value", F.get(F.array(*map(F.lit, _VALUES)), at))


_RATINGS = f"""fields(section, field, applies) AS (VALUES {_FIELDS}), ratings AS (
    SELECT doc_id, section, field, applies, {list(_VALUES)}[(doc_id + length(field)) % {len(_VALUES)} + 1] AS value
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'qa' ELSE 'prepared_remarks' END AS section FROM documents) JOIN fields USING (section)),
    judged AS (SELECT doc_id, section, field, value, CASE WHEN NOT applies AND value NOT IN ('', 'NA') THEN 'does not apply' WHEN NOT applies THEN '' WHEN value IN ('', 'NA') THEN 'required'
        WHEN field = 'guidance_direction' THEN CASE WHEN value IN ('raise', 'maintain', 'lower', 'none') THEN '' ELSE 'out of range' END
        WHEN coalesce(try_cast(value AS INTEGER) BETWEEN 0 AND CASE WHEN field = 'surprise_mentions' THEN 20 ELSE 4 END, false) THEN '' ELSE 'out of range' END AS problem FROM ratings)"""


@query(f"WITH {_RATINGS} SELECT doc_id, section, field, value, problem FROM judged")
def rating_value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.judged_values(_ratings(spark, sf_dir)).select("doc_id", "section", "field", "value", "problem")


@query(f"WITH {_RATINGS} SELECT doc_id, section, field, value FROM judged WHERE problem = ''")
def validated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings without a problem, through the reader that fails at one."""
    good = cohorts.judged_values(_ratings(spark, sf_dir)).where("problem = ''").select("doc_id", "section", "field", "value")
    return cohorts.valid_values(good)


@query(f"""WITH {splits.sql_splits()}, rated AS (SELECT conv_id AS call_id, count(*) AS n_turns FROM conversations GROUP BY conv_id), own AS (SELECT * FROM rated WHERE call_id IN (SELECT call_id FROM cohort))
    SELECT * FROM own UNION ALL SELECT * FROM rated WHERE NOT EXISTS (SELECT 1 FROM own)""")
def audit_pool_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the cohort, all of them if none is in it."""
    rated = base.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("call_id")).agg(F.count("*").alias("n_turns"))
    return cohorts.in_pool(rated, splits.cohort(spark, sf_dir).select("call_id"))


@query("SELECT conv_id AS call_id, n_turns FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) ORDER BY md5('9:' || conv_id), conv_id LIMIT 20")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty calls in a seeded order: a sampling operator."""
    calls = base.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("call_id")).agg(F.count("*").alias("n_turns"))
    return cohorts.seeded_sample(calls, 20, seed=9)


@query(f"""WITH {splits.sql_splits()}, picked AS (SELECT call_id FROM temporal WHERE split = 'train' INTERSECT SELECT l_orderkey FROM lineitem)
    SELECT call_id FROM picked ORDER BY md5('4:' || call_id), call_id LIMIT 30""")
def train_only_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty calls that are in train and have rows of their own: a sampling operator that fails if one leaks."""
    train = splits.temporal(spark, sf_dir).where("split = 'train'").select("call_id")
    have = base.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"))
    return cohorts.train_sample(train, have, 30, seed=4)


@query(f"""WITH {splits.sql_splits()} SELECT call_id FROM temporal WHERE split = 'train' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def train_calls_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train calls that have rows of a kind: an intersection."""
    train = splits.temporal(spark, sf_dir).where("split = 'train'").select("call_id")
    return train.intersect(base.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("call_id")))


@query(f"WITH RECURSIVE {text_plans._CHUNKS} SELECT role, count(DISTINCT call_id) AS n_calls, count(DISTINCT (call_id, section)) AS n_sections, count(*) AS n_chunks FROM chunks GROUP BY role")
def section_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.section_inventory(text_plans.chunks(spark, sf_dir), "role")


@query(f"""WITH RECURSIVE {text_plans._CHUNKS}, s AS (SELECT call_id, section, count(*) AS n_chunks FROM chunks GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY CASE section WHEN 'prepared_remarks' THEN 1 WHEN 'qa' THEN 2 ELSE 3 END, section)::INTEGER AS place FROM s""")
def sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections numbered by a fixed order and not by name."""
    rows = text_plans.chunks(spark, sf_dir).groupBy("call_id", "section").agg(F.count("*").alias("n_chunks"))
    return cohorts.numbered_in_order(rows, "call_id", "section", cohorts.SECTION_ORDER)


@query(f"""WITH {evaluation._SQL}, f AS (SELECT *, (y_true - y_pred) ** 2 AS e, CASE WHEN call_id % 5 <> 0 THEN 20 + (call_id % 23)::DOUBLE END AS f0 FROM preds WHERE segment = 'test')
    SELECT target, horizon, model, {base.sql_r6("coverage")}, n_low, n_high, {base.sql_r6("mse_low", "mse_high", "corr_error", "corr_prediction")} FROM (
        SELECT target, horizon, model, count(f0) / count(*) AS coverage, count_if(f0 < 31)::BIGINT AS n_low, count_if(f0 >= 31)::BIGINT AS n_high, avg(e) FILTER (WHERE f0 < 31) AS mse_low, avg(e) FILTER (WHERE f0 >= 31) AS mse_high,
            CASE WHEN count(f0) > 2 THEN covar_pop(f0, e) / nullif(stddev_pop(f0) FILTER (WHERE e IS NOT NULL) * stddev_pop(e) FILTER (WHERE f0 IS NOT NULL), 0) END AS corr_error,
            CASE WHEN count(f0) > 2 THEN covar_pop(f0, y_pred) / nullif(stddev_pop(f0) FILTER (WHERE y_pred IS NOT NULL) * stddev_pop(y_pred) FILTER (WHERE f0 IS NOT NULL), 0) END AS corr_prediction FROM f GROUP BY ALL)""")
def pitch_group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every model's test forecasts by a voice's pitch, a stand-in by the call's number."""
    rows = evaluation.predictions(spark, sf_dir).where("segment = 'test'").withColumn("f0", F.when(F.col("call_id") % 5 != 0, 20 + (F.col("call_id") % 23).cast("double")))
    found = cohorts.pitch_groups(rows, by=("target", "horizon", "model"))
    return found.select("target", "horizon", "model", *base.r6("coverage"), "n_low", "n_high", *base.r6("mse_low", "mse_high", "corr_error", "corr_prediction"))


_FILE = "['text.txt', 'features.csv', 'audio.mp3'][event_id % 3 + 1]"


@query(f"""WITH f AS (SELECT 'raw/' || user_id AS folder, {_FILE} AS file FROM events), d AS (SELECT folder, bool_or(file = 'text.txt') AS t, bool_or(file = 'features.csv') AS c FROM f GROUP BY folder)
    SELECT count(*) AS n_folders, count_if(t)::BIGINT AS with_text, count_if(c)::BIGINT AS with_features FROM d""")
def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a listing and how many of them hold each file."""
    return archives.folder_counts(_listing(spark, sf_dir))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(F.lit("text.txt"), F.lit("features.csv"), F.lit("audio.mp3")), (F.col("event_id") % 3).cast("int"))
    return base.table(spark, sf_dir, "events").select(F.concat(F.lit("raw/"), F.col("user_id").cast("string"), F.lit("/"), name).alias("path"))


@query(f"SELECT regexp_extract({_FILE}, '([^.]*)$', 1) AS kind, count(*) AS n_files FROM events GROUP BY ALL")
def file_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.kind_counts(_listing(spark, sf_dir), F.regexp_extract("path", r"([^.]*)$", 1))


@query("""SELECT o_orderkey AS call_id, replace(replace('org/' || o_orderpriority || ':v1', '/', '__'), ':', '_') AS slug, 'raw/calls/mp3_' || year(o_orderdate) || '/' || o_custkey || '.mp3' AS recording,
    strftime(o_orderdate::DATE, '%Y%m%d') || '_' || o_orderstatus AS folder FROM orders""")
def path_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return base.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        prompts.model_slug(F.concat(F.lit("org/"), "o_orderpriority", F.lit(":v1"))).alias("slug"),
        prompts.recording_path("calls", F.year(day), F.col("o_custkey")).alias("recording"),
        prompts.call_folder(day, F.col("o_orderstatus")).alias("folder"),
    )


_ANCHORS = {s: {f: f"rate {f.replace('_', ' ')}" for f in fields} for s, fields in cohorts.SECTION_FIELDS.items()}
_PROMPT = "'Section: ' || section || chr(10) || CASE section " + " ".join(
    "WHEN '{}' THEN '{}'".format(s, "' || chr(10) || '".join(f"- {f}: {said}" for f, said in fields.items())) for s, fields in _ANCHORS.items()
) + " ELSE '' END || chr(10) || chr(10) || 'Text:' || chr(10) || text"
_SECTION_TEXT = f"{text_plans._CHUNKS}, st AS (SELECT call_id, section, string_agg(text, ' ' ORDER BY turn_idx, chunk_in_turn) AS text FROM chunks GROUP BY ALL)"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = text.section_text(text_plans.chunks(spark, sf_dir))
    return sections.withColumn("prompt", prompts.section_prompt(F.col("section"), F.col("text"), _ANCHORS))


@query(f"WITH RECURSIVE {_SECTION_TEXT} SELECT call_id, section, sha256({_PROMPT}) AS prompt_hash FROM st")
def section_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question asked about each section, whole."""
    return _prompts(spark, sf_dir).select("call_id", "section", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"))


def _rate(system: str, prompt: str) -> dict:
    """A rater by rule: how long the question is and how many question marks it has."""
    return {"length": len(prompt), "questions": min(prompt.count("?"), 20), "by": system}


@query(f"WITH RECURSIVE {_SECTION_TEXT}, p AS (SELECT call_id, section, {_PROMPT} AS prompt FROM st) SELECT call_id, section, length(prompt) AS length, least(20, length(prompt) - length(replace(prompt, '?', ''))) AS questions, 'rule' AS by FROM p")
def rated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by an engine that is passed in."""
    found = cohorts.rate_sections(_prompts(spark, sf_dir), _rate, "length long, questions long, by string", "rule")
    return found.select("call_id", "section", "rating.*")


def _encode(texts: list[str]) -> list[list[float]]:
    """An encoder by rule: the length and two digits of the digest."""
    return [[len(t), int(hashlib.md5(t.encode()).hexdigest()[0], 16), int(hashlib.md5(t.encode()).hexdigest()[1], 16)] for t in texts]


@query("""SELECT doc_id, sha256('rule' || chr(0) || text) AS hash, length(text)::DOUBLE AS e0, ('0x' || md5(text)[1:1])::INTEGER::DOUBLE AS e1, ('0x' || md5(text)[2:2])::INTEGER::DOUBLE AS e2 FROM documents""")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts by an encoder that is passed in; each different text is encoded once, half of them by an earlier run."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    _, earlier = cohorts.encode_once(docs.where(F.length("text") % 2 == 0), "rule", _encode)
    found, _ = cohorts.encode_once(docs, "rule", _encode, earlier)
    return found.select("doc_id", "hash", *(F.get("vector", F.lit(i)).alias(f"e{i}") for i in range(3)))


_VIEWS = {"metric": ("r2_oos", "mse"), "target": ("v", "dv", "har_resid"), "split": ("temporal", "disjoint", "combined")}


@query(f"""SELECT (m.i * 9 + t.i * 3 + s.i)::INTEGER AS view, metric, target, split FROM (SELECT unnest({list(_VIEWS['metric'])}) AS metric, unnest([0, 1]) AS i) m, (SELECT unnest({list(_VIEWS['target'])}) AS target, unnest([0, 1, 2]) AS i) t, (SELECT unnest({list(_VIEWS['split'])}) AS split, unnest([0, 1, 2]) AS i) s""")
def report_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of a report as data."""
    return reports.view_specs(spark, **_VIEWS)


@query(f"""WITH p AS (SELECT ticker, date, close * 0.7310585786::DOUBLE AS close FROM (WITH {base.sql_bars(base.MIXED_SERIES.replace('concat(l_returnflag, l_linestatus)', 'l_returnflag || l_linestatus'))} SELECT * FROM bars))
    SELECT ticker, date, round(close, 6) AS open, round(close * 1.1::DOUBLE, 6) AS high, round(close, 6) AS low, round(close, 6) AS close, CASE WHEN day(date) % 2 = 0 THEN 0 ELSE 1000 + day(date) END::BIGINT AS volume FROM p WHERE day(date) <> 13""")
def price_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price files as their source sends them, one text a ticker: adjusted columns, fallbacks, and lines without a close."""
    rows = base.bars(spark, sf_dir, base.MIXED_SERIES).withColumn("close", F.col("close") * 0.7310585786)
    day, close = F.dayofmonth("date"), F.col("close").cast("string")
    plain, adjusted = F.when(day % 3 == 0, close).otherwise("7"), F.when(day % 3 != 0, close).otherwise("")
    line = F.concat_ws(
        ",", F.concat(F.col("date").cast("string"), F.lit("T00:00:00")), F.when(day == 13, "").otherwise(plain), F.when(day == 13, "").otherwise(adjusted),
        F.when(day == 13, "").otherwise((F.col("close") * 1.1).cast("string")), F.when(day % 2 == 0, "").otherwise((1000 + day).cast("string")),
    )
    files = rows.groupBy("ticker").agg(F.concat_ws("\n", F.lit("date,close,adjClose,adjHigh,volume"), F.sort_array(F.collect_list(line))).alias("text"))
    found = archives.price_rows(files)
    return found.select("ticker", "date", *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume")


_OWN = f"""{base.sql_bars()}, r AS (SELECT ticker, date, ret FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL)"""
_N_DAY = " UNION ALL ".join(
    f"SELECT ticker, date, {n} AS days, CASE WHEN count(ret) OVER w = {n} AND stddev_pop(ret) OVER w > 0 THEN ln(stddev_pop(ret) OVER w) END AS log_std, CASE WHEN count(ret) OVER w = {n} AND stddev_pop(ret) OVER w > 0 THEN ln(abs(last(ret) OVER w) + 1e-10) END AS log_last FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    for n in (3, 7, 15, 30)
)


@query(f"WITH {_OWN}, f AS ({_N_DAY}) SELECT ticker, date, days, {base.sql_r6('log_std', 'log_last')} FROM f")
def n_day_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = return_ops.n_day_volatility(return_ops.own_date_returns(base.bars(spark, sf_dir)))
    return found.select("ticker", "date", "days", *base.r6("log_std", "log_last"))


_SCHEMES = {"temporal": "temporal", "disjoint": "disjoint_", "combined": "combined"}


def _scheme_sql(cte: str, last: str) -> str:
    changed = evaluation._SQL.replace("JOIN temporal s USING (call_id)", f"LEFT JOIN {cte} s USING (call_id)").replace("s.split AS segment", "coalesce(s.split, 'excluded') AS segment")
    return f"(WITH {changed} {last})"


_GRID_SQL = """SELECT '{scheme}' AS split, segment, target, horizon, model, count_if(y_true IS NOT NULL AND y_pred IS NOT NULL)::BIGINT AS n, round(avg((y_true - y_pred) ** 2), 6) + 0.0::DOUBLE AS mse, round(avg(abs(y_true - y_pred)), 6) + 0.0::DOUBLE AS mae,
    round(1 - sum((y_true - y_pred) ** 2) FILTER (WHERE y_pred IS NOT NULL AND baseline IS NOT NULL) / nullif(sum((y_true - baseline) ** 2) FILTER (WHERE y_pred IS NOT NULL), 0), 6) + 0.0::DOUBLE AS r2_oos FROM preds GROUP BY ALL"""


@query(" UNION ALL ".join("SELECT * FROM " + _scheme_sql(cte, _GRID_SQL.format(scheme=s)) for s, cte in _SCHEMES.items()))
def scheme_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric cells of every split scheme, segment, target, horizon and model; calls outside a scheme are excluded."""
    rows = evaluation.scheme_predictions(spark, sf_dir)
    t, p, b = F.col("y_true"), F.col("y_pred"), F.col("baseline")
    cells = rows.groupBy("split", *evaluation.CELL).agg(F.count_if(t.isNotNull() & p.isNotNull()).alias("n"), metrics.mse(t, p).alias("mse"), metrics.mae(t, p).alias("mae"), metrics.r2_oos(t, p, b).alias("r2_oos"))
    return cells.select("split", *evaluation.CELL, "n", *base.r6("mse", "mae", "r2_oos"))


@query("SELECT 'supplied' AS dataset, split, target, horizon, model, segment, n, mse, mae, r2_oos, NULL::DOUBLE AS spearman_q, NULL::DOUBLE AS seed_std, NULL::DOUBLE AS dm_p_vs_persistence, NULL::DOUBLE AS dm_p_vs_har, NULL::DOUBLE AS dm_p_vs_stage1 FROM ("
       + " UNION ALL ".join("SELECT * FROM " + _scheme_sql(cte, _GRID_SQL.format(scheme=s)) for s, cte in _SCHEMES.items()) + ")")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as rows of the result table."""
    return reports.result_rows(scheme_grid(spark, sf_dir), dataset="supplied")


_SURFACE = ("n_turns", "n_chunks", "n_words", "n_chars", "numeric_density", "question_marks", "words_per_turn")
_SCOPES, _SIDES, _MOODS = ("prepared_remarks", "qa", "full"), ("all", "management", "analyst", "operator"), ("p_positive", "p_negative", "p_neutral", "net")


def _matrix_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a vector of the supplied table and class probabilities by rule."""
    pos, neg = (F.col("n_words") % 7 + 1) / 20, (F.col("n_chars") % 5 + 1) / 20
    rows = text_plans.chunks(spark, sf_dir).withColumns({"p_positive": pos, "p_negative": neg, "p_neutral": 1 - pos - neg, "vec_id": F.col("n_chars") % 100})
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return stage(rows.join(e, "vec_id"), "matrix-chunks")


_MATRIX = rf"""{text_plans._CHUNKS}, c AS (SELECT chunks.*, (n_words % 7 + 1)::DOUBLE / 20 AS pp, (n_chars % 5 + 1)::DOUBLE / 20 AS pn, embedding AS v,
        len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '\d'))) AS num, length(text) - length(replace(text, '?', '')) AS q FROM chunks JOIN embeddings ON vec_id = n_chars % 100),
    e AS (SELECT call_id, section AS scope, i, avg(v[i]::DOUBLE) AS x FROM c, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL),
    long AS (SELECT call_id, 'e_' || scope || '_' || (i - 1) AS name, x FROM e
        UNION ALL SELECT call_id, 'm_' || scope || '_' || role || '_' || m, CASE m WHEN 'p_positive' THEN p WHEN 'p_negative' THEN n WHEN 'p_neutral' THEN 1 - p - n ELSE p - n END FROM (
            SELECT call_id, CASE WHEN grouping(section) = 1 THEN 'full' ELSE section END AS scope, CASE WHEN grouping(named) = 1 THEN 'all' ELSE named END AS role, avg(pp) AS p, avg(pn) AS n
            FROM (SELECT *, CASE WHEN role IN ('management', 'analyst', 'operator') THEN role ELSE 'other' END AS named FROM c) GROUP BY GROUPING SETS ((call_id, section, named), (call_id, section), (call_id, named), (call_id))), (SELECT unnest({list(_MOODS)}) AS m) WHERE role <> 'other'
        UNION ALL SELECT call_id, 's_' || scope || '_' || s, CASE s WHEN 'n_turns' THEN t WHEN 'n_chunks' THEN k WHEN 'n_words' THEN w WHEN 'n_chars' THEN ch WHEN 'numeric_density' THEN coalesce(num / nullif(w, 0), 0) WHEN 'question_marks' THEN q ELSE coalesce(w / nullif(t, 0), 0) END FROM (
            SELECT call_id, CASE WHEN grouping(section) = 1 THEN 'full' ELSE section END AS scope, count(DISTINCT turn_idx) AS t, count(*) AS k, sum(n_words) AS w, sum(n_chars) AS ch, sum(num) AS num, sum(q) AS q FROM c GROUP BY GROUPING SETS ((call_id, section), (call_id))), (SELECT unnest({list(_SURFACE)}) AS s)),
    names AS (SELECT 'e_' || s || '_' || i AS name FROM (SELECT unnest(['prepared_remarks', 'qa']) AS s), (SELECT unnest(generate_series(0, 63)) AS i)
        UNION ALL SELECT 'm_' || s || '_' || r || '_' || m FROM (SELECT unnest({list(_SCOPES)}) AS s), (SELECT unnest({list(_SIDES)}) AS r), (SELECT unnest({list(_MOODS)}) AS m)
        UNION ALL SELECT 's_' || s || '_' || t FROM (SELECT unnest({list(_SCOPES)}) AS s), (SELECT unnest({list(_SURFACE)}) AS t))"""


@query(f"WITH RECURSIVE {_MATRIX} SELECT k.call_id, n.name, round(coalesce(l.x, 0), 6) + 0.0::DOUBLE AS value FROM (SELECT DISTINCT call_id FROM c) k CROSS JOIN names n LEFT JOIN long l ON l.call_id = k.call_id AND l.name = n.name")
def text_design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text matrix of a call: two scopes' mean vectors, three scopes x four roles x four class means, three scopes
    x seven surface numbers; absent cells are 0. The wide row is built first and listed by column name."""
    rows = _matrix_chunks(spark, sf_dir)
    vectors = assembly.pool_vectors(rows, ["call_id", "section"])
    wide = vectors.groupBy("call_id").agg(*(F.coalesce(F.max(F.when(F.col("section") == s, F.col("vector"))), F.array_repeat(F.lit(0.0), 64)).alias(f"e_{s}") for s in ("prepared_remarks", "qa")))
    moods = assembly.probability_cube(rows, "call_id", ["p_positive", "p_negative", "p_neutral"], ["management", "analyst", "operator"])
    moods = assembly.widen(moods, "call_id", ["scope", "role"], list(_MOODS), [(s, r) for s in _SCOPES for r in _SIDES])
    surface = assembly.widen(text.surface_stats(rows), "call_id", ["scope"], list(_SURFACE), [(s,) for s in _SCOPES])
    cells = [F.struct(F.lit(f"e_{s}_{i}").alias("name"), F.get(f"e_{s}", F.lit(i)).alias("value")) for s in ("prepared_remarks", "qa") for i in range(64)]
    cells += [F.struct(F.lit(f"{p}_{c}").alias("name"), F.col(c).alias("value")) for p, part in (("m", moods), ("s", surface)) for c in part.columns if c != "call_id"]
    joined = wide.join(moods, "call_id").join(surface, "call_id")
    return joined.select("call_id", F.explode(F.array(*cells)).alias("c")).select("call_id", "c.name", (F.round("c.value", 6) + F.lit(0.0)).alias("value"))
