"""Queries: company names, call types, dates, and audio logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.functions import audio, names

from . import base
from .registry import query


def _sql_norm(x: str) -> str:
    """names.normalize_name in SQL, for chains of at most two single letters."""
    folded = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    step = f"lower(regexp_replace(regexp_replace({folded}, '[''’]', '', 'g'), '/[A-Za-z]{{2,3}}/?\\s*$', ' '))"
    step = f"regexp_replace(regexp_replace({step}, '[^a-z0-9 ]', ' ', 'g'), '{names.LEGAL_SUFFIXES}', ' ', 'g')"
    return f"regexp_replace(trim(regexp_replace({step}, '\\s+', ' ', 'g')), '\\b([a-z]) ([a-z])\\b', '\\1\\2', 'g')"


_TITLES = """titles AS (SELECT p_partkey AS id, 'The ' || p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN '''s Holdings, Inc. /DE/' WHEN 1 THEN ' & Co.' WHEN 2 THEN ' U.S. Corp' WHEN 3 THEN ' Café Group plc' ELSE ' Limited' END AS title FROM part)"""


@query(f"WITH {_TITLES} SELECT id, title, {_sql_norm('title')} AS key FROM titles")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, "'s Holdings, Inc. /DE/").when(k == 1, " & Co.").when(k == 2, " U.S. Corp").when(k == 3, " Café Group plc").otherwise(" Limited")
    title = F.concat(F.lit("The "), "p_name", F.lit(" "), "p_type", tail)
    return base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title")).withColumn("key", names.normalize_name(F.col("title")))


@query(f"WITH {_TITLES} SELECT key, min(id) AS id, count(*) AS n_titles FROM (SELECT id, {_sql_norm('title')} AS key FROM titles) GROUP BY key")
def first_wins_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest-ranked title of each key, as in a reference table ordered by rank."""
    found = name_normalize(spark, sf_dir)
    counts = found.groupBy("key").agg(F.count("*").alias("n_titles"))
    return names.first_wins(found, "key", "id").select("key", "id").join(counts, "key")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the benchmark's items as company names."""
    first = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    rows = base.table(spark, sf_dir, "benchmark").select(names.normalize_name(first).alias("key"), F.col("item_id").alias("company"), F.lit(True).alias("single_ok"))
    return names.first_wins(rows.where("key != ''"), "key", "company")


@query(rf"""WITH dict AS (SELECT key, min(item_id) AS company FROM (SELECT item_id, {_sql_norm("regexp_extract(text, '^([A-Za-z]+)', 1)")} AS key FROM benchmark) WHERE key <> '' GROUP BY key),
    runs AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text || chr(10) || text, '{names.CAPITAL_RUN.replace("'", "''")}') AS r FROM documents)),
    tokens AS (SELECT doc_id, k, regexp_split_to_array(run, '[ \t]') AS t FROM runs),
    starts AS (SELECT doc_id, k, t, unnest(generate_series(1, len(t))) AS i FROM tokens WHERE len(t) <= 12),
    spans AS (SELECT doc_id, k, i, j, array_to_string(t[i:i + j - 1], ' ') AS span FROM (SELECT *, unnest(generate_series(1, least(6, len(t) - i + 1))) AS j FROM starts)),
    keyed AS (SELECT doc_id, k, i, j, 0 AS form, {_sql_norm("span")} AS key FROM spans UNION SELECT doc_id, k, i, j, 1, {_sql_norm("regexp_replace(span, '[''’]s\\b', '', 'g')")} FROM spans),
    hits AS (
        SELECT doc_id, k, i, j, key, company FROM keyed JOIN dict USING (key)
        WHERE contains(key, ' ') OR (j = 1 AND length(key) >= 5 AND key NOT IN ({", ".join(f"'{w}'" for w in names.GENERIC_TOKENS)}))
        QUALIFY row_number() OVER (PARTITION BY doc_id, k, i ORDER BY j DESC, form) = 1
    ),
    sums AS (SELECT doc_id, company, count_if(contains(key, ' ')) AS m, count_if(NOT contains(key, ' ')) AS s FROM hits GROUP BY ALL)
    SELECT doc_id, company, (m + CASE WHEN s >= 2 THEN least(s, 3) ELSE 0 END)::BIGINT AS n FROM sums WHERE m + CASE WHEN s >= 2 THEN least(s, 3) ELSE 0 END > 0""")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said_twice = base.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"))
    found = names.phrase_mentions(said_twice, dictionary(spark, sf_dir), call="doc_id")
    return found.select("doc_id", "company", F.col("n").cast("long").alias("n"))


_PHRASES = ("our monthly sales", "the annual meeting of shareholders", "a fireside evening", "Q3 results and earnings", "a merger of equals", "a forum hosted by us", "nothing else")


@query(f"""WITH d AS (SELECT doc_id, replace(left(text, 1500) || ' ' || {list(_PHRASES)}[doc_id % 7 + 1], 'fireside chat at', '') AS blob FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(blob, '{names.SALES}') THEN 'sales' WHEN regexp_matches(blob, '{names.MEETING}') THEN 'meeting'
        WHEN regexp_matches(blob, '(?i)fireside|introduce our next company|analyst at |my name is .{{3,80}}?analyst|(?:healthcare|tech(?:nology)?|growth|industrial) conference') THEN 'conference'
        WHEN regexp_matches(blob, '{names.EARNINGS}') THEN 'earnings' WHEN regexp_matches(blob, '{names.MERGER}') THEN 'ma' WHEN regexp_matches(blob, '{names.CONFERENCE}') THEN 'conference' ELSE 'unknown' END AS call_type
    FROM d""")
def rule_cascade_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 7).cast("int"))
    return base.table(spark, sf_dir, "documents").select("doc_id", names.classify_call("text", page).alias("call_type"))


@query("""WITH o AS (SELECT o_orderkey AS call_id, o_orderdate::DATE AS said, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 120)::INTEGER END AS created FROM orders),
    p AS (SELECT call_id, CASE WHEN year(said) >= 2000 THEN said END AS first_page, CASE WHEN call_id % 11 = 0 THEN NULL ELSE created END AS created FROM o)
    SELECT call_id, coalesce(first_page, created) AS date, CASE WHEN first_page IS NOT NULL THEN 'first_page' WHEN created IS NOT NULL THEN 'created' ELSE '' END AS source,
        CASE WHEN first_page IS NOT NULL THEN CASE WHEN abs(year(first_page) * 372 + month(first_page) * 31 + day(first_page) - year(created) * 372 - month(created) * 31 - day(created)) > 45 THEN 'date_disagreement' ELSE '' END
            WHEN created IS NOT NULL THEN 'date_from_creation_stamp' ELSE 'no_date' END AS flag FROM p""")
def call_date_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out in a text, against creation dates."""
    orders = base.table(spark, sf_dir, "orders")
    page = F.concat(F.lit("Call of "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" at noon"))
    created = F.when((F.col("o_orderkey") % 3 != 0) & (F.col("o_orderkey") % 11 != 0), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 120).cast("int")))
    return orders.select(F.col("o_orderkey").alias("call_id"), names.choose_date(names.long_date(page), created).alias("d")).select("call_id", "d.*")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000 + F.col("event_id") % 40).alias("call_id"),
        F.col("event_type").alias("company"),
        F.when(F.col("event_id") % 9 == 0, "greeting").otherwise("body").alias("kind"),
        F.when(F.col("event_id") % 9 == 0, 6).otherwise(F.col("event_id") % 3).cast("long").alias("points"),
        (F.col("event_id") % 4 == 0).alias("corroborated"),
    )


@query("""WITH e AS (SELECT user_id * 1000 + event_id % 40 AS call_id, event_type AS company, event_id % 9 = 0 AS greeting, CASE WHEN event_id % 9 = 0 THEN 6 ELSE event_id % 3 END AS points, event_id % 4 = 0 AS near FROM events),
    s AS (SELECT call_id, company, sum(points)::BIGINT AS score, coalesce(sum(points) FILTER (WHERE greeting), 0)::BIGINT AS greet, bool_or(near) AS near FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, company) AS r, row_number() OVER (PARTITION BY call_id ORDER BY greet DESC, company) AS g FROM s),
    w AS (
        SELECT call_id, max(company) FILTER (WHERE r = 1) AS c1, max(score) FILTER (WHERE r = 1) AS s1, bool_or(near) FILTER (WHERE r = 1) AS n1, max(company) FILTER (WHERE r = 2) AS c2, coalesce(max(score) FILTER (WHERE r = 2), 0) AS s2,
            max(company) FILTER (WHERE g = 1) AS gc, max(score) FILTER (WHERE g = 1) AS gs, max(greet) FILTER (WHERE g = 1) AS g1, coalesce(max(greet) FILTER (WHERE g = 2), 0) AS g2, sum(greet) AS greeted FROM r GROUP BY call_id
    ),
    f AS (
        SELECT *, CASE WHEN s1 < 2 THEN 'unresolved:weak_evidence' WHEN g1 >= 6 AND g1 - g2 >= 6 AND (gc <> c1 OR s1 - s2 < 2) THEN 'greeting_dominant' WHEN s1 - s2 < 2 THEN 'unresolved:ambiguous'
            WHEN greeted = 0 AND s1 <= 3 AND NOT n1 THEN 'unresolved:body_only_tail' ELSE '' END AS flag FROM w
    )
    SELECT call_id, CASE WHEN flag = 'greeting_dominant' THEN gc WHEN flag NOT LIKE 'unresolved%' THEN c1 END AS company, CASE WHEN flag = 'greeting_dominant' THEN gs ELSE s1 END AS score,
        CASE WHEN flag = 'greeting_dominant' THEN CASE WHEN gc = c1 THEN c2 ELSE c1 END WHEN flag LIKE 'unresolved%' THEN c1 ELSE c2 END AS runner_up,
        CASE WHEN flag = 'greeting_dominant' THEN CASE WHEN gc = c1 THEN s2 ELSE s1 END ELSE s2 END AS runner_up_score, flag FROM f""")
def resolve_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve(_evidence(spark, sf_dir))


@query()
def greeting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies named in greetings, looked up by key, prefix and similarity (no SQL function; tested on fixtures)."""
    titles = name_normalize(spark, sf_dir)
    known = names.first_wins(titles, "key", "id").select("key", F.col("id").alias("company"), F.col("id").alias("rank"))
    hello = F.concat(F.lit("Welcome to the "), F.initcap("p_name"), F.lit(" "), F.initcap("p_type"), F.lit("s Third Quarter 2019 Earnings Call."))
    calls = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("call_id"), hello.alias("text"))
    return names.lookup_names(names.greeting_names(calls), known)


@query(r"""WITH l AS (SELECT event_id, (event_id % 90)::DOUBLE AS seconds, -(event_id % 50) / 100.0::DOUBLE AS peak, event_id % 400 AS hits FROM events),
    q AS (SELECT event_id, seconds, CASE WHEN event_id % 13 = 0 THEN NULL ELSE peak END AS peak, -20.5::DOUBLE AS rms, CASE WHEN event_id % 13 <> 0 AND peak >= -0.1 THEN least(hits / 1000.0::DOUBLE, 1) ELSE 0 END AS clip, CASE WHEN seconds > 0 THEN least(30.5::DOUBLE / seconds, 1) ELSE 0 END AS silence FROM l)
    SELECT event_id, round(peak, 6) + 0.0::DOUBLE AS peak_dbfs, rms AS rms_dbfs, round(clip, 6) AS clip_ratio, round(silence, 6) AS silence_ratio,
        CASE WHEN event_id % 17 = 0 THEN 'decode_error' WHEN clip > 0.001 THEN 'high_clipping' WHEN silence > 0.5 THEN 'mostly_silent' ELSE '' END AS reason,
        (floor(seconds / 30) + CASE WHEN seconds - floor(seconds / 30) * 30 >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_windows FROM q""")
def audio_log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, clipping and silence read from media tool logs made of the events' numbers."""
    e = F.col("event_id")
    peak = F.when(e % 13 == 0, "-inf").otherwise(F.format_string("%.2f", -(e % 50) / 100))
    log = F.concat(
        F.lit("Channel: 1\nPeak level dB: -9.0\nRMS level dB: -30\nOverall\nPeak level dB: "), peak, F.lit("\nRMS level dB: -20.5\nPeak count: "), (e % 400).cast("string"),
        F.lit("\nNumber of samples: 1000\nsilence_duration: 18\nsilence_duration: 12.5\n"),
    )
    rows = base.table(spark, sf_dir, "events").select("event_id", (e % 90).cast("double").alias("seconds"), log.alias("log"))
    found = rows.withColumn("q", audio.parse_log(F.col("log"), F.col("seconds")))
    reason = audio.quality_reason(e % 17 != 0, F.col("q.clip_ratio"), F.col("q.silence_ratio"))
    digits = [(F.round(F.col(f"q.{c}"), 6) + F.lit(0.0)).alias(c) for c in ("peak_dbfs", "rms_dbfs", "clip_ratio", "silence_ratio")]
    return found.select("event_id", *digits, reason.alias("reason"), audio.window_count(F.col("seconds")).alias("n_windows"))
