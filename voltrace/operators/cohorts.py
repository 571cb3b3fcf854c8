"""Which calls and sections take part: parse gates, first failing reasons, value rules, seeded samples and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the analysis: shortest transcript, order of sections, which rated fields apply to which section, and the
# values that each may take.
MIN_TRANSCRIPT_CHARS = 50
SECTION_ORDER = ("prepared_remarks", "qa")
SECTION_FIELDS = {
    "prepared_remarks": ("guidance_direction", "hedging_intensity", "surprise_mentions"),
    "qa": ("guidance_direction", "hedging_intensity", "qa_evasiveness", "analyst_tone", "surprise_mentions"),
}
GUIDANCE = ("raise", "maintain", "lower", "none")
COUNTED = {"surprise_mentions": 20}
HIGHEST_GRADE = 4
#: Semitones that part lower from higher voices.
PITCH_SPLIT = 31.0


def parse_gate(turns: DataFrame, call: str = "call_id", least: int = MIN_TRANSCRIPT_CHARS) -> DataFrame:
    """(call, n_turns, n_chars, parsed): a transcript counts as parsed if it has turns and, together, ``least`` characters."""
    sums = turns.groupBy(call).agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    return sums.withColumn("parsed", (F.col("n_turns") > 0) & (F.col("n_chars") >= least))


def call_reason(parsed: Column, ticker: Column, call_type: Column, call_date: Column) -> Column:
    """The first reason for which a call isn't used, "" if it is."""
    missing = F.coalesce(F.trim(ticker), F.lit("")) == ""
    reason = F.when(~F.coalesce(parsed, F.lit(False)), "empty_transcript").when(missing, "unresolved_ticker")
    reason = reason.when(F.coalesce(call_type, F.lit("")) != "earnings", "non_earnings")
    return reason.when(F.coalesce(call_date.cast("string"), F.lit("")) == "", "no_date").otherwise("")


def classified_calls(calls: DataFrame) -> DataFrame:
    """calls (parsed, ticker, call_type, call_date) with reason and status (ok or excluded)."""
    out = calls.withColumn("reason", call_reason(F.col("parsed"), F.col("ticker"), F.col("call_type"), F.col("call_date")))
    return out.withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("excluded"))


def field_table(spark: SparkSession, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(section, field, applies) for every section and field."""
    known = fields or SECTION_FIELDS
    every = sorted({f for group in known.values() for f in group})
    return spark.createDataFrame([(s, f, f in known[s]) for s in known for f in every], "section string, field string, applies boolean")


def value_problem(field: Column, value: Column, applies: Column) -> Column:
    """What is wrong with a rating, "" if nothing: blank or NA where the field applies, a value where it doesn't, or one out of range."""
    given = F.coalesce(value, F.lit(""))
    empty = given.isin("", "NA")
    number = F.when(F.regexp_like(given, F.lit("^[0-9]{1,9}$")), given.cast("int"))
    highest = F.lit(HIGHEST_GRADE)
    for name, most in COUNTED.items():
        highest = F.when(field == name, F.lit(most)).otherwise(highest)
    out_of_range = F.when(field == "guidance_direction", ~given.isin(*GUIDANCE)).otherwise(F.coalesce(number > highest, F.lit(True)))
    problem = F.when(applies.isNull(), "unknown section or field").when(~applies & ~empty, "does not apply").when(~applies, "")
    return problem.when(empty, "required").when(out_of_range, "out of range").otherwise("")


def judged_values(ratings: DataFrame, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """ratings (section, field, value and more) with problem."""
    known = field_table(ratings.sparkSession, fields)
    joined = ratings.join(F.broadcast(known), ["section", "field"], "left")  # a row for each section and field
    return joined.withColumn("problem", value_problem(F.col("field"), F.col("value"), F.col("applies"))).drop("applies")


def valid_values(ratings: DataFrame, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """ratings as they are; reading them fails at the first rating with a problem."""
    judged = judged_values(ratings, fields)
    told = F.concat_ws(" ", "section", "field", F.coalesce("value", F.lit("(null)")), "problem")
    whole = F.when(F.col("problem") != "", F.raise_error(told).cast("string")).otherwise(F.col("section"))
    return judged.withColumn("section", whole).drop("problem").select(*ratings.columns)


def in_pool(rows: DataFrame, cohort: DataFrame | None, key: str = "call_id") -> DataFrame:
    """rows of the cohort; all rows if there is no cohort or none of them is in it."""
    if cohort is None:
        return rows
    own = rows.join(cohort.select(key).distinct(), key, "left_semi")
    return rows if own.isEmpty() else own


def seeded_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str = "call_id") -> DataFrame:
    """The n rows (or all) that come first in a seeded order of their keys."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def train_sample(train: DataFrame, with_text: DataFrame, n: int, seed: int, key: str = "call_id") -> DataFrame:
    """n keys that are in train and have text, in a seeded order; fewer than n, or one outside train, is an error."""
    both = train.select(key).intersect(with_text.select(key))
    if (have := both.count()) < n:
        raise ValueError(f"only {have} train calls have text, {n} are asked for")
    picked = seeded_sample(both, n, seed, key)
    if leaked := picked.join(train, key, "left_anti").count():
        raise AssertionError(f"{leaked} sampled calls aren't train calls")
    return picked


def section_inventory(chunks: DataFrame, by: str | None = None, call: str = "call_id") -> DataFrame:
    """(by, n_calls, n_sections, n_chunks): different calls, different (call, section) pairs and rows."""
    sums = (F.countDistinct(call).alias("n_calls"), F.countDistinct(F.struct(call, "section")).alias("n_sections"), F.count("*").alias("n_chunks"))
    return chunks.groupBy(by).agg(*sums) if by else chunks.agg(*sums)


def place_in(value: Column, order: tuple[str, ...]) -> Column:
    """A value's place in a fixed order; values outside it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def numbered_in_order(rows: DataFrame, by: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """rows with place, their number from 1 within ``by`` in the fixed order of ``value``, others last by name."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(place_in(F.col(value), order), value)))


def pitch_groups(rows: DataFrame, split: float = PITCH_SPLIT, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, coverage, sizes and mean squared errors of lower and higher voices, correlations of pitch with squared error
    and with prediction) for rows with y_true, y_pred and f0; correlations need three voices."""
    from voltrace.functions.numeric import pearson

    f0, error = F.col("f0"), F.pow(F.col("y_true") - F.col("y_pred"), 2)
    known = f0.isNotNull() & ~F.isnan(f0) & (F.abs(f0) != float("inf"))
    own, low = F.when(known, f0), known & (f0 < split)
    n = F.count_if(known)
    return rows.groupBy(*by).agg(
        F.avg(known.cast("double")).alias("coverage"),
        F.count_if(low).alias("n_low"),
        F.count_if(known & ~low).alias("n_high"),
        F.avg(F.when(low, error)).alias("mse_low"),
        F.avg(F.when(known & ~low, error)).alias("mse_high"),
        F.when(n > 2, pearson(own, F.when(known, error))).alias("corr_error"),
        F.when(n > 2, pearson(own, F.when(known, F.col("y_pred")))).alias("corr_prediction"),
    )


def encode_once(texts: DataFrame, model: str, encode: Callable[[list[str]], list], cache: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with hash and vector, vectors that weren't in the cache): each different text is encoded once.

    ``cache`` has (hash, vector). ``encode`` maps a list of texts to vectors; it runs in the workers on batches of the
    different texts that the cache lacks.
    """
    from voltrace.functions.text import content_hash
    from voltrace.sources.staging import stage

    hashed = texts.withColumn("hash", content_hash(model, F.col(text)))
    missing = hashed.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.first(text).alias("text"))  # equal hashes, equal texts
    if cache is not None:
        missing = missing.join(cache.select("hash"), "hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": frame["hash"], "vector": [[float(x) for x in v] for v in encode(frame["text"].tolist())] if len(frame) else []})

    new = stage(missing.mapInPandas(run, "hash string, vector array<double>"), "vectors")
    known = new if cache is None else new.unionByName(cache.select("hash", F.col("vector").cast("array<double>").alias("vector")))
    return hashed.join(known, "hash", "left"), new


def rate_sections(sections: DataFrame, engine: Callable[[str, str], dict], schema: str, system: str, prompt: str = "prompt") -> DataFrame:
    """sections with rating, a struct of ``schema``, that the engine gives for (system, prompt); null where it gives none."""
    import json

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        found = [engine(system, p) if p is not None else None for p in prompts]
        return pd.Series([json.dumps(f) if f is not None else None for f in found])

    return sections.withColumn("rating", F.from_json(ask(F.col(prompt)), schema))
