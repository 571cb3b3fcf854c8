"""Mixing sources to target weights: temperature on token shares, an exponent found by bisection, budgeted permutations.

A source with token share p gets the weight p**a / sum(p**a). The exponent a is bisected until the weights' entropy meets
a target, or until no source is repeated more often than a limit. The weight times the token budget is the source's
budget: that many whole passes over its documents, and of one more pass, in a permutation of its own, the documents up
to what is left. The permutation is the order of a hash; blocks of documents are ranges of it, and the block in which the
budget ends is found level by level, 256 blocks a level, so no step orders a whole source. Built of DataFrame functions
only; what goes to the driver are sums over sources.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import columns, free_name, materialize

#: Bisection halves its bracket STEPS times, four halvings a job. The bracket of exponents is 0 (all sources alike) to
#: HIGHEST, or to as many doublings of that as the target needs, up to LIMIT.
HIGHEST, LIMIT, STEPS = 4.0, 2.0**20, 32
WORDS = r"[^\x20\x09-\x0D]+"
#: A block of at most so many documents is ordered as it is. Source tables up to this many rows are broadcast.
BLOCK_DOCS, BROADCAST_SOURCES = 256, 100_000


def count_tokens(text: Column) -> Column:
    """Words of a text as its token count; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def permutation_key(seed: int, epoch: Column, number: Column) -> Column:
    """A document's place in its source's permutation for one pass: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(number.cast("string"), F.lit(""))).cast("binary"))


@dataclass(frozen=True)
class Mix:
    """What the bisection found: the exponent, sum((p / top)**exponent) with the largest share top, and the token budget."""

    exponent: float
    total: float
    top: float
    budget: float


def _measures(sources: DataFrame, top: float, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent: sum((p / top)**a), entropy of the weights, largest and smallest (p / top)**a / (p / top)."""
    x = F.exp(F.col("a") * F.ln("r"))
    rows = (
        sources.where("tokens > 0")
        .select((F.col("share") / F.lit(top)).alias("r"), F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "a"))
        .groupBy("i", "a")
        .agg(F.sum(x).alias("z"), F.sum(x * F.ln("r")).alias("l"), F.max(x / F.col("r")).alias("hi"), F.min(x / F.col("r")).alias("lo"))
        .select("i", "z", (F.ln("z") - F.col("a") * F.col("l") / F.col("z")).alias("h"), "hi", "lo")
        .collect()  # a row for each exponent asked for
    )
    return [tuple(r)[1:] for r in sorted(rows)]


def _bisect(measure: Callable, low: float, high: float, holds: Callable[[tuple], bool]) -> tuple[float, float]:
    """The exponents, next to each other, between which holds(measures) turns false; four halvings from each job's sums."""
    for _ in range(STEPS // 4):
        points = [low + (high - low) * i / 16 for i in range(17)]
        found = measure(points)
        a, b = 0, 16
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if holds(found[middle]) else (a, middle)
        low, high = points[a], points[b]
    return low, high


def find_mix(
    sources: DataFrame, *, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, cover: bool = False
) -> Mix | None:
    """The mix for a table (source, tokens, share): exponent 1 where no target is given.

    ``entropy`` is the target as a share of the largest possible, ln(number of sources). With ``max_repeats`` the exponent
    is then moved towards 1 until no source's budget is above that many passes; a budget above max_repeats times all
    tokens is lowered to that. The budget is ``budget`` tokens, else all there are; with ``cover`` the smallest that gives
    every source one whole pass. None if no source has tokens.

    Targets out of range are an error, and so is an entropy that no exponent gives: several sources of the largest share
    keep theirs alike however large it is.
    """
    if entropy is not None and not 0 < entropy <= 1:
        raise ValueError("entropy is a share of the largest possible, above 0 and up to 1")
    if max_repeats is not None and not max_repeats >= (1 if cover else 0) or max_repeats == 0:
        raise ValueError("max_repeats must be above 0, with cover 1 or more")
    if budget is not None and not budget > 0:
        raise ValueError("budget must be above 0")
    number, tokens, top = sources.where("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.max(F.col("share").cast("double"))).first()
    if not number:
        return None
    size = float(tokens if budget is None else budget)
    if max_repeats is not None and not cover:
        size = min(size, max_repeats * tokens)

    def measure(points: list[float]) -> list[tuple]:
        return _measures(sources, top, points)

    def too_flat(m: tuple) -> bool:
        return m[1] > entropy * log(number)

    def passes(m: tuple) -> float:
        return m[2] / m[3] if cover else m[2] / m[0] / top * size / tokens

    exponent = 1.0
    if entropy is not None:
        low, high = 0.0, HIGHEST
        while too_flat(measure([high])[0]):
            low, high = high, 2 * high
            if high > LIMIT:
                raise ValueError(f"no exponent brings the entropy down to {entropy} of the largest possible")
        exponent = _bisect(measure, low, high, too_flat)[1]
    elif max_repeats is not None:
        exponent = 0.0
    if max_repeats is not None and exponent != 1 and passes(measure([exponent])[0]) > max_repeats:
        if exponent < 1:
            exponent = _bisect(measure, exponent, 1.0, lambda m: passes(m) > max_repeats)[1]
        else:
            exponent = _bisect(measure, 1.0, exponent, lambda m: passes(m) <= max_repeats)[0]
    total, _, _, low = measure([exponent])[0]
    return Mix(exponent, total, top, tokens * total * top / low if cover else size)


def _join_sources(docs: DataFrame, sources: DataFrame, on: str, small: bool) -> DataFrame:
    return docs.join(F.broadcast(sources) if small else sources, on, "left")


def plan_copies(rows: DataFrame, *, seed: int = 5, **targets) -> tuple[DataFrame, bool]:
    """(table of sources, whether it is small) for rows (source, number, tokens).

    The table has source, tokens, weight, budget, passes (whole ones) and cut: the last permutation key taken of the
    further pass, "" for none. Sources without tokens have weight 0 and one pass.
    """
    sums = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    number, tokens, largest = sums.agg(F.count("*"), F.sum("tokens"), F.max("docs")).first()
    small = (number or 0) <= BROADCAST_SOURCES
    sums = sums.withColumn("share", F.col("tokens") / F.lit(float(tokens or 1)))
    mix = find_mix(sums, **targets)
    if mix is None:
        nothing = sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("passes"), F.lit("").alias("cut"))
        return nothing, small
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(mix.exponent) * F.ln(F.col("share") / F.lit(mix.top))) / F.lit(mix.total)).otherwise(0.0)
    plan = sums.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(mix.budget)).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1))
    plan = plan.withColumn("left", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
    plan = materialize(plan.select("source", "tokens", "weight", "budget", "passes", "left"), "mix")

    keyed = _join_sources(rows, plan.select("source", "passes"), "source", small)
    keyed = materialize(keyed.select("source", permutation_key(seed, F.col("passes"), F.col("number")).alias("key"), "tokens"), "permutation")
    # "at": the block (a prefix of keys) in which the budget ends; "left": what is left for it
    state, depth = plan.select("source", F.lit("").alias("at"), "left"), 0
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while (largest or 0) > BLOCK_DOCS * 256 ** (depth // 2) and depth < 32:
        inside = _join_sources(keyed, state, "source", small).where(F.substring("key", 1, depth) == F.col("at"))
        blocks = inside.groupBy("source", F.substring("key", 1, depth + 2).alias("block")).agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
        run = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        # blocks in order while the budget reaches their start: the last of them holds its end
        ends = run.where(F.col("before") <= F.col("left")).groupBy("source")
        state = materialize(ends.agg(F.max(F.struct("block", (F.col("left") - F.col("before")).alias("left"))).alias("m")).select("source", F.col("m.block").alias("at"), F.col("m.left").alias("left")), "block")
        depth += 2
    inside = _join_sources(keyed, state, "source", small).where(F.substring("key", 1, depth) == F.col("at"))
    order = Window.partitionBy("source").orderBy("key")  # equal keys are taken together or not at all
    taken = inside.withColumn("run", F.sum("tokens").over(order)).withColumn("prior", F.lag("key").over(order))
    fits = taken.where(F.col("run") <= F.col("left")).groupBy("source").agg(F.max("key").alias("cut"))
    cuts = _join_sources(state, fits, "source", False).select("source", F.coalesce("cut", "at").alias("cut"))
    done = _join_sources(plan, cuts, "source", False).withColumn("cut", F.when(F.col("left") > 0, F.coalesce("cut", F.lit(""))).otherwise(""))
    return materialize(done.select("source", "tokens", "weight", "budget", "passes", "cut"), "cuts"), small


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 5,
    expand: bool = True,
    prefix: str = "mix_",
    **targets,
) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights; targets as for ``find_mix``.

    Without ``expand`` one row for each document, with ``{prefix}`` tokens, weight (of its source) and copies (0 or more);
    with it, each document's own columns once for each copy. Null sources count as the source "", and equal ids of one
    source are taken together. Documents of sources without any token are kept once. Null and empty texts have no tokens
    and follow their place in the permutation. An empty table stays empty. Further columns pass through; names with the
    prefix that are taken are an error.
    """
    names = [prefix + x for x in ("tokens", "weight", "copies")]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another prefix")
    source, number = F.coalesce(docs[source_col].cast("string"), F.lit("")), docs[id_col]
    rows = materialize(docs.select(source.alias("source"), number.alias("number"), count_tokens(docs[text_col]).alias("tokens")), "tokens")
    plan, small = plan_copies(rows, seed=seed, **targets)
    held = free_name(docs, "mix_source")
    known = plan.select(F.col("source").alias(held), F.col("weight").alias(names[1]), F.struct("passes", "cut").alias(held + "_plan"))
    joined = _join_sources(docs.withColumn(held, source), known, held, small)
    key = permutation_key(seed, F.col(held + "_plan.passes"), number)
    copies = F.col(held + "_plan.passes") + F.when(key <= F.col(held + "_plan.cut"), 1).otherwise(0)
    if not expand:
        return joined.select(*columns(docs), count_tokens(docs[text_col]).alias(names[0]), names[1], copies.cast("long").alias(names[2]))
    copied = joined.withColumn(names[2], copies.cast("int")).where(F.col(names[2]) > 0)
    return copied.withColumn(held, F.explode(F.sequence(F.lit(1), F.col(names[2])))).select(*columns(docs))
