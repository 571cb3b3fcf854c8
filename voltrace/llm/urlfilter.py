"""URL allow and block rules: host-suffix and path-prefix expressions joined on short hash prefixes, then confirmed.

A rule is a host and a path prefix. An URL's expressions are the pairs of a host suffix and a path prefix that a rule
could have: the rules' numbers of host labels and path lengths (their shapes) tell which, so the number of expressions
is bounded by the rules, not by the URL. Expressions meet rules on the first 4 bytes of their SHA-256; what meets is
confirmed on the whole digest, and of an URL's confirmed rules the longest wins. Built of DataFrame functions only.

Where the rules are few enough to broadcast and have few shapes, a shape is one equi-join that gives a page at most one
rule, so pages neither multiply nor move. Else all expressions of a page are rows, joined at once, and only what fitted
is sent back to the pages.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import columns, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables up to this many rows are broadcast (under 200 bytes each); larger ones are joined by a salted shuffle.
BROADCAST_RULES, SALTS = 100_000, 16
#: With more shapes than this the expressions become rows.
JOINED_SHAPES = 24
PREFIX_HEX = 8  # of the digest's 64 hexadecimal digits


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows from a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", prefix: str = "") -> DataFrame:
    """pages with string columns ``{prefix}host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains of it where the URL's path starts with
    the rule's. Of several the one with the longest host and path together wins, then the longer host, then ``block``
    over ``allow``. Without a rule, rule is null and the verdict is ``default``. Null rule hosts or paths count as empty;
    a rule with an empty host fits nothing, repeated rules count once. URLs that are null or have no ``://`` have an
    empty host and path and fit no rule. Repeated rows stay rows, an empty table stays empty. Names that are taken are an
    error; choose a prefix.
    """
    names = [prefix + x for x in ("host", "path", "rule", "verdict")]
    if clash := {c.lower() for c in pages.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; choose a prefix")
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    clean = clean.where("h != ''").groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    clean = clean.select("h", "p", "verdict", _digest(F.col("h"), F.col("p")).alias("digest"))
    # at most 127 numbers of labels times the rules' path lengths
    shapes = sorted((r[0], r[1]) for r in clean.select(_labels(F.col("h")), F.length("p")).distinct().collect())
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parts = pages.withColumns({names[0]: host, names[1]: path})
    small = clean.count() <= BROADCAST_RULES
    judge = _by_shape if small and len(shapes) <= JOINED_SHAPES else _by_rows
    best = free_name(parts, "best")
    judged = judge(parts, clean, shapes, names[0], names[1], best, small)
    verdict = F.coalesce(F.col(f"{best}.verdict"), F.lit(default))
    return judged.select(*columns(parts), F.col(f"{best}.rule").alias(names[2]), verdict.alias(names[3]))


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; no URL's host or path holds the ``?`` between them, so no other pair has the same bytes."""
    return F.sha2(F.concat(host, F.lit("?"), path), 256)


def _rank(of: str) -> Column:
    """What is compared between rules that fit: length, then length of the host, then ``block`` over ``allow``."""
    h, p = F.col(f"{of}.h"), F.col(f"{of}.p")
    return F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("nh"), F.col(f"{of}.verdict").alias("verdict"), F.concat(h, p).alias("rule"))


def _by_shape(parts: DataFrame, rules: DataFrame, shapes: list, host: str, path: str, best: str, small: bool) -> DataFrame:
    """parts with the struct ``best``: one broadcast equi-join for each shape, each giving a page at most one rule."""
    h, p, found, kept = F.col(host), F.col(path), [], columns(parts)
    for k, n in shapes:
        key, rule = free_name(parts, f"digest_{k}_{n}"), free_name(parts, f"rule_{k}_{n}")
        fits = (_labels(h) >= k) & (F.length(p) >= n)
        parts = parts.withColumn(key, F.when(fits, _digest(F.substring_index(h, ".", -k), F.substring(p, 1, n))))
        of_shape = rules.where((_labels(F.col("h")) == k) & (F.length("p") == n))
        of_shape = of_shape.select(F.struct("h", "p", "verdict", "digest").alias(rule), F.substring("digest", 1, PREFIX_HEX).alias(rule + "_short"))
        same = (F.substring(key, 1, PREFIX_HEX) == F.col(rule + "_short")) & (F.col(key) == F.col(f"{rule}.digest"))
        parts = parts.join(F.broadcast(of_shape), same, "left")
        found.append(F.when(F.col(rule).isNotNull(), _rank(rule)))
    highest = reduce(lambda a, b: F.when(b.isNotNull() & (a.isNull() | (b > a)), b).otherwise(a), found) if found else F.lit(None)
    kind = "struct<n:int,nh:int,verdict:string,rule:string>"
    return parts.select(*kept, highest.cast(kind).alias(best))


def _by_rows(parts: DataFrame, rules: DataFrame, shapes: list, host: str, path: str, best: str, small: bool) -> DataFrame:
    """parts with the struct ``best``: every expression of a different host and path is a row, and all meet the rules at once."""
    names = {host: "u_host", path: "u_path"}
    pages = parts.select(*(F.col(a).alias(b) for a, b in names.items())).distinct()
    h, p = F.col("u_host"), F.col("u_path")
    given = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
    fitting = F.filter(given, lambda s: (_labels(h) >= s["k"]) & (F.length(p) >= s["n"]))
    digests = F.transform(fitting, lambda s: _digest(F.call_function("substring_index", h, F.lit("."), -s["k"]), F.substring(p, F.lit(1), s["n"])))
    asked = pages.select(h, p, F.explode(digests).alias("whole")).withColumn("short", F.substring("whole", 1, PREFIX_HEX))
    wanted = rules.select(F.struct("h", "p", "verdict").alias("rule"), "digest", F.substring("digest", 1, PREFIX_HEX).alias("short"))
    if small:
        met = asked.join(F.broadcast(wanted), "short")
    else:  # a hot host's expressions are dealt over the salts
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("u_host", "u_path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    judged = met.where("whole = digest").groupBy("u_host", "u_path").agg(F.max(_rank("rule")).alias("u_best"))
    joined = parts.join(judged, (F.col(host) == h) & (F.col(path) == p), "left")
    return joined.select(*columns(parts), F.col("u_best").alias(best))
