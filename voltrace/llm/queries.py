"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .idfile import read_id_files, write_id_files
from .licenses import PHRASES, TEMPLATES, scan_licenses
from .mixing import mix_sources
from .packing import pack_documents
from .quality import apply_quality_rules
from .sharding import assign_shards, fill_table
from .simhash import near_duplicates
from .substrings import remove_repeats
from .topk import top_k_inner_products
from .urlfilter import filter_urls, rule_table


URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, URL_RULES)).drop("url")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=2048, end_id=1)


SHARDS = [f"shard-{i:02d}" for i in range(24)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    return assign_shards(docs, SHARDS, key_col="doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, window=35, rewrite_all=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ENTROPY = 0.97


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix_sources(docs, entropy=ENTROPY, seed=5, expand=False, prefix="mix_")
    return mixed.select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_copies").alias("copies")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_id_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), end_id=2)
    return read_id_files(spark, manifest)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k_inner_products(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = apply_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), measures=measures, prefix="q_")
    few, repeated = F.col("q_n_words") < 50, 100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words")
    return judged.select("doc_id", *(F.col(f"q_{m}").alias(m) for m in measures), (few | repeated).alias("base_failed"), F.col("q_kept").alias("kept"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), distance=3)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    starts = F.transform("places", lambda s: s["p"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_top_k": op7_top_k,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_license_scan": op10_license_scan,
}

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_PHRASES = _values([(label, p, len(p.split())) for label, p in PHRASES])
_TEMPLATES = _values([(i, t.label, t.wording, t.key, t.key_at, len(t.words), len(t.key.split())) for i, t in enumerate(TEMPLATES)])


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": f"""
        WITH t AS (SELECT {fill_table(SHARDS)} AS slots, {SHARDS} AS names),
        d AS (
            SELECT doc_id, source, lang, n_chars, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT % 65537 AS slot FROM documents
        )
        SELECT doc_id, source, lang, n_chars, slot::INTEGER AS slot, names[slots[slot + 1] + 1] AS shard FROM d, t
    """,
    "op5_mixing": rf"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS src,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n
            FROM documents
        ),
        s AS (SELECT src, sum(n)::BIGINT AS tokens, sum(n) / (SELECT sum(n)::DOUBLE FROM d) AS share FROM d GROUP BY src HAVING sum(n) > 0),
        b(i, lo, hi) AS (
            SELECT 0, 0::DOUBLE, 4::DOUBLE
            UNION ALL
            SELECT i + 1, if(h > {ENTROPY}::DOUBLE * ln(k), mid, lo), if(h > {ENTROPY}::DOUBLE * ln(k), hi, mid) FROM (
                SELECT i, lo, hi, (lo + hi) / 2 AS mid, count(*) AS k,
                    ln(sum(exp((lo + hi) / 2 * ln(share)))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * ln(share)) * ln(share)) / sum(exp((lo + hi) / 2 * ln(share))) AS h
                FROM b, s WHERE i < 32 GROUP BY i, lo, hi
            )
        ),
        e AS (SELECT hi AS a FROM b WHERE i = 32),
        w AS (SELECT src, tokens, exp(a * ln(share)) / (SELECT sum(exp(a * ln(share))) FROM s, e) AS weight FROM s, e),
        g AS (SELECT src, tokens, weight, round(weight * (SELECT sum(tokens) FROM w))::BIGINT AS budget FROM w),
        p AS (SELECT src, weight, budget // tokens AS passes, budget % tokens AS rest FROM g),
        o AS (
            SELECT r, sum(n) OVER (PARTITION BY d.src ORDER BY md5('5:' || passes || ':' || coalesce(doc_id::VARCHAR, ''))) AS run FROM d JOIN p USING (src)
        )
        SELECT doc_id, source, n AS n_tokens, coalesce(round(weight, 9), 0) AS weight,
            (coalesce(passes, 1) + if(rest > 0 AND run <= rest, 1, 0))::BIGINT AS copies
        FROM d LEFT JOIN p USING (src) LEFT JOIN o USING (r)
    """,
    "op1_url_filter": rf"""
        WITH u AS (
            SELECT row_number() OVER () AS r, page_id,
                translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        best AS (
            SELECT r, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
            FROM u JOIN (VALUES {_RULES}) AS t(h, p, v) ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p)
            GROUP BY r
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
    """,
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        win AS (
            SELECT r, i, count(*) OVER k AS n, sha256(string_agg(word, ' ') OVER k) AS h
            FROM w WINDOW k AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
        ),
        twice AS (SELECT r, i FROM win WHERE n = 35 QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (
            SELECT w.r, w.i FROM w JOIN twice t ON t.r = w.r AND t.i BETWEEN w.i - 34 AND w.i GROUP BY ALL
        ),
        kept AS (
            SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS text, count(*) AS n FROM w ANTI JOIN gone USING (r, i) GROUP BY w.r
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER k::INTEGER AS rank, vec_id, score FROM s
        WINDOW k AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
    """,
    "op8_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        grams AS (
            SELECT r, i, row(words[i], words[i + 1], words[i + 2]) AS gram
            FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM d)
        ),
        twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
        lines AS (
            SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ),
        line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY r),
        m AS (
            SELECT doc_id, len(words) AS n_words,
                coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
                len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS n_upper
            FROM d LEFT JOIN covered c USING (r) LEFT JOIN line_counts USING (r)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > n_words
                OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
        FROM m
    """,
    "op10_license_scan": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ),
        phrases(label, phrase, n) AS (VALUES {_PHRASES}),
        templates(t, label, wording, key, key_at, n, key_n) AS (VALUES {_TEMPLATES}),
        w AS (
            SELECT r, i, word FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d)
            WHERE word IN (SELECT split_part(phrase, ' ', 1) FROM phrases UNION SELECT split_part(key, ' ', 1) FROM templates)
        ),
        base AS (
            SELECT w.r, w.i, p.label FROM w JOIN phrases p ON split_part(p.phrase, ' ', 1) = w.word JOIN d USING (r)
            WHERE array_to_string(d.words[w.i + 1:w.i + p.n], ' ') = p.phrase
        ),
        found AS (
            SELECT w.r, t.label, w.i - t.key_at AS s, t.n, string_split(t.wording, ' ') AS wanted, d.words
            FROM w JOIN templates t ON split_part(t.key, ' ', 1) = w.word JOIN d USING (r)
            WHERE array_to_string(d.words[w.i + 1:w.i + t.key_n], ' ') = t.key
        ),
        shares AS (SELECT r, label, len(list_filter(range(n), lambda j: s + j >= 0 AND words[s + j + 1] = wanted[j + 1])) / n::DOUBLE AS share FROM found),
        b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
        l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) GROUP BY r),
        c AS (SELECT r, max(share) AS score FROM shares GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
        FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)
    """,
}
