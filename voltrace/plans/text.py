"""Queries: turns, sections, chunks, surface statistics and vectors' caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.functions import text

from . import base
from .registry import query

#: The conversations' words have no cues of their own, so these stand in for the operator's.
CUE = "(?i)tion(?:er)? (?:the|th|de)"
ROLES = {"system": "operator", "assistant": "management", "user": "analyst"}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls; the role column tells who speaks."""
    role: Column = F.lit("unknown")
    for k, v in ROLES.items():
        role = F.when(F.col("role") == k, v).otherwise(role)
    found = base.table(spark, sf_dir, "conversations")
    return found.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_idx"), role.alias("role"), "text")


def chunks(spark: SparkSession, sf_dir: str, most: int = 40) -> DataFrame:
    labeled = text.label_turns(turns(spark, sf_dir), text.detect_sections(turns(spark, sf_dir), cue=CUE))
    return text.chunk_turns(labeled, most)


_TURNS = """turns AS (
    SELECT conv_id AS call_id, turn AS turn_idx, CASE role WHEN 'system' THEN 'operator' WHEN 'assistant' THEN 'management' WHEN 'user' THEN 'analyst' ELSE 'unknown' END AS role, text
    FROM conversations
)"""
_SECTIONS = f"""{_TURNS}, firsts AS (
        SELECT call_id, count(*) AS n_turns, min(turn_idx) FILTER (WHERE role = 'operator' AND regexp_matches(text, '{CUE}')) AS op,
            min(turn_idx) FILTER (WHERE role = 'analyst') AS an, min(turn_idx) FILTER (WHERE regexp_matches(text, '{CUE}')) AS cue FROM turns GROUP BY call_id
    ),
    sections AS (
        SELECT call_id, n_turns, CASE method WHEN 'operator_cue' THEN op WHEN 'first_analyst' THEN an WHEN 'text_cue' THEN cue ELSE n_turns END AS boundary, method <> 'none' AS has_qa, method,
            an IS NOT NULL AND op IS NOT NULL AS corroborated
        FROM (SELECT *, CASE WHEN an IS NOT NULL AND coalesce(an - op BETWEEN 0 AND 3, false) THEN 'operator_cue' WHEN an IS NOT NULL THEN 'first_analyst' WHEN op IS NOT NULL THEN 'operator_cue'
            WHEN cue IS NOT NULL THEN 'text_cue' ELSE 'none' END AS method FROM firsts)
    )"""
_SENTENCES = r"""list_filter(string_split(regexp_replace(trim(text, E' \t\n\r\x0b\x0c'), '([.!?])\s+(["''(\[A-Z0-9$])', E'\\1\x01\\2', 'g'), E'\x01'), lambda s: s <> '')"""
_COUNT = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_CHUNKS = f"""{_SECTIONS},
    whole AS (
        SELECT t.call_id, t.turn_idx, t.role, trim(t.text, E' \\t\\n\\r\\x0b\\x0c') AS text, CASE WHEN t.turn_idx < s.boundary THEN 'prepared_remarks' ELSE 'qa' END AS section
        FROM turns t JOIN sections s USING (call_id) WHERE trim(t.text, E' \\t\\n\\r\\x0b\\x0c') <> ''
    ),
    sentences AS (
        SELECT call_id, turn_idx, i, s, {_COUNT.format("s")} AS n FROM (
            SELECT call_id, turn_idx, unnest(list) AS s, generate_subscripts(list, 1) AS i FROM (SELECT call_id, turn_idx, {_SENTENCES} AS list FROM whole WHERE {_COUNT.format("text")} > 40))
    ),
    walk(call_id, turn_idx, i, chunk, words, size, closed) AS (
        SELECT call_id, turn_idx, i, 0, n, 1, n > 40 FROM sentences WHERE i = 1
        UNION ALL
        SELECT s.call_id, s.turn_idx, s.i,
            CASE WHEN w.closed OR w.words + s.n > 40 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.closed OR w.words + s.n > 40 THEN s.n ELSE w.words + s.n END,
            CASE WHEN w.closed OR w.words + s.n > 40 THEN 1 ELSE w.size + 1 END, (w.closed OR w.words + s.n > 40) AND s.n > 40
        FROM walk w JOIN sentences s ON s.call_id = w.call_id AND s.turn_idx = w.turn_idx AND s.i = w.i + 1
    ),
    chunks AS (
        SELECT call_id, turn_idx, role, section, chunk AS chunk_in_turn, c.text, {_COUNT.format("c.text")} AS n_words, length(c.text) AS n_chars, {_COUNT.format("c.text")} > 40 AS oversize FROM (
            SELECT call_id, turn_idx, chunk, string_agg(s, ' ' ORDER BY i) AS text FROM walk JOIN sentences USING (call_id, turn_idx, i) GROUP BY ALL
            UNION ALL SELECT call_id, turn_idx, 0, text FROM whole WHERE {_COUNT.format("text")} <= 40
        ) c JOIN (SELECT call_id, turn_idx, role, section FROM whole) USING (call_id, turn_idx)
    )"""


@query(f"WITH {_SECTIONS} SELECT * FROM sections")
def section_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.detect_sections(turns(spark, sf_dir), cue=CUE)


@query(f"WITH {_SECTIONS} SELECT method, has_qa, count(*) AS n_calls, count_if(corroborated)::BIGINT AS corroborated FROM sections GROUP BY ALL")
def section_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.detect_sections(turns(spark, sf_dir), cue=CUE)
    return found.groupBy("method", "has_qa").agg(F.count("*").alias("n_calls"), F.count_if("corroborated").alias("corroborated"))


def _flat(x: str, end: bool = False) -> str:
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"right({flat}, 160)" if end else f"left({flat}, 160)"


@query(f"""WITH {_SECTIONS} SELECT call_id, boundary, max({_flat('text', True)}) FILTER (WHERE turn_idx = boundary - 1) AS previous, max({_flat('text')}) FILTER (WHERE turn_idx = boundary) AS boundary_text,
    max({_flat('text')}) FILTER (WHERE turn_idx = boundary + 1) AS following FROM turns JOIN sections USING (call_id) WHERE has_qa AND turn_idx BETWEEN boundary - 1 AND boundary + 1 GROUP BY ALL""")
def boundary_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.boundary_context(turns(spark, sf_dir), text.detect_sections(turns(spark, sf_dir), cue=CUE), n=160)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT call_id, turn_idx, role, section, chunk_in_turn::INTEGER AS chunk_in_turn, n_words, n_chars, oversize, sha256(text) AS text_hash FROM chunks")
def chunk_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks(spark, sf_dir)
    return found.select("call_id", "turn_idx", "role", "section", "chunk_in_turn", "n_words", "n_chars", "oversize", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query(rf"""WITH RECURSIVE {_CHUNKS}, counted AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '\d'))) AS num, length(text) - length(replace(text, '?', '')) AS q FROM chunks)
    SELECT call_id, CASE WHEN grouping(section) = 1 THEN 'full' ELSE section END AS scope, count(DISTINCT turn_idx) AS n_turns, count(*) AS n_chunks, sum(n_words)::BIGINT AS n_words, sum(n_chars)::BIGINT AS n_chars,
        round(coalesce(sum(num) / nullif(sum(n_words), 0), 0), 6) AS numeric_density, sum(q)::BIGINT AS question_marks, round(sum(n_words) / count(DISTINCT turn_idx), 6) AS words_per_turn
    FROM counted GROUP BY GROUPING SETS ((call_id, section), (call_id))""")
def surface_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.surface_stats(chunks(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("numeric_density", "words_per_turn")})


@query(f"WITH RECURSIVE {_CHUNKS} SELECT call_id, section, sha256(string_agg(text, ' ' ORDER BY turn_idx, chunk_in_turn)) AS text_hash FROM chunks GROUP BY ALL")
def section_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.section_text(chunks(spark, sf_dir))
    return found.select("call_id", "section", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


#: A transcript of one text: turns glued together behind role markers.
def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("role") == "system", "Operator:").when(F.col("role") == "assistant", "Executives: ").when(F.col("turn") % 5 == 0, "").otherwise("Analysts:  ")
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(marker, "text").alias("t"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("l"))
    return joined.select(F.col("conv_id").alias("call_id"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("transcript"))


_PARSED = r"""marked AS (
        SELECT conv_id, regexp_replace(string_agg(CASE WHEN role = 'system' THEN 'Operator:' WHEN role = 'assistant' THEN 'Executives: ' WHEN turn % 5 = 0 THEN '' ELSE 'Analysts:  ' END || text, '' ORDER BY turn),
            '(Executives|Analysts|Operator|Attendees|Shareholders):\s*', E'\x01\\1\x02', 'g') AS t FROM conversations GROUP BY conv_id
    ),
    parts AS (SELECT conv_id, unnest(string_split(t, E'\x01')) AS p, generate_subscripts(string_split(t, E'\x01'), 1) AS i FROM marked),
    parsed AS (
        SELECT conv_id AS call_id, i, CASE WHEN contains(p, E'\x02') THEN CASE split_part(p, E'\x02', 1) WHEN 'Executives' THEN 'management' WHEN 'Analysts' THEN 'analyst' WHEN 'Operator' THEN 'operator' END ELSE 'unknown' END AS role,
            regexp_replace(CASE WHEN contains(p, E'\x02') THEN split_part(p, E'\x02', 2) ELSE p END, '^\s+|\s+$', '', 'g') AS text FROM parts
    )"""


@query(f"WITH {_PARSED} SELECT call_id, (row_number() OVER (PARTITION BY call_id ORDER BY i) - 1)::INTEGER AS turn_idx, role, sha256(text) AS text_hash FROM parsed WHERE text <> ''")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _transcripts(spark, sf_dir).select("call_id", F.posexplode(text.parse_turns(F.col("transcript"))).alias("turn_idx", "t"))
    return found.select("call_id", "turn_idx", "t.role", F.sha2(F.col("t.text").cast("binary"), 256).alias("text_hash"))


@query(f"WITH {_PARSED} SELECT call_id, role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM parsed WHERE text <> '' GROUP BY ALL")
def turns_speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _transcripts(spark, sf_dir).withColumn("t", text.parse_turns(F.col("transcript")))
    return found.select("call_id", F.explode(text.speaker_summary(F.col("t"))).alias("role", "s")).select("call_id", "role", "s.turns", "s.chars")


@query("SELECT sha256('bge' || chr(0) || text) AS hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents GROUP BY 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to encode once each, by their cache key."""
    docs = base.table(spark, sf_dir, "documents").withColumn("hash", text.content_hash("bge", F.col("text")))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


@query("""WITH k AS (SELECT doc_id, sha256('bge' || chr(0) || text) AS hash FROM documents), cached AS (SELECT DISTINCT hash FROM k WHERE doc_id % 2 = 0)
    SELECT hash, min(doc_id) AS first_doc FROM k WHERE hash NOT IN (SELECT hash FROM cached) GROUP BY hash""")
def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache lacks: an anti join on the content hash."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", text.content_hash("bge", F.col("text")).alias("hash"))
    cached = docs.where("doc_id % 2 = 0").select("hash")
    return docs.join(cached, "hash", "left_anti").groupBy("hash").agg(F.min("doc_id").alias("first_doc"))
