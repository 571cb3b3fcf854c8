"""Transcript and text functions: turns, sections, chunks, surface statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The transcripts' role markers.
ROLE_MARKERS = {
    "Executives": "management",
    "Analysts": "analyst",
    "Operator": "operator",
    "Attendees": "attendee",
    "Shareholders": "shareholder",
}
MAX_WORDS = 320
PREPARED, QA = "prepared_remarks", "qa"
CUE_NEAR_ANALYST = 3
# Phrasings that open the questions and answers.
QA_CUES = (
    r"question[- ]and[- ]answer",
    r"q\s*&\s*a\s+(?:session|portion)",
    r"floor\s+is\s+(?:now\s+)?open\s+for\s+question",
    r"open\s+(?:up\s+)?(?:the\s+\w+\s+)?(?:for|to)\s+question",
    r"(?:our|the)\s+first\s+question",
    r"first\s+question\s+(?:comes|is|will)",
    r"(?:like|want)\s+to\s+(?:open|turn|begin).{0,40}question",
    r"to\s+ask\s+a\s+question",
    r"press\s+star",
    r"\bstar\s+(?:one|1)\b",
    r"operator\s+instructions",
    r"we(?:'ll| will)\s+(?:now\s+)?(?:take|begin).{0,20}question",
)
QA_CUE = "(?i)" + "|".join(QA_CUES)
_TURN, _TEXT = "\x01", "\x02"
SENTENCE_END = r"([.!?])\s+([\"'(\[A-Z0-9$])"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def word_list(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    """Words between white space; none for null or blank."""
    return F.size(word_list(x)).cast("long")


def numeric_words(x: Column) -> Column:
    """Words that carry a digit."""
    return F.size(F.filter(word_list(x), lambda w: w.rlike(r"\d"))).cast("long")


def question_marks(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[?]")).cast("long")


def snippet(x: Column, n: int, end: bool = False) -> Column:
    """The first or last n characters with white space collapsed."""
    flat = stripped(F.regexp_replace(x, r"\s+", " "))
    return F.right(flat, F.lit(n)) if end else F.left(flat, F.lit(n))


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> of a transcript with role markers.

    What stands before the first marker has the role unknown; markers may be glued to the word before; empty turns are
    left out. A null or blank text has no turns.
    """
    markers = "|".join(ROLE_MARKERS)
    clean = F.translate(F.coalesce(text, F.lit("")), _TURN + _TEXT, "")
    parts = F.split(F.regexp_replace(clean, rf"({markers}):\s*", f"{_TURN}$1{_TEXT}"), _TURN)
    roles = F.create_map(*(F.lit(x) for pair in ROLE_MARKERS.items() for x in pair))

    def turn(p: Column) -> Column:
        marked = F.contains(p, F.lit(_TEXT))
        role = F.when(marked, F.element_at(roles, F.substring_index(p, _TEXT, 1))).otherwise("unknown")
        return F.struct(role.alias("role"), stripped(F.when(marked, F.substring_index(p, _TEXT, -1)).otherwise(p)).alias("text"))

    return F.filter(F.transform(parts, turn), lambda t: t["text"] != "")


def speaker_summary(turns: Column) -> Column:
    """map<role, struct<turns, chars>> over parsed turns."""
    roles = F.array_sort(F.array_distinct(F.transform(turns, lambda t: t["role"])))

    def total(role: Column) -> Column:
        own = F.filter(turns, lambda t: t["role"] == role)
        chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
        return F.struct(role.alias("role"), F.struct(F.size(own).cast("long").alias("turns"), chars.alias("chars")).alias("s"))

    return F.map_from_entries(F.transform(roles, total))


def detect_sections(turns: DataFrame, call: str = "call_id", place: str = "turn_idx", cue: str = QA_CUE) -> DataFrame:
    """(call, n_turns, boundary, has_qa, method, corroborated) for rows of (call, place from 0, role, text).

    The boundary is the first turn of the questions and answers: the operator's first cue if it stands at most three
    turns before the first analyst, else the first analyst, else the cue; without such roles the first cue in any turn;
    else the number of turns.
    """
    text, role, at = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("unknown")), F.col(place)
    hit = text.rlike(cue)
    found = turns.groupBy(call).agg(
        F.count("*").alias("n_turns"),
        F.min(F.when((role == "operator") & hit, at)).alias("op"),
        F.min(F.when(role == "analyst", at)).alias("an"),
        F.min(F.when(hit, at)).alias("any"),
    )
    op, an, anywhere = F.col("op"), F.col("an"), F.col("any")
    near = op.isNotNull() & (an - op).between(0, CUE_NEAR_ANALYST)
    method = (
        F.when(an.isNotNull() & near, "operator_cue")
        .when(an.isNotNull(), "first_analyst")
        .when(op.isNotNull(), "operator_cue")
        .when(anywhere.isNotNull(), "text_cue")
        .otherwise("none")
    )
    boundary = F.when(F.col("method") == "operator_cue", op).when(F.col("method") == "first_analyst", an).when(F.col("method") == "text_cue", anywhere).otherwise(F.col("n_turns"))
    return found.withColumn("method", method).select(
        call, "n_turns", boundary.cast("long").alias("boundary"), (F.col("method") != "none").alias("has_qa"), "method", (an.isNotNull() & op.isNotNull()).alias("corroborated")
    )


def label_turns(turns: DataFrame, sections: DataFrame, call: str = "call_id", place: str = "turn_idx") -> DataFrame:
    """turns with section: prepared remarks before the boundary, then questions and answers."""
    return turns.join(sections.select(call, "boundary"), call).withColumn("section", F.when(F.col(place) < F.col("boundary"), PREPARED).otherwise(QA)).drop("boundary")


def boundary_context(turns: DataFrame, sections: DataFrame, call: str = "call_id", place: str = "turn_idx", n: int = 160) -> DataFrame:
    """(call, boundary, previous, boundary_text, following): snippets of the turns around each boundary."""
    near = turns.join(sections.where("has_qa").select(call, "boundary"), call).where(F.col(place).between(F.col("boundary") - 1, F.col("boundary") + 1))

    def at(offset: int, end: bool = False) -> Column:
        return F.max(F.when(F.col(place) == F.col("boundary") + offset, snippet(F.col("text"), n, end)))

    return near.groupBy(call, "boundary").agg(at(-1, True).alias("previous"), at(0).alias("boundary_text"), at(1).alias("following"))


def split_sentences(text: Column) -> Column:
    """Sentences of a stripped text: a break after . ! or ? and white space where an opener follows."""
    marked = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), SENTENCE_END, f"$1{_TURN}$2")
    return F.filter(F.split(marked, _TURN), lambda s: s != "")


def pack_sentences(sentences: Column, most: int = MAX_WORDS) -> Column:
    """array<array<string>>: sentences joined greedily while the words fit; a sentence over the limit stands alone if it
    opens a chunk. One pass over the sentences of a turn."""
    kind = "struct<done:array<array<string>>,open:array<string>,words:bigint>"
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("words")).cast(kind)

    def add(a: Column, s: Column) -> Column:
        n = word_count(s)
        full = (F.size(a["open"]) > 0) & (a["words"] + n > most)
        done = F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"])
        opened = F.when(full, F.array(s)).otherwise(F.array_append(a["open"], s))
        words = F.when(full, n).otherwise(a["words"] + n)
        alone = (n > most) & (F.size(opened) == 1)
        return F.struct(
            F.when(alone, F.array_append(done, opened)).otherwise(done).alias("done"),
            F.when(alone, F.array().cast("array<string>")).otherwise(opened).alias("open"),
            F.when(alone, F.lit(0).cast("long")).otherwise(words).alias("words"),
        ).cast(kind)

    def close(a: Column) -> Column:
        return F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"])

    return F.aggregate(sentences, empty, add, close)


def chunk_turns(turns: DataFrame, most: int = MAX_WORDS, text: str = "text") -> DataFrame:
    """turns exploded to (chunk_in_turn, n_words, n_chars, oversize, text): a turn is one chunk, or packed sentences if longer."""
    whole = stripped(F.coalesce(text, F.lit("")))
    rows = turns.withColumn(text, whole).where(F.col(text) != "")
    chunks = F.when(word_count(F.col(text)) <= most, F.array(F.col(text))).otherwise(F.transform(pack_sentences(split_sentences(F.col(text)), most), lambda c: F.array_join(c, " ")))
    out = rows.withColumn("chunks", chunks).select(*[c for c in rows.columns if c != text], F.posexplode("chunks").alias("chunk_in_turn", text))
    n = word_count(F.col(text))
    return out.withColumns({"n_words": n, "n_chars": F.length(text).cast("long"), "oversize": n > most})


def surface_stats(chunks: DataFrame, call: str = "call_id") -> DataFrame:
    """(call, scope, n_turns, n_chunks, n_words, n_chars, numeric_density, question_marks, words_per_turn) for each section
    and, as scope full, for each call, by grouping sets."""
    rows = chunks.withColumns({"num": numeric_words(F.col("text")), "tok": word_count(F.col("text")), "q": question_marks(F.col("text"))})
    sets = rows.groupingSets([[call, "section"], [call]], call, "section").agg(
        F.grouping("section").alias("all_sections"),
        F.countDistinct("turn_idx").alias("n_turns"),
        F.count("*").alias("n_chunks"),
        F.sum("n_words").alias("n_words"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("num").alias("num"),
        F.sum("tok").alias("tok"),
        F.sum("q").alias("question_marks"),
    )
    return sets.select(
        call,
        F.when(F.col("all_sections") == 1, "full").otherwise(F.col("section")).alias("scope"),
        "n_turns",
        "n_chunks",
        "n_words",
        "n_chars",
        F.coalesce(F.try_divide("num", "tok"), F.lit(0.0)).alias("numeric_density"),
        "question_marks",
        F.coalesce(F.try_divide("n_words", "n_turns"), F.lit(0.0)).alias("words_per_turn"),
    )


def section_text(chunks: DataFrame, call: str = "call_id") -> DataFrame:
    """(call, section, text): the chunks of a section joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn_idx", "chunk_in_turn", "text")))
    return chunks.groupBy(call, "section").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), " ").alias("text"))


def content_hash(model: str, text: Column) -> Column:
    """The key of a text in a cache of one model's vectors."""
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), text).cast("binary"), 256)
