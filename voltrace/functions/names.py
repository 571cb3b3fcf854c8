"""Company names in transcripts: normalization, mentions, lookups, call types and dates."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

# Legal forms that don't tell companies apart.
LEGAL_SUFFIXES = (
    r"\b(incorporated|inc|corporation|corp|company|companies|co|limited|ltd|plc|llc|lp|"
    r"group|holdings?|the|nv|sa|ag|se)\b\.?"
)
# Single words too general to name a company.
GENERIC_TOKENS = (
    "american international national general first united global standard federal "
    "central southern northern western eastern pacific atlantic continental "
    "industries enterprises resources technologies systems brands partners "
    "capital financial energy services solutions communications"
).split()
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# What call types are told by, case ignored.
EARNINGS = (
    r"(?i)(?:(?:first|second|third|fourth)[ -]quarter|[1-4]Q\d\d|Q[1-4]\b|earnings|quarterly|"
    r"(?:full[- ]year|year[- ]end|annual).{0,30}results)"
)
MERGER = r"(?i)\b(merger|acquisition|acquire|combination|transaction|tender offer)\b"
CONFERENCE = r"(?i)\b(forum|fireside|analyst at|tech conference|hosted by)\b"
STRONG_CONFERENCE = (
    r"(?i)fireside(?! chat at\b)|introduce our next company|analyst at |"
    r"my name is .{3,80}?analyst|"
    r"(?:healthcare|tech(?:nology)?|growth|industrial) conference|investor conference(?! call)"
)
MEETING = (
    r"(?i)(?:annual|special) meeting of (?:the )?(?:share|stock)(?:holder|owner)s?"
    r"|annual (?:share|stock)(?:holder|owner)s? meeting"
)
SALES = r"(?i)\bmonthly sales\b"
# Words of an event or a greeting around a company's name.
EVENT_WORDS = (
    rf"(?:first|second|third|fourth|[1-4]Q\d*|Q[1-4]|fiscal|year[- ]?end|full[- ]year|annual|"
    rf"quarter|quarterly|monthly|earnings|results|reports?|investor|overview|review|conference|"
    rf"call|webcast|business update|update|and|20\d\d|'\d\d|\d+(?:st|nd|rd|th)|{MONTHS})"
)
FILLER_HEAD = (
    r"(?i)^(?:(?:you|to|the|this|that|our|your|todays?|thank|thanks|for|joining|all|of|"
    r"everyone|come|into|welcome|and|shareholders|ladies|gentlemen|good|morning|"
    r"afternoon|evening)(?:'s)?[ ,]+)+"
)
# Greetings that name a company, with the weight of their evidence.
GREETINGS = (
    (
        r"(?i)(?:welcome,? (?:everyone,? )?(?:to )?|you've joined |join(?:ing)? us (?:today )?(?:for|on) )(?:the )?"
        r"([A-Z].{2,60}?)(?:'s)?[ ,.]+"
        r"(?:first|second|third|fourth|[1-4]Q|Q[1-4]|fiscal|full[- ]year|\d{4}|earnings|year[- ]end|annual|quarterly|special)",
        6,
    ),
    (
        r"(?i)welcome,? (?:everyone,? )?(?:back )?to .{0,60}"
        r"(?:quarter|20\d\d|'\d\d|fiscal \d{4}|year[- ]end)\s+"
        r"([A-Z].{2,50}?)\s+(?:earnings|results|financial)",
        6,
    ),
    (r"(?:hosted by|teleconference (?:for|of)|conference call (?:for|of))\s+(?:the )?([A-Z][\w&.,' -]{2,60}?)\s*[.,;]", 4),
    (r"[Ii]nvestor [Rr]elations (?:for|at|of)\s+(?:the )?([A-Z][\w&.,' -]{2,60}?)\s*[.,;]", 4),
    (r"(?:earnings|results) call for\s+(?:the )?([A-Z][\w&.,' -]{2,60}?)\s*[.,;]", 4),
    (r"([A-Z][\w&.' -]{2,60}?)'s (?:Senior |Executive )?Vice President of Investor Relations", 4),
    (r"(?i)welcome to (?:the )?([A-Z].{2,60}?)(?:'s)?[ ,.]+(?:conference|earnings|quarterly) call", 6),
)
CAPITAL_TOKEN = r"(?:[A-Z][\p{L}\p{N}_.\-']*|&)"
CAPITAL_RUN = rf"{CAPITAL_TOKEN}(?:[ \t]{CAPITAL_TOKEN})*"
HEAD_CHARS, GREETING_CHARS = 1500, 4000
LONGEST_RUN, LONGEST_SPAN, SINGLE_CAP = 12, 6, 3


def _folds() -> tuple[str, str, dict[str, str]]:
    """(letters, their base letters, letters with longer forms) up to U+FFFF whose compatibility decomposition has ASCII."""
    one, base, longer = [], [], {}
    for code in range(0xA0, 0x10000):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(c)
            base.append(plain)
        elif plain:
            longer[c] = plain
    return "".join(one), "".join(base), longer


def ascii_fold(x: Column) -> Column:
    """Letters with accents and other compatibility forms as ASCII; what has none is dropped."""
    one, base, longer = _folds()
    rare = F.regexp_replace(x, "[^\\x00-\\u024F]", "")  # forms of several letters beyond Latin are dropped
    text = F.when(x.rlike("[\\u0250-\\uFFFF]"), F.translate(x, one, base)).otherwise(F.translate(rare, "".join(c for c in one if c <= "ɏ"), "".join(b for c, b in zip(one, base, strict=True) if c <= "ɏ")))
    for c, plain in longer.items():
        if c <= "ɏ" or "ﬀ" <= c <= "ﬆ":
            text = F.replace(text, F.lit(c), F.lit(plain))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def normalize_name(x: Column, fold: bool = True) -> Column:
    """A company's name as a key: ASCII, lower case, apostrophes joined, without state tags, punctuation and legal forms,
    single letters joined. fold=False takes the text to be ASCII already."""
    name = ascii_fold(x) if fold else x
    name = F.regexp_replace(name, r"['’]", "")
    name = F.regexp_replace(name, r"/[A-Za-z]{2,3}/?\s*$", " ")
    name = F.regexp_replace(F.lower(name), r"[^a-z0-9 ]", " ")
    name = F.regexp_replace(name, LEGAL_SUFFIXES, " ")
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.regexp_replace(name, r"\b([a-z]) (?=[a-z]\b)", "$1")


def clean_candidate(x: Column) -> Column:
    """A captured name without greeting words before it and event words around it."""
    name = F.regexp_replace(x, FILLER_HEAD, "")
    name = F.regexp_replace(name, rf"(?i)^(?:{EVENT_WORDS}[ ,]+)+", "")
    name = F.regexp_replace(name, rf"(?i)\b{EVENT_WORDS}\b.*$", "")
    return F.regexp_replace(name, r"^[ ,.\-|]+|[ ,.\-|]+$", "")


def classify_call(head: Column, first_page: Column | None = None) -> Column:
    """The type of a call from its first 1,500 characters and a document's first page; the first rule that fits wins."""
    blob = F.concat(F.substring(F.coalesce(head, F.lit("")), 1, HEAD_CHARS), F.lit(" "), F.coalesce(first_page, F.lit("")) if first_page is not None else F.lit(""))
    return (
        F.when(blob.rlike(SALES), "sales")
        .when(blob.rlike(MEETING), "meeting")
        .when(blob.rlike(STRONG_CONFERENCE), "conference")
        .when(blob.rlike(EARNINGS), "earnings")
        .when(blob.rlike(MERGER), "ma")
        .when(blob.rlike(CONFERENCE), "conference")
        .otherwise("unknown")
    )


def long_date(x: Column) -> Column:
    """The first date like "March 4, 2021" in a text."""
    pattern = rf"({MONTHS})\s+(\d{{1,2}})\s*,?\s*(20\d\d)"
    parts = [F.regexp_extract(x, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws(" ", *parts), "MMMM d yyyy"))


def choose_date(first_page: Column, created: Column) -> Column:
    """struct<date, source, flag>: the first page's date, else the creation date, flagged if they are over 45 days apart on
    a scale of 31-day months."""

    def ordinal(d: Column) -> Column:
        return F.year(d) * 372 + F.month(d) * 31 + F.day(d)

    apart = F.abs(ordinal(first_page) - ordinal(created)) > 45
    return F.struct(
        F.coalesce(first_page, created).alias("date"),
        F.when(first_page.isNotNull(), "first_page").when(created.isNotNull(), "created").otherwise("").alias("source"),
        F.when(first_page.isNotNull(), F.when(apart, "date_disagreement").otherwise("")).when(created.isNotNull(), "date_from_creation_stamp").otherwise("no_date").alias("flag"),
    )


def first_wins(names: DataFrame, key: str, rank: str) -> DataFrame:
    """One row for each key, the one of lowest rank."""
    w = Window.partitionBy(key).orderBy(rank)
    return names.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def phrase_mentions(texts: DataFrame, dictionary: DataFrame, call: str = "call_id", text: str = "text", single_min: int = 2, fold: bool = True) -> DataFrame:
    """(call, company, n): mentions of dictionary keys in runs of capitalized words.

    dictionary has key, company and single_ok (whether a one-word key names a company by itself). From each word of a run
    of at most 12 the longest span of up to 6 words that is a key counts, possessives dropped if need be; one-word keys of
    5 letters or more that aren't generic count from ``single_min`` mentions and at most 3. Spans are joined with the
    dictionary by key, so its size doesn't matter to a text.
    """
    runs = texts.select(call, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CAPITAL_RUN), F.lit(0))).alias("run", "r"))
    tokens = runs.withColumn("t", F.split("r", r"[ \t]")).where(F.size("t") <= LONGEST_RUN)
    starts = tokens.select(call, "run", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    spans = starts.withColumn("j", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_SPAN), F.size("t") - F.col("i") + 1))))
    span = F.array_join(F.slice("t", F.col("i"), F.col("j")), " ")
    spans = spans.select(call, "run", "i", "j", span.alias("span"))
    forms = F.array_distinct(F.array(normalize_name(F.col("span"), fold), normalize_name(F.regexp_replace("span", r"['’]s\b", ""), fold)))
    keyed = spans.select(call, "run", "i", "j", F.posexplode(forms).alias("form", "key")).where("key != ''")
    hits = keyed.join(dictionary.select("key", "company", "single_ok"), "key")
    one = ~F.contains("key", F.lit(" "))
    fits = ~one | ((F.col("j") == 1) & F.col("single_ok") & (F.length("key") >= 5) & ~F.col("key").isin(*GENERIC_TOKENS))
    w = Window.partitionBy(call, "run", "i").orderBy(F.desc("j"), "form")
    longest = hits.where(fits).withColumn("rn", F.row_number().over(w)).where("rn = 1").withColumn("one", ~F.contains("key", F.lit(" ")))
    sums = longest.groupBy(call, "company").agg(F.count_if(~F.col("one")).alias("m"), F.count_if("one").alias("s"))
    n = F.col("m") + F.when(F.col("s") >= single_min, F.least(F.col("s"), F.lit(SINGLE_CAP))).otherwise(0)
    return sums.select(call, "company", n.alias("n")).where("n > 0")


def greeting_names(texts: DataFrame, call: str = "call_id", text: str = "text") -> DataFrame:
    """(call, kind, weight, name): for each greeting pattern the first capture that looks like a name."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, GREETING_CHARS)

    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), lambda x: clean_candidate(F.trim(x)))
        return F.get(F.filter(found, lambda x: (F.length(x) >= 2) & x.rlike(r"^.?\p{Lu}")), F.lit(0))

    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(w).alias("weight"), first(p).alias("name")) for i, (p, w) in enumerate(GREETINGS)))
    return texts.select(call, F.explode(kinds).alias("g")).select(call, "g.*").where("name IS NOT NULL")


def lookup_names(names: DataFrame, dictionary: DataFrame, name: str = "name", cutoff: float = 0.85) -> DataFrame:
    """names with company: by key, by key without possessive, by the lowest-ranked key that begins with it, else by the
    closest key with the same first word and a similarity of at least ``cutoff``.

    dictionary: key, company, rank. Candidates for the last two tiers are joined by the first word, so a name meets only
    keys that could match it. Prefixes need 5 letters or two words; single generic words match whole keys only.
    """
    key = normalize_name(clean_candidate(F.col(name)))
    dropped = normalize_name(F.regexp_replace(clean_candidate(F.col(name)), r"['’]s\b", ""))
    rows = names.withColumns({"key_a": key, "key_b": dropped}).withColumn("first_word", F.substring_index("key_a", " ", 1))
    distinct = rows.select("key_a", "key_b", "first_word").distinct().where(F.length("key_a") >= 2)
    exact = dictionary.select("key", "company")
    by_key = distinct.join(exact.withColumnsRenamed({"key": "key_a", "company": "one"}), "key_a", "left").join(exact.withColumnsRenamed({"key": "key_b", "company": "two"}), "key_b", "left")
    open_ = by_key.where("one IS NULL AND two IS NULL").where(F.contains("key_a", F.lit(" ")) | ~F.col("key_a").isin(*GENERIC_TOKENS))
    near = open_.join(dictionary.withColumn("first_word", F.substring_index("key", " ", 1)), "first_word")
    long = (F.length("key_a") >= 5) | F.contains("key_a", F.lit(" "))
    near = near.withColumns({"prefix": long & F.startswith("key", F.concat("key_a", F.lit(" "))), "ratio": similarity(F.col("key_a"), F.col("key"))})
    best = near.where(F.col("prefix") | (F.col("ratio") >= cutoff)).groupBy("key_a", "key_b").agg(
        F.min_by("company", F.struct(~F.col("prefix"), F.when(F.col("prefix"), F.col("rank")), -F.col("ratio"), F.col("rank"))).alias("three")
    )
    found = by_key.join(best, ["key_a", "key_b"], "left").select("key_a", "key_b", F.coalesce("one", "two", "three").alias("company"))
    return rows.join(found, ["key_a", "key_b"], "left").select(*names.columns, "company")


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters, matching blocks found from the longest down."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def resolve(evidence: DataFrame, call: str = "call_id") -> DataFrame:
    """(call, company, score, runner_up, runner_up_score, flag) from rows (call, company, kind, points, corroborated).

    kind is body for mentions, else a greeting or document whose points also count as greeting evidence; corroborated
    tells whether the company is mentioned near the opening. Decisions in order: no candidate; a top score below 2 is
    weak; greeting evidence of at least 6 and 6 ahead wins if it isn't the leader's or the margin is below 2; a margin
    below 2 is ambiguous; a leader by body alone with at most 3 needs the opening; else the leader.
    """
    sums = evidence.groupBy(call, "company").agg(
        F.sum("points").alias("score"), F.sum(F.when(F.col("kind") != "body", F.col("points")).otherwise(0)).alias("greet"), F.coalesce(F.bool_or("corroborated"), F.lit(False)).alias("near")
    )

    def order(x: str):
        return Window.partitionBy(call).orderBy(F.desc(x), "company")

    ranked = sums.withColumns({"r": F.row_number().over(order("score")), "g": F.row_number().over(order("greet"))})

    def at(c: str, r: str, n: int) -> Column:
        return F.max(F.when(F.col(r) == n, F.col(c)))

    wide = ranked.groupBy(call).agg(
        at("company", "r", 1).alias("c1"), at("score", "r", 1).alias("s1"), at("near", "r", 1).alias("n1"), at("company", "r", 2).alias("c2"), F.coalesce(at("score", "r", 2), F.lit(0)).alias("s2"),
        at("company", "g", 1).alias("gc"), at("score", "g", 1).alias("gs"), at("greet", "g", 1).alias("g1"), F.coalesce(at("greet", "g", 2), F.lit(0)).alias("g2"), F.sum("greet").alias("greeted"),
    )
    margin = F.col("s1") - F.col("s2")
    dominant = (F.col("g1") >= 6) & (F.col("g1") - F.col("g2") >= 6) & ((F.col("gc") != F.col("c1")) | (margin < 2))
    flag = (
        F.when(F.col("s1") < 2, "unresolved:weak_evidence")
        .when(dominant, "greeting_dominant")
        .when(margin < 2, "unresolved:ambiguous")
        .when((F.col("greeted") == 0) & (F.col("s1") <= 3) & ~F.col("n1"), "unresolved:body_only_tail")
        .otherwise("")
    )
    wide = wide.withColumn("flag", flag)
    won, lost = F.col("flag") == "greeting_dominant", F.startswith("flag", F.lit("unresolved"))
    other = F.when(F.col("gc") == F.col("c1"), F.col("c2")).otherwise(F.col("c1"))
    other_score = F.when(F.col("gc") == F.col("c1"), F.col("s2")).otherwise(F.col("s1"))
    return wide.select(
        call,
        F.when(won, F.col("gc")).when(~lost, F.col("c1")).alias("company"),
        F.when(won, F.col("gs")).otherwise(F.col("s1")).alias("score"),
        F.when(won, other).when(lost, F.col("c1")).otherwise(F.col("c2")).alias("runner_up"),
        F.when(won, other_score).otherwise(F.col("s2")).alias("runner_up_score"),
        "flag",
    )
