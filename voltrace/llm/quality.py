"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost goes first.

The measures are cheap sums over the bytes of a text or, for repeats, sorts of line and word numbers, which are equal
where and only where the bytes are. Each rule names the measures that it needs and a predicate over them. On a bounded
sample every rule's cost (the counted steps of those of its measures that no rule before it has taken) and selectivity
(share of texts that it rejects) are estimated; rules are then ordered by rejection per cost, and each rule measures only
the texts that all rules before it let through. The order changes the work and which rule a text fails first, never the
verdict; as steps are counted and not timed, the same table has the same order on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, columns, field_list, plain_names
from ._words import SPACE, Chunk, chunks, exact_ids

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_LOWER = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _by_doc(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    return _sums(flags, chunk.offsets[:-1], chunk.offsets[1:])


def _n_words(chunk: Chunk) -> np.ndarray:
    return chunk.n_words


def _word_chars(chunk: Chunk) -> np.ndarray:
    """Code points that stand in words: bytes that begin a character and aren't spaces."""
    return _by_doc(chunk, ((chunk.data & 0xC0) != 0x80) & ~SPACE[chunk.data])


def _n_symbols(chunk: Chunk) -> np.ndarray:
    return _by_doc(chunk, SYMBOLS[chunk.data])


def _n_upper(chunk: Chunk) -> np.ndarray:
    """Words with an A-Z and no a-z."""
    up, low = _sums(_UPPER[chunk.data], chunk.starts, chunk.ends), _sums(_LOWER[chunk.data], chunk.starts, chunk.ends)
    total = np.concatenate([[0], np.cumsum((up > 0) & (low == 0))])
    return total[chunk.word_offsets[1:]] - total[chunk.word_offsets[:-1]]


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each line that has a word."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.union1d(chunk.offsets[:-1], breaks + 1)
    starts = starts[starts < len(chunk.data)]
    doc = np.searchsorted(chunk.offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(chunk.data))
    broken = (ends > starts) & (chunk.data[ends - 1] == 10) if len(ends) else np.zeros(0, bool)
    ends = ends - broken
    worded = np.searchsorted(chunk.starts, starts) < np.searchsorted(chunk.starts, ends)
    return doc[worded], starts[worded], ends[worded]


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether one with the same keys stands before it, and whether its keys stand twice or more."""
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    later, any_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def _n_lines(chunk: Chunk) -> np.ndarray:
    return np.bincount(_lines(chunk)[0], minlength=chunk.docs)


def _n_dup_lines(chunk: Chunk) -> np.ndarray:
    doc, starts, ends = _lines(chunk)
    later, _ = _repeats(exact_ids(chunk.data, starts, ends), doc)
    return np.bincount(doc[later], minlength=chunk.docs)


def _n_repeat_words(chunk: Chunk, k: int = 3) -> np.ndarray:
    """Words that a k-word window covers which stands twice or more in the text."""
    at = chunk.windows(k)
    covered = np.zeros(len(chunk.starts), bool)
    if len(at):
        ids = chunk.word_ids()
        many, key, keys = int(ids.max()) + 1, chunk.doc_of_word()[at], []
        room = 2**62 // max(chunk.docs, many)
        for i in range(k):  # as many numbers as fit go into one key
            if room < many:
                keys, key, room = [*keys, key], ids[at + i], 2**62 // many
            else:
                key, room = key * many + ids[at + i], room // many
        _, twice = _repeats(*keys, key)
        for i in range(k):
            covered[at[twice] + i] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[chunk.word_offsets[1:]] - total[chunk.word_offsets[:-1]]


MEASURES: dict[str, Callable[[Chunk], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_upper": _n_upper,
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
}


def _sort_steps(n: int) -> float:
    return n * np.log2(n + 2)


def measure_steps(measure: str, chunk: Chunk) -> float:
    """About how many elementary steps a measure of a chunk takes: passes over bytes or words, and sorts."""
    size, words = len(chunk.data), len(chunk.starts)
    steps = {
        "n_words": lambda: chunk.docs,
        "word_chars": lambda: 4 * size,
        "n_symbols": lambda: 2 * size,
        "n_upper": lambda: 4 * size + 6 * words,
        "n_lines": lambda: 2 * size + _sort_steps(int((chunk.data == 10).sum()) + chunk.docs),
        "n_dup_lines": lambda: 3 * size + 3 * _sort_steps(int((chunk.data == 10).sum()) + chunk.docs),
        "n_repeat_words": lambda: size + 20 * words + 3 * _sort_steps(words),
    }
    return float(steps[measure]() if measure in steps else size)


@dataclass(frozen=True)
class Rule:
    """Rejects texts for which ``rejects`` of the measures holds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: The two base rules, then rules for text that isn't prose: symbols, shouting, lines that repeat, odd word lengths.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("upper_case", ("n_upper", "n_words"), lambda u, n: 2 * u > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
)
BASE_RULES = ("few_words", "repeated_words")


def _subset(chunk: Chunk, alive: np.ndarray) -> Chunk:
    if alive.all():
        return chunk
    flags = np.repeat(alive, np.diff(chunk.offsets))
    return Chunk(0, chunk.data[flags], np.concatenate([[0], np.cumsum(np.diff(chunk.offsets)[alive])]))


def cascade(chunk: Chunk, rules: tuple[Rule, ...], also: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(index of the first rule that each text fails or -1, the measures named in ``also`` of every text).

    A rule's measures are taken of the texts that are left; measures asked for in ``also`` are taken of all texts and
    serve the rules too.
    """
    all_ = {m: MEASURES[m](chunk) for m in also}
    failed = np.full(chunk.docs, -1, np.int64)
    known: dict[str, np.ndarray] = dict(all_)
    left, rest = np.arange(chunk.docs), chunk
    for i, rule in enumerate(rules):
        if not len(left):
            break
        for m in rule.needs:
            if m not in known:
                known[m] = MEASURES[m](rest)
        out = rule.rejects(*(known[m] for m in rule.needs))
        failed[left[out]] = i
        if out.any():
            known = {m: v[~out] for m, v in known.items()}
            if any(m not in known for later in rules[i + 1 :] for m in later.needs):
                rest = _subset(rest, ~out)
            left = left[~out]
    return failed, all_


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost on the sampled texts, the best first; ties and an empty sample keep the given order.

    The next rule is the one that rejects most of the texts still left for each step of the measures not yet taken.
    """
    parts = [p for p in chunks(pa.array(texts, pa.string())) if len(p.data)]
    if not parts:
        return rules
    found = {r.name: np.concatenate([r.rejects(*(MEASURES[m](p) for m in r.needs)) for p in parts]) for r in rules}
    steps = {m: sum(measure_steps(m, p) for p in parts) for r in rules for m in r.needs}
    taken: set[str] = set()
    left = np.ones(sum(p.docs for p in parts), bool)
    rest, out = list(rules), []
    while rest:
        cost = [sum(steps[m] for m in set(r.needs) - taken) + left.sum() + 1 for r in rest]
        best = max(range(len(rest)), key=lambda i: ((found[rest[i].name] & left).sum() / cost[i], -i))
        rule = rest.pop(best)
        out.append(rule)
        taken |= set(rule.needs)
        left &= ~found[rule.name]
    return tuple(out)


def sample_texts(docs: DataFrame, text_col: str, rows: int, chars: int, each: int = 16) -> list[str]:
    """At most ``rows`` texts, cut to ``chars`` characters, for the estimates alone: of the first ``each`` rows of every
    partition those with the smallest hashes, so all parts of the table are asked and none is read further."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in batches:
            if found < each:  # what follows is passed over unread
                yield batch.slice(0, each - found)
                found += batch.num_rows

    some = docs.select(F.substring(docs[text_col].cast("string"), 1, chars).alias("t")).mapInArrow(first, "t string")
    return [r["t"] or "" for r in some.orderBy(F.xxhash64("t"), "t").limit(rows).collect()]


def apply_quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    measures: tuple[str, ...] = (),
    prefix: str = "quality_",
    sample_rows: int = 512,
    sample_chars: int = 20_000,
) -> DataFrame:
    """docs with ``{prefix}kept`` (boolean), ``{prefix}failed`` (name of the first rule failed in cascade order, else
    null) and a long ``{prefix}{measure}`` for each of ``measures``.

    The sample (``sample_rows`` rows cut to ``sample_chars`` characters) only orders the rules; every text is judged
    whole. Null and empty texts have no words and fail ``few_words``. Rows are judged one by one, so repeated rows get
    equal verdicts; an empty table stays empty. Other columns pass through unread; a name that starts with the prefix
    and is already taken is an error, so choose another prefix.
    """
    names = [prefix + x for x in ("kept", "failed", *measures)]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another prefix")
    bound_batches(docs.sparkSession)
    ordered = order_rules(sample_texts(docs, text_col, sample_rows, sample_chars), rules)
    labels = np.array([*(r.name for r in ordered), None], object)
    at = docs.columns.index(text_col)
    added = ", ".join([f"`{names[0]}` boolean", f"`{names[1]}` string", *(f"`{n}` long" for n in names[2:])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(at)):
                failed, found = cascade(chunk, ordered, measures)
                rows = batch.slice(chunk.first, chunk.docs)
                new = [pa.array(failed < 0), pa.array(labels[failed].tolist(), pa.string())]
                new += [pa.array(found[m].astype(np.int64)) for m in measures]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, *names])

    text = docs.withColumn(text_col, docs[text_col].cast("string")) if dict(docs.dtypes)[text_col] != "string" else docs
    text = plain_names(text)
    return text.mapInArrow(judge, f"{field_list(text)}, {added}").toDF(*docs.columns, *names)


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    judged = apply_quality_rules(docs, prefix="_quality_", **options)
    return judged.where(F.col("_quality_kept")).select(*columns(docs))
