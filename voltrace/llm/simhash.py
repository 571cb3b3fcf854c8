"""SimHash near-duplicates: 64-bit fingerprints joined within a Hamming distance by the generalised pigeonhole principle.

The fingerprint bits are grouped into parts of correlated bits, and part i gets a threshold t_i with
sum(t_i) = distance - parts + 1: two fingerprints within the distance must then lie within t_i in some part (a threshold
of -1 leaves a part out). For every number of parts the thresholds are allocated by dynamic programming on the probes
that they need and on the candidates that the parts' histograms over all fingerprints foretell; the cheapest plan runs.
Fingerprints probe with every value of a part up to its threshold away, and candidates are verified on all 64 bits.
Equal fingerprints are one entry, so groups of copies cost nothing, and no fingerprint has more than
sum(C(64, i), i <= distance) partners whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, columns, field_list, free_name, materialize, plain_names
from .components import connected_components

BITS = 64
#: Costs relative to one probe that is shuffled: comparing one candidate pair.
PAIR_COST = 0.02


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles under XXH64: a bit is 1 if over half of the shingles' hashes have it.

    A-Z are lower-cased, words are runs of characters other than \\x20 and \\x09 to \\x0D, repeats count. Fewer words
    than a shingle: the one sequence of all; no words (null and empty texts): zero.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.split() and bytes.lower() work on ASCII alone
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 65536):  # bounds the memory for very long texts
        some = words[at : min(at + 65536, n) + shingle - 1]
        runs = zip(*(some[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [some]
        hashes = np.array([digest(join(x), seed) for x in runs], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs with a long column ``name``: the fingerprint's 64 bits as a signed integer."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                values = np.array([fingerprint(x, shingle, seed) for x in part.column(at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.view(np.int64))], names=[*part.schema.names, name])

    plain = plain_names(docs)
    return plain.mapInArrow(add, f"{field_list(plain)}, `{name}` long").toDF(*docs.columns, name)


def _pair_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, for all pairs of bits how often both are 1), summed over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(values), 65536):
                bits = np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS + 1), "c": np.append(total.ravel(), n)})

    sums = prints.select("fp").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)  # 4,097 rows whatever the input
    for r in sums:
        flat[r["k"]] = r["c"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal width; each grows from its most correlated bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        first = max(left, key=lambda b: (strength[b, left].sum(), -b))
        group = [first]
        while len(group) < width:
            group.append(max((b for b in left if b not in group), key=lambda b: (strength[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def part_keys(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one integer."""
    out = np.zeros(len(values), np.int64)
    for j, b in enumerate(bits):
        out |= ((values >> b) & 1) << j
    return out


def _radius_masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << j for j in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def allocate(widths: list[int], pairs: list[float], n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of parts with sum distance - parts + 1 and least expected cost, by dynamic programming.

    ``pairs`` holds for each part how many ordered pairs of fingerprints agree in it; a threshold t widens that by the
    number of values up to t bits away. Returns (cost for each fingerprint, thresholds).
    """
    total, best = distance - len(widths) + 1, {0: (0.0, [])}
    for i, (width, same) in enumerate(zip(widths, pairs, strict=True)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(distance, width) + 1):
                ball = sum(comb(width, r) for r in range(t + 1))
                now = cost + ball + PAIR_COST * ball * same / max(n, 1)
                if used + t not in step or now < step[used + t][0]:
                    step[used + t] = (now, [*chosen, t])
        best = {k: v for k, v in step.items() if k + (len(widths) - i - 1) * -1 <= total}
    return best[total]


def plan_join(prints: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the parts to probe, from statistics over all of ``prints`` (distinct fingerprints "fp")."""
    n, both = _pair_counts(prints)
    choices = tuple(m for m in choices if m <= distance + 1) or (1,)
    grouped = {m: group_bits(n, both, m) for m in choices}
    flat = [bits for m in choices for bits in grouped[m]]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, bits in enumerate(flat):
                yield pa.RecordBatch.from_pydict({"part": np.full(len(values), k, np.int64), "key": part_keys(values, bits)})

    counts = prints.select("fp").mapInArrow(keys, "part long, key long").groupBy("part", "key").count()
    same = {r["part"]: r["pairs"] for r in counts.groupBy("part").agg(F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs")).collect()}
    plans, at = [], 0
    for m in choices:
        pairs = [same.get(at + i, 0.0) for i in range(m)]
        cost, thresholds = allocate([len(b) for b in grouped[m]], pairs, n, distance)
        plans.append((cost, m, [(b, t) for b, t in zip(grouped[m], thresholds, strict=True) if t >= 0]))
        at += m
    return min(plans, key=lambda x: x[:2])[2]


def hamming_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Distinct pairs (a, b), a < b, of values of ``prints.fp`` (distinct, not null) that differ in at most ``distance`` bits."""
    plan = plan_join(prints, distance)

    def expand(radius_of: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = [_radius_masks(len(bits), r) for (bits, _), r in zip(plan, radius_of, strict=True)]
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for k, (bits, _) in enumerate(plan):
                    key = part_keys(values, bits) | (k << 58)
                    for i in range(0, len(values), max(1, 200_000 // len(masks[k]))):
                        some = slice(i, i + max(1, 200_000 // len(masks[k])))
                        probe = (key[some, None] ^ masks[k]).ravel()
                        yield pa.RecordBatch.from_pydict({"key": probe, "fp": np.repeat(values[some], len(masks[k]))})

        return run

    fps = prints.select("fp")
    probes = fps.mapInArrow(expand([t for _, t in plan]), "key long, fp long").withColumnRenamed("fp", "a")
    index = fps.mapInArrow(expand([0] * len(plan)), "key long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(index, "key").where(near).select("a", "b").distinct()


def simhash_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3, keep_columns: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): documents with long columns ``fp`` and, if ``keep_columns``, their own columns under their
    names, else id_col only as ``doc_id``; classes (fp, component_id, keep_row) for every fingerprint.

    component_id is the smallest id reachable over links, keep_row the row number of the class's representative: the one
    with the smallest id (null ids last), then the first. Every link between different fingerprints counts.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row_number")
    rows = docs if keep_columns else docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = with_fingerprints(rows.withColumn(row, F.monotonically_increasing_id()), text_col if keep_columns else "text", fp)
    rows = materialize(rows if keep_columns else rows.drop("text"), "fingerprints")
    number = F.col(f"`{id_col}`" if keep_columns else "doc_id")
    first = F.min(F.struct(number.isNull().alias("none"), number.alias("id"), F.col(row).alias("row")))
    prints = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(first.alias("first")), "distinct-fingerprints")
    roots = connected_components(hamming_links(prints, distance))
    linked = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("first").alias("first"))
    classes = linked.select("fp", "root").join(best, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("keep_row"))
    return rows.withColumnsRenamed({fp: "fp", row: "row_number"}) if not keep_columns else rows, classes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id in its class).

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows with null ids belong to
    classes too; a class of null ids alone has a null component_id. Repeated rows stay rows. An empty table gives no
    rows. Other columns aren't read.
    """
    rows, classes = simhash_classes(docs, id_col=id_col, text_col=text_col, distance=distance)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """docs without near-duplicates: of each class the row with the smallest id stays (null ids last, then the first row), unchanged.

    Works with any further columns. Documents without words are one class.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row_number")
    rows, classes = simhash_classes(docs, id_col=id_col, text_col=text_col, distance=distance, keep_columns=True)
    keep = classes.select(F.col("keep_row").alias(row)).distinct()
    return rows.join(keep, row, "left_semi").drop(row, fp).select(*columns(docs))
