"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose pairs, whole shingle sets confirm them.

At similarity 0.8 two 64-bit SimHashes of five-word shingles are about 10 bits apart, too far to probe, so the candidates
come from BANDS bands of ROWS minima: a pair of similarity 0.8 shares none with odds of (1 - 0.8**5)**24 = 7 in 100,000.
Equal sets are one entry. The first round compares every member of a bucket to one of it, another one in each band; the
second compares whatever is still in different classes, so a large class of near copies isn't compared with itself. There a
sketch of each set, the parities of how many shingles fall on each of 512 bits, excludes pairs inside the join: two sets
differ in at least as many shingles as their sketches do in bits, so no pair that is similar enough is left out. The
members of a large bucket are dealt over cells of about CELL, and those outside its main class go to every cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, columns, field_list, free_name, materialize, plain_names
from ._words import chunks, mix
from .components import connected_components

BANDS, ROWS = 24, 5
#: Words of 64 bits in a sketch; it tells texts of up to some 600 words well apart, and longer ones less well.
WORDS = 8
#: Members of a bucket that one cell of the second round holds; larger buckets are dealt over more cells.
CELL = 256
_random = np.random.Generator(np.random.PCG64(20240517))
_TIMES = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes) of chunks of rows: each row's distinct shingles, ascending.

    A-Z are lower-cased, words are those of SimHash; fewer words than a shingle are one shingle, no words have none.
    """
    for chunk in chunks(column):
        chunk.data = _LOWER[chunk.data]
        words, at = chunk.word_hashes(), chunk.windows(shingle)
        few = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < shingle))
        first = chunk.word_offsets[few]
        doc = np.concatenate([chunk.doc_of_word()[at], few])
        h = np.zeros(len(doc), np.uint64)
        h[: len(at)] = chunk.window_hashes(shingle, at, words)
        for n in range(1, shingle):
            same = chunk.n_words[few] == n
            h[len(at) :][same] = chunk.window_hashes(n, first[same], words)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        yield chunk.first, np.searchsorted(doc, np.arange(chunk.docs + 1)), h


def set_keys(offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each set, 0 for an empty one; rows that have words; their band keys, BANDS for each)."""
    ids = np.zeros(len(offsets) - 1, np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    keys = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        starts = offsets[some]
        ids[some] = mix(np.add.reduceat(mix(h + np.uint64(1)), starts))
        for b in range(BANDS):
            for r in range(ROWS):
                keys[:, b] = mix(keys[:, b] + np.minimum.reduceat(h * _TIMES[b, r] + _PLUS[b, r], starts))
    return ids, some, keys


def set_sketches(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row for each set that isn't empty: its size and WORDS words of parities."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(some), 1 + WORDS), np.uint64)
    if len(some):
        out[:, 0] = np.diff(offsets)[some]
        place = mix(h + np.uint64(2))
        word, bit = (place >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (place & np.uint64(63))
        for k in range(WORDS):
            out[:, k + 1] = np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), offsets[some])
    return out


def may_be_similar(x: Column, y: Column, percent: int) -> Column:
    """False only for sketches of sets whose Jaccard similarity is below so many percent."""
    n, m = x[0], y[0]
    differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])).cast("long") for k in range(1, WORDS + 1)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _lists(some: np.ndarray, rows: int, values: np.ndarray) -> pa.ListArray:
    """A list for each of so many rows: a row of ``values`` for ``some`` of them, else an empty one."""
    ends = np.zeros(rows + 1, np.int32)
    ends[some + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(values.ravel().view(np.int64)))


def _with_keys(docs: DataFrame, text_col: str, key: str, bands: str, sketch: str, shingle: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, h in shingle_sets(batch.column(at), shingle):
                ids, some, keys = set_keys(offsets, h)
                added = [pa.array(ids.view(np.int64)), _lists(some, len(ids), keys), _lists(some, len(ids), set_sketches(offsets, h))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(ids)).columns, *added], names=[*batch.schema.names, key, bands, sketch])

    plain = plain_names(docs)
    return plain.mapInArrow(add, f"{field_list(plain)}, `{key}` long, `{bands}` array<long>, `{sketch}` array<long>").toDF(*docs.columns, key, bands, sketch)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, h in shingle_sets(batch.column(1), shingle):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least so many percent, exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    n, m, both = F.size("x").cast("long"), F.size("y").cast("long"), F.size(F.array_intersect("x", "y")).cast("long")
    near = pairs.join(left, "a").join(right, "b").where(F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return near.where(both * 100 >= (n + m - both) * percent).select("a", "b")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_links(prints: DataFrame, texts_of, *, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node, bands, sketch) that join the same classes as all confirmed candidate pairs.

    ``texts_of`` gives (node, text) for a table of nodes.
    """
    bands = prints.select("node", F.posexplode("bands").alias("band", "key"))
    many = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node"))["node"].alias("head"))
    members = materialize(bands.join(many.where("n > 1").select("band", "key", "head"), ["band", "key"]), "bucket-members")
    stars = materialize(members.where("node != head").select(*_ordered("node", "head")).distinct(), "star-pairs")
    sets = materialize(_sets(texts_of(members.select("node").distinct()), shingle), "shingle-sets")
    found = materialize(_confirmed(stars, sets, percent), "star-links")
    roots = connected_components(found)
    rooted = members.drop("head").join(roots, "node", "left").select("node", "band", "key", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted-members")
    classes = rooted.groupBy("band", "key", "root").count()
    split = classes.groupBy("band", "key").agg(F.count("*").alias("k"), F.max(F.struct("count", "root"))["root"].alias("main"), F.ceil(F.sum("count") / CELL).alias("cells")).where("k > 1")
    open_ = rooted.join(split.drop("k"), ["band", "key"]).join(prints.select("node", "sketch"), "node")
    open_ = materialize(open_.withColumn("cell", F.pmod(F.xxhash64("node"), "cells")), "open-members")
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell")
    some = open_.where("root != main").select("band", "key", cell, F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("sketch").alias("p_sketch"))
    apart = (F.col("p_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("p") < F.col("node")))
    rest = some.join(open_, ["band", "key", "cell"]).where(apart & may_be_similar(F.col("p_sketch"), F.col("sketch"), percent))
    rest = rest.select(*_ordered("p", "node")).distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"), "other-pairs")
    return found.unionByName(_confirmed(rest, sets, percent))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: texts whose sets of word shingles have a Jaccard similarity of ``percent`` or more are
    linked, and of each class of linked texts the row with the smallest id stays (null ids last, then the first row), unchanged.

    Works with any further columns. Documents without words are one class.
    """
    key, bands, sketch, row = (free_name(docs, x) for x in ("set_key", "set_bands", "set_sketch", "row_number"))
    rows = materialize(_with_keys(docs.withColumn(row, F.monotonically_increasing_id()), text_col, key, bands, sketch, shingle), "shingle-keys")
    number = F.col(f"`{id_col}`")
    first = F.min(F.struct(number.isNull().alias("none"), number.alias("id"), F.col(row).alias("row")))
    prints = rows.groupBy(F.col(key).alias("node")).agg(first.alias("first"), F.first(bands).alias("bands"), F.first(sketch).alias("sketch"))
    prints = materialize(prints, "distinct-sets")

    def texts_of(nodes: DataFrame) -> DataFrame:
        at = prints.join(nodes, "node", "left_semi").select("node", F.col("first.row").alias("at"))
        return rows.select(F.col(row).alias("at"), F.col(f"`{text_col}`").alias("text")).join(at, "at").select("node", "text")

    roots = connected_components(similar_links(prints.select("node", "bands", "sketch"), texts_of, percent=percent, shingle=shingle))
    best = prints.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(best.select(F.col("first.row").alias(row)), row, "left_semi").select(*columns(docs))
