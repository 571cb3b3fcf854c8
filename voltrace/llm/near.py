"""Near-duplicates by wide SimHashes: fingerprints within a Hamming distance are candidates, whole shingle sets confirm them.

At a Jaccard similarity of 0.8 the cosine of two shingle sets is 2 * 0.8 / 1.8 or more, so a SimHash bit of theirs agrees
with odds of 0.848. 64 bits are too few to tell such pairs apart from others and too few to find them by, so a fingerprint
has 2,048. A shingle's hash of 2,048 bits is its code word: the row of a Hadamard matrix that 11 bits of the shingle's 64-bit
hash choose, with the sign of another bit; a fingerprint bit is 1 if over half of the shingles' hashes have it. A fast Walsh
transform of signed counts gives all bits at once.

The join samples bits: each table deals all fingerprints by some bits of theirs, as many as leave about BUCKET to a bucket,
and there are so many tables, each with bits of its own, that a pair of similarity 0.8 meets in none with odds of MISS. In a
bucket every pair is compared on 192 further bits, which are in no table. Equal sets are one entry.

A bucket gives no pairs: it gives a tree over each component of its close fingerprints, a row for each member but one, and
leaves out pairs that met in one of the first tables. What the trees of all buckets join is a family; no close pair is outside
one. In a family the sets themselves meet, a row for each member, and a search over whole sets gives the classes, again as
trees; the parity sketches of ``similar`` exclude pairs first. Small families share a group. A large one is dealt over cells,
its head to all of them; where that leaves several classes, the members outside the largest one visit all cells, so every two
members of different classes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from ._store import bound_batches, columns, field_list, free_name, materialize, plain_names
from ._words import mix
from .components import connected_components
from .similar import _lists, set_sketches, shingle_sets

BITS = 2048
#: Bits compared in a bucket, and by how many of them two fingerprints may differ: those of a pair of similarity 0.8 differ
#: in 29.1 on average, in more than DISTANCE with odds below 1 in 10,000; those of unrelated texts with odds of 3 in 100 billion,
#: so that chance joins no families.
CHECKED, DISTANCE = 192, 50
#: Odds with which a fingerprint bit agrees at similarity 0.8, and with which a pair of that similarity meets in no table.
AGREE, MISS = 0.8485, 1e-4
#: Fingerprints that a bucket holds on average.
BUCKET = 4096
#: Rows of a bucket in one cell; a bucket of more than two cells' rows is compared by pairs of cells, each a group of its own.
CELL = 8192
#: Members and shingles of a family in one cell, and most cells that visitors go to unless shingles need more.
FAMILY, SHINGLES, MANY = 512, 1 << 20, 16
_HADAMARD = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(64)] for i in range(64)], np.float32)
_ORDER = np.random.Generator(np.random.PCG64(20240518)).permutation(BITS)


def set_prints(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """SimHashes of the sets that aren't empty: BITS / 64 words for each."""
    sizes = np.diff(offsets)[np.diff(offsets) > 0]
    out = np.zeros((len(sizes), BITS // 64), np.uint64)
    if not len(sizes):
        return out
    code = mix(h + np.uint64(3))
    slot, sign = (code >> np.uint64(53)).astype(np.int64), 1.0 - 2.0 * (code & np.uint64(1)).astype(np.float64)
    ends = np.append(0, np.cumsum(sizes))
    for k in range(0, len(sizes), 128):
        n = min(128, len(sizes) - k)
        some = slice(ends[k], ends[k + n])
        at = np.repeat(np.arange(n) * BITS, sizes[k : k + n]) + slot[some]
        sums = np.bincount(at, sign[some], n * BITS).astype(np.float32).reshape(n * BITS // 64, 64) @ _HADAMARD
        sums = _HADAMARD[: BITS // 64, : BITS // 64] @ sums.reshape(n, BITS // 64, 64)
        bits = np.ascontiguousarray((sums.reshape(n, BITS) > 0)[:, _ORDER])
        out[k : k + n] = np.packbits(bits, bitorder="little").view("<u8").reshape(n, -1)
    return out


def plan_tables(n: int) -> tuple[int, int]:
    """(tables, bits of each) for so many fingerprints; beyond 2**27 of them the buckets grow."""
    width = min(15, max(0, round(log2(max(n, 1) / BUCKET))))
    return (min(ceil(log(MISS) / log(1 - AGREE**width)), (BITS - CHECKED) // width) if width else 1), width


def _with_prints(docs: DataFrame, text_col: str, key: str, prints: str, shingle: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, h in shingle_sets(batch.column(at), shingle):
                some = np.flatnonzero(np.diff(offsets))
                ids = np.zeros(len(offsets) - 1, np.uint64)
                if len(some):
                    ids[some] = mix(np.add.reduceat(mix(h + np.uint64(1)), offsets[some]))
                added = [pa.array(ids.view(np.int64)), _lists(some, len(ids), set_prints(offsets, h))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(ids)).columns, *added], names=[*batch.schema.names, key, prints])

    plain = plain_names(docs)
    return plain.mapInArrow(add, f"{field_list(plain)}, `{key}` long, `{prints}` array<long>").toDF(*docs.columns, key, prints)


def _dealt(prints: DataFrame, tables: int, width: int) -> DataFrame:
    """(bucket, node, x, y, z, w): a row for each fingerprint and table with the bits to compare and those of the first tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)
            carried = [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(CHECKED // 64 + 1)]
            for t in range(tables):
                bucket = np.full(len(words), t << 32, np.int64)
                for j in range(width):
                    b = CHECKED + t * width + j
                    bucket |= ((words[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.int64) << j
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), *carried], names=["bucket", "node", "x", "y", "z", "w"])

    return prints.where(F.size("print") > 0).select("node", "print").mapInArrow(run, "bucket long, node long, x long, y long, z long, w long")


def _by_cells(rows: DataFrame, cell: int) -> GroupedData:
    """``rows`` (bucket, node, ...) grouped so that every two rows of a bucket meet; what is broadcast is a row for each large bucket."""
    large = rows.groupBy("bucket").count().where(F.col("count") > 2 * cell).select("bucket", F.ceil(F.col("count") / cell).alias("cells"))
    dealt = rows.join(F.broadcast(large), "bucket", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("node"), "cells")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    return dealt.drop("cells").groupBy("bucket", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))


def _close(words: list[np.ndarray], cell: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs i > j within the distance, of different cells if there are two, by blocks."""
    x, y, z = words
    mixed = len(cell) > 0 and cell.min() != cell.max()
    for i in range(0, len(x), 256):
        for j in range(0, min(i + 256, len(x)), 4096):
            d = np.bitwise_count(x[i : i + 256, None] ^ x[j : j + 4096]) + np.bitwise_count(y[i : i + 256, None] ^ y[j : j + 4096])
            a, b = np.nonzero(d <= distance)
            near = (a + i > b + j) & (d[a, b] + np.bitwise_count(z[a + i] ^ z[b + j]) <= distance)
            if mixed:
                near &= cell[a + i] != cell[b + j]
            if near.any():
                yield a[near] + i, b[near] + j


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, with the links (i, j) added to components that are given so."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _trees(distance: int, width: int):
    """Of one bucket (a, b): each member of a component of close fingerprints, but its smallest node, with that node.

    Pairs that meet in one of the first tables, as far as 64 bits tell, are left to that table's buckets.
    """

    def run(table: pa.Table) -> pa.Table:
        node = _column(table, "node")
        order = np.argsort(node)
        node, words = node[order], [_column(table, c)[order].view(np.uint64) for c in ("x", "y", "z")]
        first, root = _column(table, "w")[order].view(np.uint64), np.arange(len(node))
        earlier = min(_column(table, "bucket")[0] >> 32, 64 // width) if width else 0
        for i, j in _close(words, _column(table, "cell")[order], distance):
            differ, new = first[i] ^ first[j], np.ones(len(i), bool)
            for t in range(earlier):
                new &= (differ >> np.uint64(t * width)) & np.uint64((1 << width) - 1) != 0
            root = _unite(root, i[new], j[new])
        some = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[root[some]], "b": node[some]})

    return run


def _family_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, family, hashes) of texts (node, family, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, h in shingle_sets(batch.column(2), shingle):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(lists)).columns[:2], lists], names=["node", "family", "hashes"])

    return texts.mapInArrow(run, "node long, family long, hashes array<long>")


def _search(sizes: np.ndarray, ends: np.ndarray, ids: np.ndarray, sketch: np.ndarray, visits: np.ndarray | None, mask: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those linked to it) so that the links join the same classes as all pairs of sets with so many percent in common, of
    visitors and others only if ``visits`` is given."""
    left = np.arange(len(sizes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            n, m = np.minimum(sizes[i], sizes[left]), np.maximum(sizes[i], sizes[left])
            may = n * 100 >= m * percent
            if visits is not None:
                may &= visits[left] != visits[i]
            may[may] = np.bitwise_count(sketch[i] ^ sketch[left[may]]).sum(1, dtype=np.int64) * (100 + percent) <= (n + m)[may] * (100 - percent)
            if not may.any():
                continue
            mask[ids[ends[i] : ends[i + 1]]] = True
            at = left[may]
            stops = np.cumsum(sizes[at])
            both = np.add.reduceat(mask[ids[np.arange(stops[-1]) + np.repeat(ends[at] - stops + sizes[at], sizes[at])]], stops - sizes[at], dtype=np.int64)
            mask[ids[ends[i] : ends[i + 1]]] = False
            near = both * 100 >= (sizes[i] + sizes[at] - both) * percent
            if near.any():
                yield i, at[near]
                queue.extend(at[near])
                may[may] = near
                left = left[~may]


def _links(percent: int, by_visits: bool):
    """Links (a, b) in one group of families; ``by_visits``: only between visitors and others."""

    def run(table: pa.Table) -> pa.Table:
        family, node = _column(table, "family"), _column(table, "node")
        order = np.lexsort((node, family))
        family, node = family[order], node[order]
        lists = table.column("hashes").combine_chunks().take(pa.array(order))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sketch = set_sketches(ends, h)[:, 1:]
        visits = table.column("visits").combine_chunks().to_numpy(zero_copy_only=False)[order] if by_visits else None
        different, ids = np.unique(h, return_inverse=True)
        mask = np.zeros(len(different), bool)
        starts = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, e in zip(starts, np.append(starts[1:], len(node)), strict=True):
            for i, to in _search(sizes[k:e], ends[k : e + 1], ids, sketch[k:e], visits if visits is None else visits[k:e], mask, percent):
                left.append(np.full(len(to), node[k + i]))
                right.append(node[k + to])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _to_all(cells: str):
    return F.sequence(F.lit(0).cast("long"), F.col(cells) - 1)


def _family_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``sets`` (node, family, hashes), with the smallest node as the family, that give the classes of all pairs in a family."""
    held = F.size("hashes").cast("long")
    large = sets.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY), F.ceil(F.sum(held) / SHINGLES)).alias("cells")).where("cells > 1")
    large = materialize(large, "large-families")
    groups = max(1, (sets.agg(F.sum(held)).first()[0] or 0) // SHINGLES)
    dealt = sets.join(F.broadcast(large), "family", "left")
    one = F.array(F.when(F.col("cells").isNull(), F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.pmod(F.xxhash64("node"), "cells")))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("cells").isNotNull() & (F.col("node") == F.col("family")), _to_all("cells")).otherwise(one)))
    dealt = dealt.withColumn("large", F.when(F.col("cells").isNotNull(), F.col("family"))).drop("cells")
    found = materialize(dealt.groupBy("large", "cell").applyInArrow(_links(percent, False), "a long, b long"), "family-links")
    if large.isEmpty():
        return found
    members = sets.join(F.broadcast(large.select("family")), "family").select("node", "family", held.alias("held"))
    classes = members.join(connected_components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = materialize(classes, "family-classes")
    of = classes.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("held").alias("held")).groupBy("family")
    of = of.agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.max(F.struct("n", "root", "held")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    by_shingles, rest = F.ceil(F.col("held") / SHINGLES), F.col("held") - F.col("main.held")
    cells = F.greatest(F.lit(1).cast("long"), by_shingles, F.least(F.ceil(F.col("n") / FAMILY), F.lit(MANY)))
    split = of.select("family", F.col("main.root").alias("main"), cells.alias("cells"), F.greatest(F.lit(1).cast("long"), F.ceil(rest / SHINGLES)).alias("chunks"))
    open_ = classes.join(F.broadcast(split), "family").select("node", "main", "root", "cells", "chunks")
    open_ = materialize(sets.join(open_, "node"), "open-families")
    cell, chunk = F.pmod(F.xxhash64("node"), "cells"), F.pmod(F.xxhash64("node", F.lit(1)), "chunks")
    stay = open_.select("family", "node", "hashes", F.lit(False).alias("visits"), cell.alias("cell"), F.explode(_to_all("chunks")).alias("chunk"))
    visit = open_.where("root != main").select("family", "node", "hashes", F.lit(True).alias("visits"), F.explode(_to_all("cells")).alias("cell"), chunk.alias("chunk"))
    across = stay.unionByName(visit).groupBy("family", "cell", "chunk").applyInArrow(_links(percent, True), "a long, b long")
    return found.unionByName(materialize(across, "cross-links"))


def simhash_links(prints: DataFrame, texts_of, *, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node, print) that join the same classes as all confirmed candidate pairs.

    ``texts_of`` gives (node, family, text) for a table (node, family).
    """
    tables, width = plan_tables(prints.count())
    dealt = _dealt(prints, tables, width)
    trees = materialize(_by_cells(dealt, CELL).applyInArrow(_trees(DISTANCE, width), "a long, b long"), "close-trees")
    families = connected_components(trees).withColumnRenamed("root", "family")
    return _family_links(materialize(_family_sets(texts_of(families), shingle), "shingle-sets"), percent)


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: texts whose SimHashes are close and whose sets of word shingles have a Jaccard similarity of
    ``percent`` (80 or more) are linked, and of each class of linked texts the row with the smallest id stays (null ids last,
    then the first row), unchanged.

    Works with any further columns. Documents without words are one class.
    """
    if percent < 80:
        raise ValueError("the tables and the distance are made for similarities of 80 percent or more")
    key, fp, row = (free_name(docs, x) for x in ("set_key", "set_print", "row_number"))
    rows = materialize(_with_prints(docs.withColumn(row, F.monotonically_increasing_id()), text_col, key, fp, shingle), "set-prints")
    number = F.col(f"`{id_col}`")
    first = F.min(F.struct(number.isNull().alias("none"), number.alias("id"), F.col(row).alias("row")))
    prints = rows.groupBy(F.col(key).alias("node")).agg(first.alias("first"), F.first(fp).alias("print"))
    prints = materialize(prints, "distinct-prints")

    def texts_of(nodes: DataFrame) -> DataFrame:
        at = prints.join(nodes, "node").select("node", "family", F.col("first.row").alias("at"))
        return rows.select(F.col(row).alias("at"), F.col(f"`{text_col}`").alias("text")).join(at, "at").select("node", "family", "text")

    roots = connected_components(simhash_links(prints.select("node", "print"), texts_of, percent=percent, shingle=shingle))
    best = prints.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(best.select(F.col("first.row").alias(row)), row, "left_semi").select(*columns(docs))
