"""Exact top-k inner products by columnar branch-and-bound.

Candidates lie in blocks in vertical layout: one contiguous column for each dimension. For a block of queries the scores
are accumulated over blocks of dimensions; after each, a candidate's score can grow at most by the product of the norms
of the query's and the candidate's remaining dimensions (their remaining mass), and candidates whose bound is below the
k-th best score known are taken out by compacting the columns. Dimensions are taken by the queries' mass, largest
first, and candidates by norm, so that bounds close early. What remains has its whole exact score.

Blocks of candidates and of queries are written once to shared storage; what Spark shuffles are the places of pairs of
blocks and at most k rows for each query and candidate block. All pairs start from the same first bounds: the exact
scores of the SEEDS candidates of largest norm in the whole table.

Vectors with a component beyond LARGEST after scaling lie in blocks of their own. Their scores are bounded in doubles and
those that may be among the best are computed in whole numbers of any size.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import BlobWriter, bound_batches, materialize, new_path, open_store, read_blob

#: Rows of a candidate block, at least, and its bytes, at most; queries of a query block; dimensions accumulated between
#: two bounds; candidates that give the first bounds.
CANDIDATES, BLOCK_BYTES, QUERIES, DIMENSIONS, SEEDS = 4096, 32 << 20, 2048, 16, 256
#: Whole numbers up to this have scores in 64 bits at any usual width.
LARGEST = 2**28


def whole(x: float, scale: int) -> int:
    """floor(scale * x), the product as a double where that is finite."""
    return math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x)


def vectors_of(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ordinary vectors, their components as floor(scale * x) in a zero-padded matrix of int64, rows of vectors
    with larger components, their components as they are); rows that take no part are in neither."""
    lengths = np.array([-1 if v is None else v for v in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten().cast(pa.float64())
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    values = np.where(missing, np.nan, flat.to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * scale)
        large = ~(np.abs(scaled) <= LARGEST)
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)

    def holds(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] > total[starts]

    valid = (lengths >= 0) & ~holds(~np.isfinite(values))
    out = []
    for rows, source, kind in ((np.flatnonzero(valid & ~holds(large)), scaled, np.int64), (np.flatnonzero(valid & holds(large)), values, np.float64)):
        matrix = np.zeros((len(rows), int(lengths[rows].max(initial=0))), kind)
        for n in np.unique(lengths[rows]):  # vectors of one length at a time
            some = np.flatnonzero(lengths[rows] == n)
            matrix[some, :n] = source[starts[rows[some]][:, None] + np.arange(n)].astype(kind)
        out += [rows, matrix]
    return tuple(out)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    left = np.arange(len(ids))
    if len(left) > k:
        left = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return left[np.lexsort((ids[left], -score[left]))[:k]]


def first_bounds(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best of its exact scores against the seeds, or -inf; ordinary vectors only."""
    width = max(queries.shape[1], seeds.shape[1], 1)
    q, c = (_padded(x, width).astype(np.float64) for x in (queries, seeds))
    score = q @ c.T
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width >= 2**53:  # rounded, so a little lower
        score -= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1) * width * 2.0**-50
    score = np.where(ids[None, :] == query_ids[:, None], -np.inf, score)
    return np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(queries), -np.inf)


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best candidates in the block that reach its first bound, if one
    is given; its own id doesn't count, ties go to smaller ids."""
    width = max(queries.shape[1], block.shape[1], 1)
    queries, block = _padded(queries, width), _padded(block, width)
    peak = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(block).max(initial=0)), 1) * width
    if peak >= 2**63:
        return search_wide([list(map(int, q)) for q in queries], query_ids, [list(map(int, c)) for c in block], ids, k)
    kind = np.float64 if peak < 2**53 else np.int64  # both exact
    order = np.argsort(-(queries.astype(np.float64) ** 2).sum(0), kind="stable")
    by_norm = np.argsort(-(block.astype(np.float64) ** 2).sum(1), kind="stable")
    q, columns, ids = queries[:, order].astype(kind), np.ascontiguousarray(block[by_norm][:, order].T.astype(kind)), ids[by_norm]
    q_left = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1])
    c_left = np.sqrt(np.cumsum((columns.astype(np.float64) ** 2)[::-1], 0)[::-1])
    found = ([], [], [])
    seed = min(len(ids), max(64, 4 * k))  # the block's candidates of largest norm may raise the bounds
    for i in range(len(q)):
        other = ids[:seed] != query_ids[i]
        exact = (q[i] @ columns[:, :seed])[other]
        floor = -np.inf if len(exact) < k else float(np.partition(exact, len(exact) - k)[len(exact) - k])
        floor = floor if floors is None else max(floor, floors[i])
        floor -= abs(floor) * 2.0**-50 if kind is np.int64 and np.isfinite(floor) else 0
        left = np.flatnonzero(ids != query_ids[i])
        score = np.zeros(len(left), kind)
        for d in range(0, width, DIMENSIONS):
            e = min(width, d + DIMENSIONS)
            score += q[i, d:e] @ (columns[d:e, left] if len(left) < len(ids) else columns[d:e])
            if e < width and len(left):
                bound = score + q_left[i, e] * c_left[e, left]
                bound += np.abs(bound) * 1e-9 + 1e-6
                stay = bound >= floor
                if stay.sum() < 0.9 * len(left):  # compact the survivors
                    left, score = left[stay], score[stay]
        sure = np.flatnonzero(score >= floor)
        left, score = left[sure], score[sure]
        best = _best(score, ids[left], k)
        found[0].append(np.full(len(best), i))
        found[1].append(ids[left[best]])
        found[2].append(score[best].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _as_doubles(rows: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows divided each by a power of two so that they are below 1, the powers), zero-padded."""
    powers = np.array([max((abs(x).bit_length() for x in r), default=0) for r in rows], np.int64)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        for j, x in enumerate(r):
            drop = max(0, abs(x).bit_length() - 64)
            out[i, j] = math.ldexp(float(x >> drop), int(drop - powers[i]))
    return out, powers


def search_wide(queries: list[list[int]], query_ids: np.ndarray, block: list[list[int]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search_block`` for whole numbers of any size: doubles say which candidates may be among the best, these are computed
    exactly. A score that a long doesn't hold is an error if it is among the k best."""
    width = max([1, *map(len, queries), *map(len, block)])
    q, q_power = _as_doubles(queries, width)
    c, c_power = _as_doubles(block, width)
    slack = np.linalg.norm(c, axis=1) * (width + 8) * 2.0**-50
    found: tuple[list, list, list] = ([], [], [])
    for i in range(len(queries)):
        near, error = c @ q[i], slack * np.linalg.norm(q[i]) + 1e-300
        top = int(c_power.max(initial=0))  # common power of two, so that scores compare
        scale = np.ldexp(1.0, np.maximum(c_power - top, -1000).astype(np.int32))
        low, high = (near - error) * scale, (near + error) * scale
        low, high = low - 1e-290, high + 1e-290
        other = np.flatnonzero(ids != query_ids[i])
        if len(other) > k:
            edge = np.partition(low[other], len(other) - k)[len(other) - k]
            other = other[high[other] >= edge]
        exact = sorted((-sum(a * b for a, b in zip(queries[i], block[j], strict=False)), int(ids[j])) for j in other)[:k]
        for score, number in exact:
            if not -(2**63) <= -score < 2**63:
                raise OverflowError(f"the score of query {query_ids[i]} and vector {number} doesn't fit a long")
            found[0].append(i)
            found[1].append(number)
            found[2].append(-score)
    return tuple(np.array(x, np.int64) for x in found)


def _dump(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, ids.astype("<i8"))
    np.save(out, matrix.astype("<i4") if matrix.dtype.kind == "i" else matrix.astype("<f8"))
    return out.getvalue()


def _load(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix); a matrix of doubles holds components that aren't scaled yet."""
    source = io.BytesIO(raw)
    ids, matrix = np.load(source), np.load(source)
    return ids, matrix.astype(np.int64) if matrix.dtype.kind == "i" else matrix


def _integers(matrix: np.ndarray, scale: int) -> list[list[int]]:
    return [[whole(x, scale) if matrix.dtype.kind == "f" else x for x in row] for row in matrix.tolist()]


def _blocks(frame: DataFrame, rows: int, scale: int, folder: str) -> DataFrame:
    """A row for each block of up to ``rows`` vectors that take part, written into ``folder``: number, path, offset, length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, places = TaskContext.get().partitionId() << 32, None, []
        held: dict[str, list] = {"i": [], "f": []}

        def flush(kind: str) -> None:
            nonlocal out
            if held[kind]:
                width = max(m.shape[1] for _, m in held[kind])
                out = out or BlobWriter(folder)
                blob = _dump(np.concatenate([i for i, _ in held[kind]]), np.concatenate([_padded(m, width) for _, m in held[kind]]))
                places.append((number + len(places), *out.add(blob)))
                held[kind] = []

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                plain, matrix, wide, large = vectors_of(part.column(1), scale)
                for kind, some, m in (("i", plain, matrix), ("f", wide, large)):
                    if len(some):
                        if sum(len(i) for i, _ in held[kind]) + len(some) > rows:
                            flush(kind)
                        held[kind].append((ids[some], m))
        flush("i")
        flush("f")
        if out is not None:  # rows that tell the places go out when the file is whole
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*places, strict=True)], names=["number", "path", "offset", "length"])

    return frame.mapInArrow(pack, "number long, path string, offset long, length long")


def top_k_inner_products(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """Each query's k candidates of largest inner product: query_id, rank (from 1), vec_id, score (long).

    Components become the whole numbers floor(scale * x); the score is exact. Candidates are all rows of ``vectors`` but
    those with the query's own id; ties go to the smaller id. Null ids, null vectors and vectors that hold a null or a
    non-finite component take no part; a score among the best that doesn't fit a long is an error. Shorter vectors count
    as padded by zeros; empty ones score zero. Rows that repeat an id are candidates each; a repeated query id is one
    query, of its first vector in value order among those that take part. Fewer than k candidates: all of them. Empty
    tables give no rows. Other columns aren't read.

    Each pair of a query block and a candidate block is one row of work; a pair gives at most k rows a query, which are
    merged by rank.
    """
    spark = vectors.sparkSession
    bound_batches(spark)

    def valid(frame: DataFrame) -> DataFrame:
        some = frame.select(frame[id_col].cast("long").alias("id"), frame[vector_col].cast("array<double>").alias("v")).where("id IS NOT NULL")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return some.where(F.col("v").isNotNull() & finite)

    rows, asked = valid(vectors), valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    folder = new_path(spark, "vectors")
    fs, local = open_store(folder)
    fs.create_dir(local, recursive=True)
    cores = spark.sparkContext.defaultParallelism
    number, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(min(-(-number // (4 * cores)), BLOCK_BYTES // (8 * max(width or 0, 1))), CANDIDATES)
    parts = max(1, -(-asked.count() // QUERIES))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    first = rows.where(F.forall("v", lambda x: F.abs(x * scale) < LARGEST)).orderBy(length.desc(), "id").limit(max(SEEDS, k))
    first = [(r["id"], r["v"]) for r in first.collect()]  # SEEDS vectors, whatever the table
    _, seeds, _, _ = vectors_of(pa.array([v for _, v in first], pa.list_(pa.float64())), scale)
    seed_ids = np.array([i for i, _ in first], np.int64)
    right = materialize(_blocks(rows.repartition(max(-(-number // size), 1)), size, scale, folder), "candidate-blocks")
    left = materialize(_blocks(asked.repartition(parts), 1 << 30, scale, folder), "query-blocks")
    place = F.struct("path", "offset", "length")
    # a partition of queries is one block, or two if it has larger components too
    left = left.select(((F.shiftright("number", 32) * 2) + F.col("number").bitwiseAND(1)).alias("q_number"), place.alias("q"))
    right = right.select(place.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(2 * parts - 1)).cast("array<long>")).alias("q_number"))
    pairs = materialize(right.join(left, "q_number").select("c", "q"), "pairs")
    pairs = pairs.repartition(min(max(pairs.count(), 1), 50_000))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}  # the last block of candidates and of queries read
        for batch in batches:
            for row in batch.to_pylist():
                for side in ("q", "c"):
                    if kept.get(side, (None,))[0] != row[side]:
                        kept[side] = row[side], _load(read_blob(row[side]["path"], row[side]["offset"], row[side]["length"]))
                (query_ids, a), (ids, b) = kept["q"][1], kept["c"][1]
                if a.dtype.kind == b.dtype.kind == "i":
                    floors = first_bounds(a, query_ids, seeds, seed_ids, k)
                    which, found, score = search_block(a, query_ids, b, ids, k, floors)
                else:
                    which, found, score = search_wide(_integers(a, scale), query_ids, _integers(b, scale), ids, k)
                yield pa.RecordBatch.from_pydict({"query_id": query_ids[which], "vec_id": found, "score": score})

    best = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
