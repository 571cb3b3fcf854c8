"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import bound_batches
from ._tokens import packed_encoder, vocabulary

#: Piece columns before packing; "ids" only on request.
_PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, grp long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece.

    Pieces are taken from the largest down, ties in the given order, and each goes to the lowest-numbered bin that has
    room. The tournament tree holds at each node the largest free capacity below it, so the first bin with room is found
    by one walk from the root. Sizes are 1 to capacity; an empty input gives empty arrays.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    full = int(np.count_nonzero(np.asarray(sizes) == capacity))  # each of these fills a bin of its own
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1
    while leaves < max(1, len(rest)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    for i in rest:
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def _mixed(*values: int) -> int:
    h = 0x9E3779B97F4A7C15
    for v in values:
        h = ((h ^ (v & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return (h * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF) >> 16


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, groups: int, seed: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Each document's pieces: as many whole sequences as it fills, then the rest."""
    encoder, end = packed_encoder(path), np.array([end_id], "<u4").tobytes()
    seen: Counter = Counter()  # repeated rows are dealt to different groups
    step = 4 * capacity
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            doc, start, length, crc, total, grp, ids = [], [], [], [], [], [], []
            for k, text in enumerate(part.column(1).to_pylist()):
                raw = memoryview(encoder.encode([text or ""])[0] + end)
                whole = zlib.crc32(raw)
                n = seen[whole] = seen[whole] + 1
                group = _mixed(seed, whole, n) % groups
                for s in range(0, len(raw), step):
                    piece = raw[s : s + step]
                    doc.append(k)
                    start.append(s // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
                    grp.append(group)
                    if with_ids:
                        ids.append(bytes(piece))
            columns = [part.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, grp))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
    group = table["grp"][0].as_py() if table.num_rows else 0
    table = table.drop_columns(["grp"])
    return table.append_column("sequence_id", pa.array(group * 2**32 + bins)).append_column("offset", pa.array(offsets))


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_docs: int = 4096,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Each text is encoded whole, an end id follows, and the ids are cut into pieces: every full stretch of ``capacity``
    ids, then the rest. Documents are dealt at random, with all their pieces, into groups of about ``group_docs`` and each
    group is packed by itself, so that no step sees more than a group. One row per piece: doc_id (with its own type), start (the
    document's ids before it), length, ids_crc32 of the ids as little-endian unsigned 32-bit integers, doc_tokens,
    sequence_id (group and bin), offset in the sequence; with ``with_ids`` also the ids themselves, so packed.

    Null and empty texts are one piece, the end id alone. Null or repeated doc_ids and repeated rows stay rows of their
    own. Ties in size are placed by doc_id, start and checksum. An empty table gives an empty result. Other columns,
    whatever their names, aren't read.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer or vocabulary()
    groups = max(1, -(-docs.count() // group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = _PIECES.format(kind=kind) + ", ids binary" * with_ids
    packed = pieces.replace(", grp long", "") + ", sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, path, end_id, capacity, groups, seed, with_ids)

    def pack(table: pa.Table) -> pa.Table:
        return _pack(table, capacity)

    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.mapInArrow(cut, pieces).groupBy("grp").applyInArrow(pack, packed)
