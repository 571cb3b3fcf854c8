"""Exact substring dedup: fixed-block anchors probed by every rolling window, hits extended to whole repeated windows.

Texts are read as words. Each text is cut into non-overlapping reference blocks of BLOCK = (window + 1) // 2 words, so
that any stretch of ``window`` words holds a whole block; all blocks are indexed and every rolling window of BLOCK words
of every text probes the index. A stretch that repeats elsewhere therefore has, in each copy, a window that hits a block
of the other. Around each hit the match is extended to all stretches of ``window`` words that hold it, and the stretches
are compared among the hits alone: by 96 bits of the BLAKE2b digest of their words.

Neither step forms pairs: a block in a thousand texts is a thousand entries, not a million. Texts are read in messages
of some chunks. A message sends each different window once, with the marks "is a block" and "stands twice here", so a
footer that stands in very many texts is one entry for each message and not for each text. Index and probes meet in
buckets by hash, each holding a bounded number of windows whatever the size of the corpus. Windows go there as 4 bytes
and two bits (a filter: false hits cost a comparison, no hit is lost), and one bit comes back for each.

The texts are packed once into files in shared storage, and the steps pass on the places of chunks in them: what Spark
shuffles are hashes, bits and places, never texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import BlobWriter, bound_batches, field_list, materialize, new_path, open_store, plain_names, read_blob
from ._words import Chunk, chunks

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 1_000_000
#: Windows in a bucket, about: so many, and more, as far as a worker's memory allows, where that gives too many buckets.
BUCKET_WINDOWS, MOST_BUCKETS, MOST_BUCKET_WINDOWS = 1_500_000, 100_000, 24_000_000
#: Chunks in a message: at least so many, and more, as far as a worker's memory allows, where a corpus has so many
#: buckets that a row would hold few windows.
MESSAGE_CHUNKS, MOST_MESSAGE_CHUNKS, ROW_WINDOWS = 8, 48, 8


def _pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack_rows(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _buckets(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) for each bucket that some of the ascending hashes fall into, by their upper 32 bits."""
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j > i:
            yield int(bucket[i]), slice(i, j)


def _marked(h: np.ndarray, buckets: int, marks: dict[int, bytes]) -> np.ndarray:
    """For each of the ascending hashes that were sent whether its bit came back as 1."""
    out = np.zeros(len(h), bool)
    for bucket, some in _buckets(h, buckets) if marks else ():
        if bucket in marks:
            out[some] = np.unpackbits(np.frombuffer(marks[bucket], np.uint8), count=some.stop - some.start)
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class _Probes:
    """A chunk's rolling windows: their first words, hashes, and which are reference blocks."""

    def __init__(self, chunk: Chunk, window: int):
        self.chunk, self.window, self.block = chunk, window, (window + 1) // 2
        long = np.repeat(chunk.n_words >= window, chunk.n_words)
        at = chunk.windows(self.block)
        self.at = at[long[at]]
        first = np.repeat(chunk.word_offsets[:-1], chunk.n_words)
        self.is_block = (self.at - first[self.at]) % self.block == 0
        self.hashes = chunk.window_hashes(self.block, self.at)

    def stretches(self, hits: np.ndarray) -> np.ndarray:
        """First words of the stretches of ``window`` words that hold a window whose hash is among the ascending ``hits``."""
        if not len(hits):
            return np.zeros(0, np.int64)
        found = self.at[hits[np.minimum(np.searchsorted(hits, self.hashes), len(hits) - 1)] == self.hashes]
        reach = np.zeros(len(self.chunk.starts) + 1, np.int64)
        np.add.at(reach, np.maximum(found - (self.window - self.block), 0), 1)
        np.add.at(reach, found + 1, -1)
        whole = np.zeros(len(reach) - 1, bool)
        whole[self.chunk.windows(self.window)] = True
        return np.flatnonzero((np.cumsum(reach[:-1]) > 0) & whole)


def _windows_once(parts: list[_Probes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes, ascending; whether one is a block; whether it stands twice) over all windows of a message."""
    h = np.concatenate([p.hashes for p in parts])
    block = np.concatenate([p.is_block for p in parts])
    order = np.argsort(h)
    h, block = h[order], block[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.logical_or.reduceat(block, starts) if len(h) else block, np.diff(np.append(starts, len(h))) > 1


def _digests_once(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different digests as 8 and 4 bytes, ascending; whether one stands twice; where each given digest is among them)."""
    high = np.ascontiguousarray(found[:, :8]).view(">u8").ravel().astype(np.uint64)
    low = np.ascontiguousarray(found[:, 8:]).view(">u4").ravel().astype(np.uint32)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    at = np.zeros(len(high), np.int64)
    at[order] = np.cumsum(new) - 1
    return high[starts], low[starts], np.diff(np.append(starts, len(high))) > 1, at


def _twice(order: np.ndarray) -> np.ndarray:
    return order[1:][order[1:] == order[:-1]]


def _among(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each key is among the ascending chosen ones."""
    return chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys if len(chosen) else np.zeros(len(keys), bool)


def _hit_blocks(table: pa.Table) -> pa.Table:
    """In one bucket: for each message a bit for each of its windows, 1 if it equals a block and stands twice or more."""
    keys = [np.frombuffer(x.as_buffer(), "<u4") for x in table["keys"]]
    blocks = [_flags(x, len(k)) for x, k in zip(table["blocks"].to_pylist(), keys, strict=True)]
    twice = [_flags(x, len(k)) for x, k in zip(table["twice"].to_pylist(), keys, strict=True)]
    often = np.unique(np.concatenate([_twice(np.sort(np.concatenate(keys))), *(k[t] for k, t in zip(keys, twice, strict=True))]))
    is_block = np.unique(np.concatenate([k[b] for k, b in zip(keys, blocks, strict=True)]))
    hits = often[_among(often, is_block)]
    return _marks(table, [_among(k, hits) for k in keys])


def _hit_stretches(table: pa.Table) -> pa.Table:
    """In one bucket: for each message a bit for each of its stretches, 1 if its words stand twice or more."""
    raw = [np.frombuffer(x.as_buffer(), np.dtype([("high", "<u8"), ("low", "<u4")])) for x in table["keys"]]
    high, low = (np.concatenate([r[c] for r in raw]) for c in ("high", "low"))
    often = np.concatenate([_flags(x, len(r)) for x, r in zip(table["twice"].to_pylist(), raw, strict=True)])
    order = np.lexsort((low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    run = np.concatenate([[0], np.cumsum(~same)])
    marked = np.zeros(int(run[-1]) + 1, bool)
    marked[run[1:][same]] = True
    marked[run[often[order]]] = True
    out = np.zeros(len(order), bool)
    out[order] = marked[run]
    return _marks(table, np.split(out, np.cumsum([len(r) for r in raw])[:-1]))


def _marks(table: pa.Table, masks: list[np.ndarray]) -> pa.Table:
    some = [i for i, m in enumerate(masks) if m.any()]
    return pa.table(
        {
            "message": table["message"].take(pa.array(some, pa.int64())),
            "bucket": table["bucket"].take(pa.array(some, pa.int64())),
            "mask": pa.array([_bits(masks[i]) for i in some], pa.binary()),
        }
    )


_PROBE, _MARK = "bucket long, message long, keys binary, blocks binary, twice binary", "message long, bucket long, mask binary"


def _by_message(marks: DataFrame, name: str) -> DataFrame:
    return marks.groupBy("message").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))


def _dict(marks: list | None) -> dict[int, bytes]:
    return {m["bucket"]: m["mask"] for m in marks or []}


def _rewrite(chunk: Chunk, gone: np.ndarray, rewrite_all: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of the texts: kept words joined by one space in texts that are rewritten, others as they were."""
    changed = np.ones(chunk.docs, bool) if rewrite_all else _per_doc(chunk, gone) > 0
    data = chunk.data.copy()
    keep = np.repeat(~changed, np.diff(chunk.offsets))
    words = np.flatnonzero(np.repeat(changed, chunk.n_words) & ~gone)
    doc = chunk.doc_of_word()[words]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[chunk.starts[words]] += 1
    np.subtract.at(edge, chunk.ends[words], 1)
    keep |= np.cumsum(edge[:-1], dtype=np.int32) > 0
    joins = chunk.ends[words[:-1][doc[1:] == doc[:-1]]]  # the space after each kept word with another one behind it
    data[joins] = 32
    keep[joins] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[chunk.offsets]


def _per_doc(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[chunk.word_offsets[1:]] - total[chunk.word_offsets[:-1]]


def _spans(chunk: Chunk, gone: np.ndarray) -> pa.ListArray:
    """Runs of removed words of each document, in its own word numbers, ends not included."""
    doc = chunk.doc_of_word()
    at = np.flatnonzero(gone)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1:]) if len(at) else at
    base = chunk.word_offsets[doc[first]]
    counts = np.bincount(doc[first], minlength=chunk.docs)
    values = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last + 1 - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = 35, rewrite_all: bool = False, report: bool = True) -> DataFrame:
    """docs without the words that a repeated stretch of ``window`` words covers.

    Words are runs of characters other than \\x20 and \\x09 to \\x0D. A stretch is ``window`` consecutive words of one
    text; every word is removed that a stretch covers whose words stand, in the same order, anywhere else too, the same
    text included. Stretches are judged on the input. Texts that lose words become their kept words joined by one space;
    other texts stay as they are, or are joined so too with ``rewrite_all``. With ``report`` the columns n_words,
    n_removed (long) and removed_spans (array of word ranges) are added; such names in docs are an error then.

    Null texts have no words and, if not rewritten, stay null; empty texts and texts shorter than a stretch lose
    nothing. Repeated rows are repeats of each other. An empty table stays empty. Other columns pass through.
    """
    names = ["n_words", "n_removed", "removed_spans"] if report else []
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; use report=False")
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    folder = new_path(docs.sparkSession, "texts")
    fs, local = open_store(folder)
    fs.create_dir(local, recursive=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, found = TaskContext.get().partitionId() << 32, None, []  # no two partitions share a message
        for batch in batches:
            for part in chunks(batch.column(at), CHUNK_BYTES):
                out = out or BlobWriter(folder)
                rows = pa.Table.from_batches([batch.slice(part.first, part.docs)]).combine_chunks().to_batches()[0]
                found.append((number, int(part.n_words.sum()), *out.add(_pack_rows(rows))))
                number += 1
        if out is not None:  # rows that tell the places of texts go out when the file is whole
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["chunk", "words", "path", "offset", "length"])

    texts = docs.withColumn(text_col, docs[text_col].cast("string")) if dict(docs.dtypes)[text_col] != "string" else docs
    texts = plain_names(texts)
    table = materialize(texts.mapInArrow(cut, "chunk long, words long, path string, offset long, length long"), "chunks")
    n_chunks, n_words = table.agg(F.count("*"), F.sum("words")).first()
    n_words = n_words or 0
    buckets = max(1, -(-n_words // min(max(BUCKET_WINDOWS, -(-n_words // MOST_BUCKETS)), max(BUCKET_WINDOWS, MOST_BUCKET_WINDOWS))))
    size = -(-ROW_WINDOWS * buckets * n_chunks // max(n_words, 1))  # chunks that give each bucket ROW_WINDOWS windows
    size = min(max(size, MESSAGE_CHUNKS), max(MOST_MESSAGE_CHUNKS, MESSAGE_CHUNKS))
    places = F.sort_array(F.collect_list(F.struct("chunk", "path", "offset", "length"))).alias("places")
    table = materialize(table.groupBy(F.expr(f"chunk div {size}").alias("message")).agg(places), "messages")
    # rows of places are small but stand for much work, so they are dealt by number and not by their bytes
    tasks = max(1, min(-(-n_chunks // size), 50_000))

    def read(batch: pa.RecordBatch, i: int) -> Iterator[tuple[pa.RecordBatch, _Probes]]:
        for place in batch.column("places")[i].as_py():
            rows = _unpack_rows(read_blob(place["path"], place["offset"], place["length"]))
            for chunk in chunks(rows.column(at), 1 << 62):
                yield rows, _Probes(chunk, window)

    def flush(rows: list) -> pa.RecordBatch:
        bucket, message, keys, blocks, twice = zip(*rows, strict=True)
        kinds = {"keys": keys, "blocks": blocks, "twice": twice}
        return pa.RecordBatch.from_pydict({"bucket": bucket, "message": message} | {k: pa.array(v, pa.binary()) for k, v in kinds.items()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, block, twice = _windows_once([p for _, p in read(batch, i)])
                low, number = h.astype("<u4"), batch.column("message")[i].as_py()
                if rows := [(b, number, low[x].tobytes(), _bits(block[x]), _bits(twice[x])) for b, x in _buckets(h, buckets)]:
                    yield flush(rows)

    def extended(batch: pa.RecordBatch, i: int) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(chunks of a message, their stretches to compare, their digests once, whether twice, where each is)."""
        parts = list(read(batch, i))
        h, _, _ = _windows_once([p for _, p in parts])
        hits = h[_marked(h, buckets, _dict(batch.column("hits")[i].as_py()))]
        found = [p.stretches(hits) for _, p in parts]
        return parts, found, *_digests_once(np.concatenate([p.chunk.word_digests(window, x) for (_, p), x in zip(parts, found, strict=True)]))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, high, low, twice, _ = extended(batch, i)
                keys = np.zeros(len(high), np.dtype([("high", "<u8"), ("low", "<u4")]))
                keys["high"], keys["low"], number = high, low, batch.column("message")[i].as_py()
                if rows := [(b, number, keys[x].tobytes(), b"", _bits(twice[x])) for b, x in _buckets(high, buckets)]:
                    yield flush(rows)

    def gone_words(batch: pa.RecordBatch, i: int) -> Iterator[tuple[pa.RecordBatch, Chunk, np.ndarray]]:
        repeats = _dict(batch.column("repeats")[i].as_py())
        if not repeats:
            for rows, part in read(batch, i):
                yield rows, part.chunk, np.zeros(len(part.chunk.starts), bool)
            return
        parts, found, high, _, _, where = extended(batch, i)
        sure, done = _marked(high, buckets, repeats)[where], 0
        for (rows, part), at_ in zip(parts, found, strict=True):
            hit, edge = at_[sure[done : done + len(at_)]], np.zeros(len(part.chunk.starts) + 1, np.int64)
            done += len(at_)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            yield rows, part.chunk, np.cumsum(edge[:-1]) > 0

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, chunk, gone in (x for batch in batches for i in range(batch.num_rows) for x in gone_words(batch, i)):
            data, offsets = _rewrite(chunk, gone, rewrite_all)
            text = pa.LargeStringArray.from_buffers(chunk.docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(rows.column(at).type)
            if rows.column(at).null_count and not rewrite_all:
                text = pa.array(np.arange(chunk.docs), mask=rows.column(at).is_null().to_numpy(zero_copy_only=False))
                text = pa.LargeStringArray.from_buffers(chunk.docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).take(text).cast(rows.column(at).type)
            columns = [c if k != at else text for k, c in enumerate(rows.columns)]
            if report:
                columns += [pa.array(chunk.n_words.astype(np.int64)), pa.array(_per_doc(chunk, gone).astype(np.int64)), _spans(chunk, gone)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *names])

    def meet(step: Callable, frame: DataFrame, compare: Callable) -> DataFrame:
        return frame.repartition(tasks).mapInArrow(step, _PROBE).groupBy("bucket").applyInArrow(compare, _MARK)

    hits = _by_message(materialize(meet(probe, table, _hit_blocks), "block-hits"), "hits")
    found = table.join(hits, "message")
    repeats = _by_message(materialize(meet(extend, found, _hit_stretches), "stretch-hits"), "repeats")
    schema = field_list(texts) + ", n_words long, n_removed long, removed_spans array<struct<start: long, end: long>>" * report
    return table.join(hits, "message", "left").join(repeats, "message", "left").repartition(tasks).mapInArrow(remove, schema).toDF(*docs.columns, *names)
