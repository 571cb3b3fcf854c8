"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries and document numbers.

A file holds, one after another: the magic, the ids (2 or 4 bytes each, little-endian), the sections of the boundary
sequence, the sections of the document-number sequence, the JSON footer, its length (4 bytes) and the magic again. The
footer comes last so that a file is written in one pass to stores without seek.

A non-decreasing sequence of n values up to u is coded with l = log2(u / n) low bits of each value packed together, and
the remaining high parts in unary, n ones and at most u / 2**l zeros: under 2 + l bits a value. Every SAMPLE-th one's
position in the unary part is kept as 32 bits, so that the i-th value is found by a jump and a short scan.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bound_batches, new_path, open_store
from ._tokens import packed_encoder, vocabulary

MAGIC = b"VTIDEF01"
SAMPLE = 512
#: Bytes of text in a file, about: so many, and more, up to a limit, where that gives too many files.
FILE_BYTES, MOST_FILES, MOST_FILE_BYTES = 16 << 20, 100_000, 512 << 20


def encode_sequence(values: np.ndarray) -> dict:
    """Elias-Fano code of a non-decreasing sequence of integers: {"n", "base", "low_bits", "low", "high", "samples"}."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if not n:
        return {"n": 0, "base": 0, "low_bits": 0, "low": b"", "high": b"", "samples": b""}
    base = int(values[0])
    rest = (values - base).astype(np.uint64)
    low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
    low = b""
    if low_bits:
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = b"".join(
            np.packbits(((rest[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
            for i in range(0, n, 65536)
        )  # 65536 values are a whole number of bytes
    ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) + 8) // 8, np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    return {"n": n, "base": base, "low_bits": low_bits, "low": low, "high": high.tobytes(), "samples": ones[::SAMPLE].astype("<u4").tobytes()}


class Sequence:
    """Random access to a coded sequence: s[i], and s.slice(i, j) as an array."""

    def __init__(self, code: dict):
        self.n, self.base, self.low_bits = code["n"], code["base"], code["low_bits"]
        self.low, self.high = np.frombuffer(code["low"], np.uint8), np.frombuffer(code["high"], np.uint8)
        self.samples = np.frombuffer(code["samples"], "<u4")

    def slice(self, i: int, j: int) -> np.ndarray:
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first = i // SAMPLE
        last = (j - 1) // SAMPLE + 1
        begin = int(self.samples[first]) >> 3
        end = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= int(self.samples[first])][i - first * SAMPLE : j - first * SAMPLE]
        value = (ones - np.arange(i, j)).astype(np.int64) << self.low_bits
        if self.low_bits:
            a, b = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
            value |= bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value + self.base

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class IdFileWriter:
    """Write one file under a name of its own, then rename it: a task that is run again replaces the file with the same bytes."""

    def __init__(self, path: str, id_bytes: int):
        self.fs, self.path = open_store(path)
        self.temp, self.id_bytes = f"{self.path}.{uuid.uuid4().hex}.tmp", id_bytes
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.ends, self.numbers, self.nulls, self.ids = array("q", [0]), array("q"), 0, 0

    def add(self, number: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit. Documents come in ascending order of number, nulls first."""
        if number is None:
            self.nulls += 1
        else:
            self.numbers.append(number)
        self.ids += len(ids) // 4
        self.ends.append(self.ids)
        self.out.write(ids if self.id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())

    def close(self) -> tuple[int, int]:
        at = len(MAGIC) + self.ids * self.id_bytes
        footer: dict = {"id_bytes": self.id_bytes, "docs": len(self.ends) - 1, "ids": self.ids, "null_numbers": self.nulls, "sequences": {}}
        for name, values in (("ends", self.ends), ("numbers", self.numbers)):
            code = encode_sequence(np.array(values, np.int64))
            meta = {k: code[k] for k in ("n", "base", "low_bits")}
            for part in ("low", "high", "samples"):
                meta[part] = [at, len(code[part])]
                self.out.write(code[part])
                at += len(code[part])
            footer["sequences"][name] = meta
        tail = json.dumps(footer).encode()
        self.out.write(tail + np.array([len(tail)], "<u4").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return footer["docs"], self.ids


class IdFile:
    """Read a file: its documents' numbers, places and ids, without reading ids that aren't asked for."""

    def __init__(self, path: str):
        fs, path = open_store(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} isn't a whole id file")
        length = int(np.frombuffer(tail[:4], "<u4")[0])
        self.footer = json.loads(self._at(size - len(MAGIC) - 4 - length, length))
        self.docs, self.id_bytes = self.footer["docs"], self.footer["id_bytes"]
        self.ends, self.numbers = (self._sequence(x) for x in ("ends", "numbers"))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _sequence(self, name: str) -> Sequence:
        meta = self.footer["sequences"][name]
        return Sequence(meta | {part: self._at(*meta[part]) for part in ("low", "high", "samples")})

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self._at(len(MAGIC) + start * self.id_bytes, (stop - start) * self.id_bytes)
        return np.frombuffer(raw, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def documents(self, block: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(number, start in this file, ids) of each document in order."""
        nulls = self.footer["null_numbers"]
        for i in range(0, self.docs, block):
            j = min(self.docs, i + block)
            ends = self.ends.slice(i, j + 1)
            numbers = [None] * max(0, min(j, nulls) - i) + self.numbers.slice(max(0, i - nulls), max(0, j - nulls)).tolist()
            step = 0
            while step < j - i:  # at most about 4 million ids, or one document, at a time
                until = max(step + 1, int(np.searchsorted(ends, ends[step] + 4_000_000, "right")) - 1)
                until = min(until, j - i)
                ids = self.ids(int(ends[step]), int(ends[until]))
                for k in range(step, until):
                    yield numbers[k], int(ends[k]), ids[ends[k] - ends[step] : ends[k + 1] - ends[step]]
                step = until


def write_id_files(
    docs: DataFrame,
    *,
    path: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[dict]:
    """Encode every text whole, append the end id, and write id files in ascending order of ``id_col``.

    Rows are dealt by ranges of (document number, place in the input), so a number that very many rows share is split
    over files. There are as many files as FILE_BYTES of text a file make, and at least one for each core. Null texts are empty texts: the end id alone. Null numbers come first; rows with equal numbers keep their
    input order. Returns the manifest in order: [{"path", "docs", "ids", "start"}], start being the ids in all files
    before. One entry per file, so its size is that of the file list. An empty table gives [].
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "ids")
    vocab = tokenizer or vocabulary()
    fs, local = open_store(path)
    fs.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = packed_encoder(vocab), np.array([end_id], "<u4").tobytes()
        width = 2 if max(end_id, encoder.tokenizer.get_vocab_size() - 1) < 2**16 else 4
        part, name, out = TaskContext.get().partitionId(), "", None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for number, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if out is None:
                        name = f"{path}/part-{part:06d}.ids"
                        out = IdFileWriter(name, width)
                    out.add(number, encoder.encode([text or ""])[0] + end)
        if out is not None:
            n, ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "docs": [n], "ids": [ids]})

    rows = docs.select(docs[id_col].cast("long").alias("number"), docs[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = -(-size // min(max(FILE_BYTES, -(-size // MOST_FILES)), MOST_FILE_BYTES))
    made = (
        rows.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(max(files, spark.sparkContext.defaultParallelism), F.col("number").asc_nulls_first(), "place")
        .sortWithinPartitions(F.col("number").asc_nulls_first(), "place")
        .select("number", "text")
        .mapInArrow(write, "part long, path string, docs long, ids long")
        .collect()
    )
    manifest, start = [], 0
    for r in sorted(made):
        manifest.append({"path": r["path"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    return manifest


def read_id_files(spark: SparkSession, manifest: list[dict], *, with_ids: bool = False) -> DataFrame:
    """The documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as
    little-endian unsigned 32-bit integers; with ``with_ids`` also those ids. An empty manifest gives no rows."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for number, start, ids in IdFile(row["path"]).documents():
                    raw = ids.tobytes()
                    rows.append((number, row["start"] + start, len(ids), zlib.crc32(raw), *([raw] if with_ids else ())))
                    held += len(raw) if with_ids else 64
                    if held > 8_000_000:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, schema)
