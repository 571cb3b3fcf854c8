"""Words, word windows and their hashes over Arrow string columns, vectorised.

A word is a run of bytes other than \\x20 and \\x09 to \\x0D, so the boundaries can be found in the UTF-8 bytes. A
stretch of bytes is hashed 8 at a time by a non-linear mixer, a longer one by BLAKE2b; a window's hash is made of its
halves' in the same way, so no arrangement of few different words makes hashes meet. Hashes choose what to compare;
where equality counts, ``exact_ids`` and ``word_digests`` stand for the bytes themselves. No text is cut into Python
strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Stretches of more bytes than this are hashed and compared one by one.
LONG = 256
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEED, _LEFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _lanes(data: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there on as one integer; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, a function of these bytes alone."""
    lanes, n = _lanes(data), ends - starts
    h = mix(n.astype(np.uint64) + _SEED)
    some = slice(None)
    for at in range(0, LONG, 8):
        if at:
            some = np.flatnonzero((n > at) & (n <= LONG))
            if not len(some):
                break
        h[some] = mix((h[some] ^ (lanes[starts[some] + at] & _LANE[np.minimum(n[some] - at, 8)])) * _LEFT)
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(blake2b(whole[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def _same_bytes(data: np.ndarray, starts: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether each stretch of a has the bytes of its partner in b."""
    if not np.array_equal(n[a], n[b]):
        return False
    lanes, longest = _lanes(data), int(n[a].max(initial=0))
    for at in range(0, min(longest, LONG), 8):
        if at:
            some = (n[a] > at) & (n[a] <= LONG)
            a_, b_ = a[some], b[some]
        else:
            a_, b_ = a, b
        if ((lanes[starts[a_] + at] ^ lanes[starts[b_] + at]) & _LANE[np.minimum(n[a_] - at, 8)]).any():
            return False
    whole = memoryview(np.ascontiguousarray(data))
    big = np.flatnonzero(n[a] > LONG) if longest > LONG else ()
    return all(whole[starts[a[i]] : starts[a[i]] + n[a[i]]] == whole[starts[b[i]] : starts[b[i]] + n[b[i]]] for i in big)


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 for each stretch, equal where and only where the bytes are equal.

    Stretches are put together by hash and those of one hash compared byte by byte; should bytes differ under one hash,
    they are told apart by a dictionary of the bytes.
    """
    h, n = span_hashes(data, starts, ends), ends - starts
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    twin = np.flatnonzero(~new)
    ids = np.zeros(len(h), np.int64)
    if _same_bytes(data, starts, n, order[twin], order[twin - 1]):
        ids[order] = np.cumsum(new) - 1
        return ids
    known: dict[bytes, int] = {}
    whole = np.ascontiguousarray(data).tobytes()
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        ids[i] = known.setdefault(whole[s:e], len(known))
    return ids


class Chunk:
    """Some rows of a text column: bytes, document offsets and word boundaries."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.docs = len(offsets) - 1
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        space = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a word begins or ends before this byte
        if len(data):
            edge[1:-1] = space[1:] != space[:-1]
            edge[0], edge[-1] = not space[0], not space[-1]
            edge[inner] = False
        edges = np.flatnonzero(edge)
        del edge
        inside = np.unique(inner)
        opens = np.concatenate([edges[~space[np.minimum(edges, len(data) - 1)] & (edges < len(data))], inside[~space[inside]]])
        closes = np.concatenate([edges[(edges > 0) & ~space[edges - 1]], inside[~space[inside - 1]]]) if len(data) else edges
        self.starts, self.ends = (np.sort(x, kind="stable") if len(inside) else x for x in (opens, closes))
        #: words of document k: word_offsets[k] to word_offsets[k + 1]
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word_ids(self) -> np.ndarray:
        return exact_ids(self.data, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of k words of one document."""
        left = np.repeat(self.word_offsets[1:], self.n_words) - np.arange(len(self.starts))
        return np.flatnonzero(left >= k)

    def window_hashes(self, k: int, at: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the k words from each word of ``at`` on: runs of 1, 2, 4.. words by halves, then k by its binary digits."""
        runs = self.word_hashes() if words is None else words
        found, done, size = np.full(len(at), k, np.uint64), 0, 1
        while size <= k and len(at):
            if k & size:
                found = mix(found * _LEFT + runs[at + done])
                done += size
            if 2 * size <= k:
                runs = mix(runs[:-size] * _LEFT + runs[size:])
            size *= 2
        return found

    def word_digests(self, k: int, at: np.ndarray) -> np.ndarray:
        """12 bytes of the BLAKE2b digest of the k words from each word of ``at`` on, joined by one space."""
        sizes = self.ends - self.starts + 1
        begin = np.cumsum(sizes) - sizes
        keep = np.zeros(len(self.data) + 1, np.int8)
        keep[self.starts] += 1
        np.subtract.at(keep, self.ends, 1)  # a word may end where the next document's first one begins
        joined = np.full(int(sizes.sum()), 32, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[begin + sizes - 1] = False
        joined[inside] = self.data[np.cumsum(keep[:-1], dtype=np.int8) > 0]
        view = memoryview(joined)
        spans = zip(begin[at].tolist(), (begin[at + k - 1] + sizes[at + k - 1] - 1).tolist(), strict=True) if len(at) else ()
        return np.frombuffer(b"".join(blake2b(view[s:e], digest_size=12).digest() for s, e in spans), np.uint8).reshape(-1, 12)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.n_words)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1_000_000) -> Iterator[Chunk]:
    """The column's rows in order, in chunks of at most ``most`` bytes; a longer text is a chunk of its own."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(part):
            continue
        data, offsets = _strings(part)
        at = 0
        while at < len(part):
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), at + 8192, len(part))
            yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
