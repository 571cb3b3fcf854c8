import zlib
from collections import defaultdict

import numpy as np
import pytest

from voltrace.llm import idfile, packing
from voltrace.llm._tokens import PackedEncoder, vocabulary

from .fixtures import documents, no_documents, rows, texts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def library_ids(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_memoised_ids_are_the_librarys():
    some = [t or "" for t in texts()] + ["<|endoftext|> it's we'll I'M  \n\n x ", "  lead", "trail  ", "1234 5²½", "ありが", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>", "x" * 5000 + " y " + "-" * 300]
    assert library().encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    encoder = PackedEncoder(vocabulary(), max_entries=500)  # small, so that generations change
    want = [library_ids(t, 0)[:-1].tobytes() for t in some]
    assert encoder.encode(some) == want
    assert encoder.encode(some[::-1]) == want[::-1]
    assert max(map(len, encoder.memo)) <= 64


def test_other_vocabularies_go_to_the_library():
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert PackedEncoder(path).encode(["Some Words here", ""]) == [np.array(t.encode("Some Words here", add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_first_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if b is None:
                free.append(100)
                b = len(free) - 1
            want[i] = (b, 100 - free[b])
            free[b] -= sizes[i]
        assert [(bins[i], offsets[i]) for i in range(n)] == [want[i] for i in range(n)]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_keeps_every_id_once(spark, capacity):
    found = packing.pack_documents(documents(spark), capacity=capacity, end_id=1, group_docs=8, with_ids=True).collect()
    by = defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4 * capacity
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    groups = defaultdict(set)
    for r in found:
        if r["doc_id"] in (-5, 1, 31):  # a document's pieces stay in one group
            groups[r["doc_id"]].add(r["sequence_id"] >> 32)
    assert all(len(g) == 1 for g in groups.values())
    want = sorted((str(r[0]), s // 4, zlib.crc32(ids[s : s + 4 * capacity])) for r in rows() for ids in [library_ids(r[1], 1).tobytes()] for s in range(0, len(ids), 4 * capacity))
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in found) == want


def test_packing_nothing(spark):
    assert packing.pack_documents(no_documents(spark)).collect() == []


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-7, -7, 0, 1, 10**12], list(range(0, 9000, 7)), [0] * 2000 + [2**40]])
def test_elias_fano_round_trip(values):
    code = idfile.encode_sequence(np.array(values, np.int64))
    s = idfile.Sequence(code)
    assert s.slice(0, len(values)).tolist() == values
    assert all(s[i] == values[i] for i in range(0, len(values), 97))
    assert s.slice(3, 700).tolist() == values[3:700]
    if len(values) > 1000 and values[-1] < 10**6:
        assert len(code["low"]) + len(code["high"]) + len(code["samples"]) < 8 * len(values) / 4


@pytest.mark.parametrize("width", [2, 4])
def test_id_file_round_trip(tmp_path, width):
    docs = [(None, b""), (-4, np.arange(5, dtype="<u4").tobytes()), (-4, b""), (9, np.arange(3000, dtype="<u4").tobytes())]
    w = idfile.IdFileWriter(f"file://{tmp_path}/x.ids", width)
    for number, ids in docs:
        w.add(number, ids)
    assert w.close() == (4, 3005)
    got = [(n, ids.astype("<u4").tobytes()) for n, _, ids in idfile.IdFile(f"file://{tmp_path}/x.ids").documents(block=2)]
    assert got == docs


def test_cut_off_file_is_refused(tmp_path):
    (tmp_path / "x.ids").write_bytes(b"VTIDEF01" + b"\x00" * 40)
    with pytest.raises(ValueError):
        idfile.IdFile(f"file://{tmp_path}/x.ids")


def test_files_hold_all_documents_in_order(spark):
    manifest = idfile.write_id_files(documents(spark), end_id=2)
    found = sorted(idfile.read_id_files(spark, manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((str(r[0]), len(x), zlib.crc32(x.tobytes())) for r in rows() for x in [library_ids(r[1], 2)])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == want


def test_files_of_nothing(spark):
    manifest = idfile.write_id_files(no_documents(spark))
    assert manifest == [] and idfile.read_id_files(spark, manifest).collect() == []
