import hashlib
import random
import re

import numpy as np
import pytest

from voltrace.llm import simhash, substrings
from voltrace.llm.components import connected_components

from .fixtures import CLASHES, documents, no_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(texts, window=35):
    """(words, removed words) of each text by looking at all windows."""
    split = [WORD.findall(t or "") for t in texts]
    where = {}
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            where.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in split]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return split, gone


def check_repeats(found, given, window=35):
    split, gone = plain_repeats([r[1] for r in given], window)
    want = sorted((str(r[0]), len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for r, w, g in zip(given, split, gone, strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in found) == want
    assert all(sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in found)


@pytest.mark.parametrize(("chunk", "bucket"), [(1_000_000, 1_500_000), (3_000, 700)])
def test_repeats_match_all_windows(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", bucket)
    found = substrings.remove_repeats(documents(spark), rewrite_all=True).collect()
    check_repeats(found, rows())


def test_repeats_at_every_alignment(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2_000)
    rng = random.Random(3)
    given = []
    for i in range(60):
        w = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            n, at = rng.choice([20, 34, 35, 36, 50, 70]), rng.randrange(0, len(w) + 1)
            w[at:at] = [f"p{k}" for k in range(rng.randrange(5), n)]
        given.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    given += [(100, "x " * 36), (101, "y " * 35), (102, "y " * 34)]
    found = substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(5), rewrite_all=True).collect()
    check_repeats(found, given)


def test_structured_words_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    marks = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1024)) for k in (0, 1)]
    rest = [f"w{i}" for i in range(34)]
    given = [(0, " ".join([*rest, marks[0]])), (1, " ".join([*rest, marks[1]])), (2, " ".join([marks[0], *rest])), (3, " ".join([marks[0], *rest]))]
    runs = [" ".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(64)) for k in (0, 1)]
    given += [(4, runs[0]), (5, runs[1]), (6, runs[0][:80])]
    found = substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(3), rewrite_all=True).collect()
    check_repeats(found, given)
    assert [r["n_removed"] for r in sorted(found, key=lambda r: r["doc_id"])][:4] == [0, 0, 35, 35]


def test_a_footer_in_every_text_is_an_entry_a_message(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 3_000)
    footer = " ".join(f"f{i}" for i in range(50))
    given = [(i, f"own{i} words{i} {footer}") for i in range(400)]
    found = substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(2), rewrite_all=True).collect()
    assert {r["text"] for r in found} == {f"own{i} words{i}" for i in range(400)}


def test_unchanged_texts_stay_as_they_were(spark):
    docs = documents(spark)
    found = substrings.remove_repeats(docs, report=False)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    _, gone = plain_repeats([r[1] for r in rows()])
    kept = sorted(repr(r[1]) for r, g in zip(rows(), gone, strict=True) if not g)
    got = [repr(r["text"]) for r in found.collect()]
    assert all(got.count(t) >= kept.count(t) for t in kept) and len(got) == len(rows())


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(no_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(no_documents(spark).withColumnRenamed("lang", "N_words"))


def plain_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, prints, distance=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(prints)):
        r = root(i)
        least[r] = min((x for x in (least.get(r), ids[i]) if x is not None), default=None)
    return [least[root(i)] for i in range(len(prints))]


def test_near_duplicates_match_all_pairs(spark):
    given = [r for r in rows() if not r[1] or len(r[1]) < 50_000]
    found = simhash.near_duplicates(documents(spark).where("text IS NULL OR length(text) < 50000")).collect()
    prints = [plain_fingerprint(r[1]) for r in given]
    classes = plain_classes([r[0] for r in given], prints)
    want = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(given, prints, classes, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == want


def test_one_row_of_each_class_stays(spark):
    docs = documents(spark)
    found = simhash.drop_near_duplicates(docs)
    assert found.columns == docs.columns
    got = found.collect()
    prints = [simhash.fingerprint(r[1]) for r in rows()]
    classes = plain_classes([r[0] for r in rows()], prints)
    assert sorted(str(r["doc_id"]) for r in got) == sorted({str(c) for c in classes})
    assert all(r[c] is not None for r in got for c in CLASHES)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert simhash.drop_near_duplicates(no_documents(spark)).collect() == []


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_match_all_pairs_for_any_distance(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for k in range(1, 7):
            values.add(b ^ sum(1 << i for i in rng.sample(range(64), k)))
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    found = simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"), distance)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_thresholds_keep_the_pigeonhole_and_follow_the_histograms():
    for m in (1, 2, 3, 4):
        _, t = simhash.allocate([64 // m] * m, [1e6] * m, 1_000_000, 3)
        assert sum(t) == 3 - m + 1 and min(t) >= -1
    _, t = simhash.allocate([32, 32], [1e6, 1e14], 1_000_000, 3)
    assert t[0] > t[1]  # the part with heavy buckets is probed less far
    assert simhash.allocate([16] * 4, [1e9] * 4, 10**9, 3)[0] > simhash.allocate([16] * 4, [1e3] * 4, 10**3, 3)[0] - 1e-9


def test_bits_are_grouped_by_correlation():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 11] = bits[:, 3] ^ (rng.random(4000) < 0.05)
    groups = simhash.group_bits(4000, bits.T @ bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40, 11} <= set(g) for g in groups)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (7, 6), (None, 3), (2001, 2000)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)} | {2000: 2000, 2001: 2000}
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hashes_of_kept_words_follow_the_contract(spark):
    from pyspark.sql import functions as F

    given = [(1, "a  b\tc"), (2, None), (3, "")]
    found = substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string"), rewrite_all=True)
    got = {r["doc_id"]: r["h"] for r in found.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: hashlib.sha256(b"").hexdigest()}
