import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from voltrace.llm import near, similar

from .fixtures import CLASHES, documents, no_documents, rows
from .test_similar import plain_kept, planted


def family():
    """(id, text): copies with 1 to 8 of 200 words changed, or copies of such copies."""
    rng = random.Random(8)
    base, texts = [f"v{rng.randrange(10**6)}" for _ in range(200)], []
    for _ in range(250):
        w = list(base if rng.random() < 0.8 or not texts else texts[rng.randrange(len(texts))].split())
        for at in rng.sample(range(200), rng.randrange(1, 9)):
            w[at] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


def kept(spark, given):
    return sorted(r["doc_id"] for r in near.drop_near(spark.createDataFrame(given, "doc_id long, text string").repartition(5)).collect())


def test_the_pipeline_links_by_simhashes(spark, tmp_path, monkeypatch):
    """Near copies leave the stage through close SimHashes alone: where none are close they stay, though their sets are similar."""
    given = planted(random.Random(5), families=4)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, str(tmp_path)).collect()) == plain_kept(given)
    monkeypatch.setattr(near, "DISTANCE", -1)
    assert len(corpus_pipeline.simhash_dedup(spark, docs, str(tmp_path)).collect()) == len(given)


def test_prints_are_majorities_of_the_shingles_code_words():
    parts = list(similar.shingle_sets(pa.array(["a b c d e f g h", None, "a b", "b c d e f g h i j k"]), 5))
    for _, offsets, h in parts:
        single = near.set_prints(np.arange(len(h) + 1), h)
        bits = np.unpackbits(single.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        want = [bits[a:b].sum(0) * 2 > b - a for a, b in zip(offsets, offsets[1:], strict=False) if b > a]
        got = np.unpackbits(near.set_prints(offsets, h).view(np.uint8).reshape(len(want), -1), axis=1, bitorder="little")
        assert (got == np.array(want)).all()
        assert 0.45 < bits.mean() < 0.55


def test_tables_and_distance_find_pairs_of_similarity_08():
    rng, texts = random.Random(1), []
    for _ in range(400):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        other = list(base)
        for at in range(3, 300, 46):  # 7 of 300 words: 261 of 331 shingles in common, 0.788
            other[at] = f"n{rng.randrange(10**9)}"
        texts += [" ".join(base), " ".join(other)]
    prints = np.concatenate([near.set_prints(offsets, h) for _, offsets, h in similar.shingle_sets(pa.array(texts), 5)])
    differ = prints[::2] ^ prints[1::2]
    assert (np.bitwise_count(differ[:, : near.CHECKED // 64]).sum(1) <= near.DISTANCE).mean() > 0.99
    bits = np.unpackbits(differ.view(np.uint8).reshape(400, -1), axis=1, bitorder="little")[:, near.CHECKED :]
    for n in (100_000, 1_000_000, 100_000_000):
        tables, width = near.plan_tables(n)
        assert (bits[:, : tables * width].reshape(400, tables, width).sum(2) == 0).any(1).mean() > 0.99


def test_awkward_rows(spark):
    docs = documents(spark)
    found = near.drop_near(docs)
    assert found.columns == docs.columns
    got = found.collect()
    big = 2**62
    want = plain_kept([(big if r[0] is None else r[0], r[1]) for r in rows()])
    assert sorted(big if r["doc_id"] is None else r["doc_id"] for r in got) == want
    assert all(r[c] is not None for r in got for c in CLASHES)
    assert near.drop_near(no_documents(spark)).collect() == []


def test_many_small_tables_lose_no_class(spark, monkeypatch):
    given = planted(random.Random(6))
    monkeypatch.setattr(near, "BUCKET", 16)
    assert near.plan_tables(len(given))[0] > 10
    assert kept(spark, given) == plain_kept(given)


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    given = family()
    want = plain_kept(given)
    assert kept(spark, given) == want
    monkeypatch.setattr(near, "MANY", 0)
    monkeypatch.setattr(near, "CELL", 40)
    assert kept(spark, given) == want
    monkeypatch.setattr(near, "BUCKET", 32)
    assert kept(spark, given) == want


def loose():
    """(id, text): 150 texts of which hardly two are linked, though their similarity is just below 0.8."""
    rng = random.Random(9)
    base, texts = [f"v{rng.randrange(10**6)}" for _ in range(170)], []
    for _ in range(150):
        w = list(base)
        for at in (rng.randrange(5, 80), rng.randrange(90, 165)):
            w[at] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


def test_families_make_rows_by_members_not_by_pairs(spark, monkeypatch):
    given, made = loose()[:30], {}

    def counted(df, name, of=near.materialize):
        table = of(df, name)
        made[name] = table.count()
        return table

    monkeypatch.setattr(near, "materialize", counted)
    assert kept(spark, given) == plain_kept(given)
    assert made and max(made.values()) <= len(given), made


def test_large_families_in_cells_lose_no_class(spark, monkeypatch):
    given = [*family(), *((1000 + i, t) for i, t in loose())]
    monkeypatch.setattr(near, "FAMILY", 16)
    monkeypatch.setattr(near, "SHINGLES", 5000)
    assert kept(spark, given) == plain_kept(given)
