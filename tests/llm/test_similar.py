import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from voltrace.llm import similar

from .fixtures import CLASHES, documents, no_documents, rows
from .test_dedup import WORD


def plain_set(text):
    w = [x.lower() if x.isascii() else x for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_kept(given):
    """Ids that stay when all pairs of (id, text) with a five-word Jaccard of 0.8 or more are linked."""
    sets, parent = [plain_set(t) for _, t in given], list(range(len(given)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                parent[root(i)] = root(j)
    best = {}
    for i, (key, _) in enumerate(given):
        best[root(i)] = min(best.get(root(i), key), key)
    return sorted(best.values())


def planted(rng, families=40):
    """(id, text): each family is a text and copies with a few words changed, of all similarities from 0.6 to 1."""
    out = []
    for f in range(families):
        base = [f"f{f}v{rng.randrange(10**6)}" for _ in range(300)]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 7, 9, 12):
            w = list(base)
            for at in rng.sample(range(300), changes):
                w[at] = f"n{rng.randrange(10**9)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_copies_of_similarity_08_and_more_leave_the_pipeline(spark, tmp_path):
    given = planted(random.Random(5))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, str(tmp_path)).collect()) == plain_kept(given)


def test_awkward_rows(spark):
    docs = documents(spark)
    found = similar.drop_similar(docs)
    assert found.columns == docs.columns
    got = found.collect()
    big = 2**62
    want = plain_kept([(big if r[0] is None else r[0], r[1]) for r in rows()])
    assert sorted(big if r["doc_id"] is None else r["doc_id"] for r in got) == want
    assert all(r[c] is not None for r in got for c in CLASHES)
    assert similar.drop_similar(no_documents(spark)).collect() == []


def test_bands_find_pairs_of_similarity_08():
    rng, texts = random.Random(1), []
    for _ in range(400):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        other = list(base)
        for at in range(3, 300, 46):  # 7 of 300 words: 261 of 331 shingles in common, 0.788
            other[at] = f"n{rng.randrange(10**9)}"
        texts += [" ".join(base), " ".join(other)]
    keys = [similar.set_keys(offsets, h)[2] for _, offsets, h in similar.shingle_sets(pa.array(texts), 5)]
    keys = np.concatenate(keys)
    assert (keys[::2] == keys[1::2]).any(1).mean() > 0.99


def test_sketches_never_exclude_a_similar_pair(spark):
    rng, texts = random.Random(2), []
    for _ in range(30):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([6, 40, 300, 3000]))]
        for changes in (0, 1, 2, 4, 8, 16):
            w = list(base)
            for at in rng.sample(range(len(base)), min(changes, len(base))):
                w[at] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(0, 3)]))
    parts = [(offsets, h) for _, offsets, h in similar.shingle_sets(pa.array(texts), 5)]
    sketches = np.concatenate([similar.set_sketches(*x) for x in parts])
    data = [(i, sketches[i].view(np.int64).tolist()) for i in range(len(texts))]
    table = spark.createDataFrame(data, "node long, sketch array<long>")
    x, y = table.select(F.col("node").alias("a"), F.col("sketch").alias("x")), table.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    kept = {tuple(r) for r in x.join(y, F.col("a") < F.col("b")).where(similar.may_be_similar(F.col("x"), F.col("y"), 80)).select("a", "b").collect()}
    sets = [set(h[a:b].tolist()) for offsets, h in parts for a, b in zip(offsets, offsets[1:], strict=False)]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    links = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(links) > 100 and links <= kept and len(kept) < len(pairs) // 4


def test_a_large_family_without_similar_heads(spark):
    """Copies with 1 to 8 of 200 words changed, or copies of such copies: some are similar to the first text alone, some to few others or to none."""
    rng = random.Random(8)
    base, texts = [f"v{rng.randrange(10**6)}" for _ in range(200)], []
    for _ in range(250):
        w = list(base if rng.random() < 0.8 or not texts else texts[rng.randrange(len(texts))].split())
        for at in rng.sample(range(200), rng.randrange(1, 9)):
            w[at] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    given = list(enumerate(texts))
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == plain_kept(given)


def test_cells_of_large_buckets_lose_no_pair(spark, monkeypatch):
    """The family above with buckets dealt over cells of 16 members."""
    monkeypatch.setattr(similar, "CELL", 16)
    test_a_large_family_without_similar_heads(spark)
