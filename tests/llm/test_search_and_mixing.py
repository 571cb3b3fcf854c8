import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from voltrace.llm import mixing, topk

from .fixtures import documents, no_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_top(vectors, queries, k, scale=256):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * Fraction(x)) for x in v]

    known = [(i, whole(v)) for i, v in vectors if i is not None]
    known = [(i, v) for i, v in known if v is not None]
    out = []
    for q in sorted(set(queries)):
        own = min((v for i, v in known if i == q), default=None)
        if own is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in known if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("candidates", "queries"), [(4096, 512), (16, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(1)
    given = [(int(i), [float(x) for x in rng.normal(0, 1 + i % 3, 20)]) for i in range(150)]
    given += [(200 + i, given[i][1]) for i in range(30)]  # ties
    given += [(300, None), (301, [None, 1.0]), (302, [float("nan")] * 20), (303, []), (304, [1.0] * 7), (305, [1e12, -7.3]), (310, None), (310, [0.5, -2e9]), (310, [float("nan")]), (320, [float("inf")]), (None, [1.0] * 20), (306, [0.0] * 20), (307, [-3.0] * 25), (308, [float("inf")])]
    given += [given[10]]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(4)
    asked = [i for i, v in given if i is not None and i % 10 == 0 and i != 300]
    found = topk.top_k_inner_products(frame, frame.where("vec_id % 10 = 0"), k=5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_top(given, asked, 5))


def test_fewer_candidates_than_k_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k_inner_products(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    none = frame.where("false")
    assert topk.top_k_inner_products(none, none).collect() == [] == topk.top_k_inner_products(frame, none).collect()


def test_large_components_stay_exact(spark):
    a = np.full((2, 3), topk.LARGEST, np.int64)
    a[1, 0] -= 1
    _, ids, score = topk.search_block(a[:1], np.array([7]), a, np.array([1, 2]), 2)
    assert ids.tolist() == [1, 2] and score.tolist() == [3 * topk.LARGEST**2, 3 * topk.LARGEST**2 - topk.LARGEST]
    rng = random.Random(4)
    sizes = [0.25, 1.0, 100.0], [0.25, 1e3, 1e6, -1e7, 3e7]  # queries, others: the best scores fit a long
    given = [(i, [rng.choice(sizes[i % 10 > 0]) * rng.random() for _ in range(6)]) for i in range(120)]
    given += [(500, [1e-3] * 6), (501, [-1e200, 0.0]), (502, [-1e305] * 2), (510, [1.5, 2.5, 2e6])]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(3)
    asked = [i for i, _ in given if i % 10 == 0]
    found = topk.top_k_inner_products(frame, frame.where("vec_id % 10 = 0"), k=5).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_top(given, asked, 5))


def test_a_best_score_beyond_a_long_is_an_error():
    with pytest.raises(OverflowError):
        topk.search_wide([[2**40]], np.array([1]), [[2**40], [1]], np.array([2, 3]), 2)
    which, ids, score = topk.search_wide([[2**40]], np.array([1]), [[-(2**40)], [1], [2]], np.array([2, 3, 4]), 2)
    assert ids.tolist() == [4, 3] and score.tolist() == [2**41, 2**40]


def test_first_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(2)
    for spread in (10, 2**28):
        a, b = rng.integers(-spread, spread, (7, 40)), rng.integers(-spread, spread, (300, 40))
        ids, query_ids = np.arange(300), np.arange(7)
        floors = topk.first_bounds(a, query_ids, b[::3], ids[::3], 4)
        got, want = topk.search_block(a, query_ids, b, ids, 4, floors), topk.search_block(a, query_ids, b, ids, 4)
        assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True)) and len(got[0]) == 28


def plain_mix(given, entropy=None, max_repeats=None, budget=None, cover=False, seed=5):
    """(copies of each row, weights): rows are (id, source, tokens)."""
    tokens = {}
    for _, s, n in given:
        tokens[s] = tokens.get(s, 0) + n
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def at(a):
        z = sum(p**a for p in share.values())
        w = {s: p**a / z for s, p in share.items()}
        return w, -sum(x * math.log(x) for x in w.values())

    size = float(budget or total)
    if max_repeats and not cover:
        size = min(size, max_repeats * total)

    def passes(a):
        w = at(a)[0]
        r = [w[s] / share[s] for s in share]
        return max(r) / min(r) if cover else max(r) * size / total

    def bisect(low, high, flat):
        for _ in range(32):
            mid = (low + high) / 2
            low, high = (mid, high) if flat(mid) else (low, mid)
        return high

    a = 1.0
    if entropy is not None:
        low, high = 0.0, 4.0
        while at(high)[1] > entropy * math.log(len(share)):
            low, high = high, 2 * high
        a = bisect(low, high, lambda x: at(x)[1] > entropy * math.log(len(share)))
    elif max_repeats is not None:
        a = 0.0
    if max_repeats is not None and a < 1 and passes(a) > max_repeats:
        a = bisect(a, 1.0, lambda x: passes(x) > max_repeats)
    w = at(a)[0]
    if cover:
        size = total / min(w[s] / share[s] for s in share)
    copies, key = {}, {}
    for s in tokens:
        if s not in share:
            copies[s], key[s] = 1, ""
            continue
        b = math.floor(w[s] * size + 0.5)
        copies[s], left = divmod(b, tokens[s])
        order = sorted((hashlib.md5(f"{seed}:{copies[s]}:{'' if i is None else i}".encode()).hexdigest(), n) for i, t, n in given if t == s)
        key[s] = ""
        for k in sorted({k for k, _ in order}) if left else []:
            if sum(n for j, n in order if j <= k) <= left:
                key[s] = k
    out = []
    for i, s, _ in given:
        own = hashlib.md5(f"{seed}:{copies[s]}:{'' if i is None else i}".encode()).hexdigest()
        out.append(copies[s] + (own <= key[s] and key[s] != ""))
    return out, w


def token_rows(given):
    return [(r[0], r[3] or "", len(WORD.findall(r[1] or ""))) for r in given]


@pytest.mark.parametrize("targets", [{}, {"entropy": 0.9}, {"entropy": 0.05}, {"entropy": 1.0}, {"max_repeats": 2.0}, {"max_repeats": 1.5, "cover": True}, {"budget": 5000}, {"entropy": 0.95, "max_repeats": 3.0, "budget": 70_000}])
def test_mix_matches_plain_bisection(spark, targets):
    found = mixing.mix_sources(documents(spark), expand=False, **targets).collect()
    copies, weights = plain_mix(token_rows(rows()), **targets)
    want = sorted((str(i), s, n, c, round(weights.get(s, 0.0), 9)) for (i, s, n), c in zip(token_rows(rows()), copies, strict=True))
    got = sorted((str(r["doc_id"]), r["source"] or "", r["mix_tokens"], r["mix_copies"], round(r["mix_weight"], 9)) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-6 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("block", [256, 3])
def test_budget_ends_in_the_right_block(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    rng = random.Random(block)
    given = [(i, "abc"[min(2, i % 7)], rng.randrange(0, 9)) for i in range(3000)]
    frame = spark.createDataFrame([(i, s, "x " * n) for i, s, n in given], "doc_id long, source string, text string").repartition(4)
    for targets in ({"entropy": 0.99}, {"budget": 5000}, {"budget": 1}):
        copies, _ = plain_mix(given, **targets)
        found = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(frame, expand=False, **targets).collect()}
        assert [found[i] for i in range(3000)] == copies


def test_expanded_rows_are_the_documents(spark):
    docs = documents(spark)
    found = mixing.mix_sources(docs, max_repeats=2.0, cover=True)
    assert found.columns == docs.columns
    copies, _ = plain_mix(token_rows(rows()), max_repeats=2.0, cover=True)
    assert min(copies) >= 1
    assert sorted(repr((r["doc_id"], r["source"])) for r in found.collect()) == sorted(repr((r[0], r[3])) for r, c in zip(rows(), copies, strict=True) for _ in range(c))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(no_documents(spark), entropy=0.9).collect() == []
    empty = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    assert sorted(r["doc_id"] for r in mixing.mix_sources(empty, entropy=0.9).collect()) == [1, 2]
    with pytest.raises(ValueError):
        mixing.mix_sources(empty.withColumnRenamed("source", "mix_copies"), source_col="mix_copies")


def test_targets_are_met_or_an_error(spark):
    def sources(*tokens):
        frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(tokens)], "source string, tokens long")
        return frame.selectExpr("source", "tokens", f"tokens / {float(sum(tokens))} AS share")

    def entropy(mix, *tokens):
        x = [(n / sum(tokens) / mix.top) ** mix.exponent / mix.total for n in tokens]
        return -sum(p * math.log(p) for p in x) / math.log(len(tokens))

    for target in (0.9, 0.3, 0.01):
        assert abs(entropy(mixing.find_mix(sources(40, 30, 30), entropy=target), 40, 30, 30) - target) < 1e-6
    for bad in ({"entropy": 0.0}, {"entropy": 1.1}, {"max_repeats": 0}, {"max_repeats": 0.5, "cover": True}, {"budget": 0}):
        with pytest.raises(ValueError):
            mixing.find_mix(sources(40, 30, 30), **bad)
    with pytest.raises(ValueError):  # two largest sources stay alike, so half the entropy is out of reach
        mixing.find_mix(sources(40, 40, 30), entropy=0.3)
    steep = mixing.find_mix(sources(40, 30, 30), entropy=0.3, max_repeats=1.2)
    assert steep.exponent > 1 and 1.199 < (0.4 / steep.top) ** steep.exponent / steep.total / 0.4 <= 1.2 + 1e-9
