import hashlib
import random
import re

import pyarrow as pa
import pytest

from voltrace.llm import licenses, quality, sharding, urlfilter
from voltrace.llm._store import quoted
from voltrace.llm._words import chunks
from voltrace.llm.queries import URL_RULES

from .fixtures import CLASHES, documents, no_documents, rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else {g for g in grams if grams.count(g) > 1} if len(grams) < 1 else _often(grams)
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_upper": sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def _often(grams):
    from collections import Counter

    return {g for g, n in Counter(grams).items() if n > 1}


def plain_failures(m):
    return {r.name for r in quality.RULES if r.rejects(*(pa.array([m[x]]).to_numpy() for x in r.needs))[0]}


@pytest.mark.parametrize("most", [200, 1_000_000])
def test_measures_match_plain_counts(most):
    column = pa.array(texts(), pa.string())
    got = {name: [] for name in quality.MEASURES}
    for chunk in chunks(column.slice(0), most):
        for name, f in quality.MEASURES.items():
            got[name] += f(chunk).tolist()
    want = [plain_measures(t) for t in texts()]
    for name in quality.MEASURES:
        assert got[name] == [m[name] for m in want], name


def test_the_order_of_rules_never_changes_a_verdict():
    column = pa.array(texts(), pa.string())
    chunk = next(chunks(column))
    want = [bool(plain_failures(plain_measures(t))) for t in texts()]
    for seed in range(6):
        rules = list(quality.RULES)
        random.Random(seed).shuffle(rules)
        failed, _ = quality.cascade(chunk, tuple(rules))
        assert (failed >= 0).tolist() == want
        for f, t in zip(failed, texts(), strict=True):  # the first rule of the order that rejects it
            names = plain_failures(plain_measures(t))
            assert (rules[f].name if f >= 0 else None) == next((r.name for r in rules if r.name in names), None)


def test_rules_are_ordered_by_rejection_per_cost():
    some = ["good words in a line " * 20] * 5 + ["few"] * 95
    ordered = quality.order_rules(some)
    assert ordered[0].name == "few_words" and {r.name for r in ordered} == {r.name for r in quality.RULES}
    assert quality.order_rules([]) == quality.RULES


def test_quality_rows(spark):
    found = quality.apply_quality_rules(documents(spark), measures=tuple(quality.MEASURES)).collect()
    want = sorted((str(r[0]), *map(str, m.values()), str(not plain_failures(m))) for r in rows() for m in [plain_measures(r[1])])
    assert sorted((str(r["doc_id"]), *(str(r[f"quality_{m}"]) for m in quality.MEASURES), str(r["quality_kept"])) for r in found) == want
    assert all((r["quality_failed"] is None) == r["quality_kept"] for r in found)
    kept = quality.quality_filter(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == sum(w[-1] == "True" for w in want)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_structured_words_and_lines_are_told_apart():
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    given = [f"{one}\n{two}\n{one} x\n{two} x", " ".join([one, "x", "y", two, "x", "y"]), f"{one}\n{one}", "\n".join(["ab " * 100, "ab " * 99 + "ba "])]
    spaced = thue_morse(4096, "a ", "b ")
    given += [spaced, "\n".join([spaced, thue_morse(4096, "b ", "a ")])]
    chunk = next(chunks(pa.array(given)))
    for name in ("n_dup_lines", "n_repeat_words", "n_lines", "n_words"):
        assert quality.MEASURES[name](chunk).tolist() == [plain_measures(t)[name] for t in given], name


def test_equal_hashes_of_different_words_change_nothing(monkeypatch):
    from voltrace.llm import _words

    monkeypatch.setattr(_words, "span_hashes", lambda data, starts, ends: (ends - starts).astype("uint64") % 3)
    column = pa.array([t for t in texts() if not t or len(t) < 50_000], pa.string())
    chunk = next(chunks(column))
    for name in ("n_dup_lines", "n_repeat_words"):
        assert quality.MEASURES[name](chunk).tolist() == [plain_measures(t)[name] for t in column.to_pylist()], name


def test_the_sample_is_taken_from_all_partitions(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id long, text string").repartition(8)
    some = quality.sample_texts(docs, "text", 100, 50)
    assert len(some) == 100 == len(set(some)) and sorted(some) == sorted(quality.sample_texts(docs, "text", 100, 50))


def test_quality_of_nothing_and_clashes(spark):
    assert quality.apply_quality_rules(no_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        quality.apply_quality_rules(no_documents(spark).withColumnRenamed("lang", "quality_kept"))


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/7", "https://a.b.example.com/en/77?q=/en/", "http://notexample.com/en/7", "ftp://x.net/de/",
    "http://example.net/de/8#x", "http://sub.example.net/de/9", "http://org/es/1", "x://y.org/es", "http://a.com/en/://b.com/", "http://user@example.com/en/7", "http://example.com:80/en/7",
    "http://.com/en/", "http://com./en/", "http://münchen.net/de/ü", "a://\nb.com\n/en/\n", "http://" + "a." * 20_000 + "com/en/" + "x" * 50_000,
]


@pytest.mark.parametrize(("limit", "shapes"), [(100_000, 24), (100_000, 2), (0, 24)])
def test_url_rules_match_plain_search(spark, monkeypatch, limit, shapes):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    monkeypatch.setattr(urlfilter, "JOINED_SHAPES", shapes)
    rules = [*URL_RULES, ("com", "/en/", "allow"), ("b.example.com", "/", "block"), ("", "/x", "block"), ("net", "", "block"), ("ORG", "/es/1", "allow"), ("example.co", "m/en", "block"), ("a.com", "", "allow")]
    lowered = [(h.lower(), p, max(v for a, b, v in rules if a.lower() == h.lower() and b == p)) for h, p, _ in rules]
    given = [(i if i != 3 else None, u, *([i] * len(CLASHES))) for i, u in enumerate(URLS)] + [(1, URLS[5], *([0] * len(CLASHES)))] * 2
    pages = spark.createDataFrame(given, "page_id long, url string, " + ", ".join(f"{quoted(c)} long" for c in CLASHES)).repartition(3)
    found = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules))
    want = sorted((str(r[0]), *map(str, plain_verdict(r[1], lowered))) for r in given)
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in found.collect()) == want
    assert found.columns[: len(pages.columns)] == pages.columns


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(pages, urlfilter.rule_table(spark, URL_RULES)).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    no_rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urlfilter.filter_urls(some, no_rules).collect()] == [(1, "http://a.com/en/", "a.com", "/en/", None, "allow")]
    with pytest.raises(ValueError):
        urlfilter.filter_urls(some.withColumnRenamed("page_id", "Host"), no_rules)


def plain_scan(given):
    """n_words, places and found of each text: every key phrase looked for at every word."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in given]
    out = []
    for w in split:
        places = sorted((label, i) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        found = []
        for t in licenses.TEMPLATES:
            key = t.key.split()
            for i in range(len(w)):
                if w[i : i + len(key)] == key:
                    s = i - t.key_at
                    hits = sum(0 <= s + j < len(w) and w[s + j] == v for j, v in enumerate(t.words))
                    found.append((t.label, s, hits / len(t.words)))
        out.append((len(w), places, sorted(found)))
    return out


def test_license_scan_matches_plain_search(spark):
    extra = ["license version 3 " * 3, "gnu general public license version 2 and apache license version 2", "under the mit license under the mit license", "cc-by-nc", "the the the", "MIT LiKense"]
    given = [r[1] for r in rows()] + extra * 2 + [t.wording for t in licenses.TEMPLATES] + [f"x {t.wording[9:]} y {t.key} z" for t in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "doc_id long, text string, words long").repartition(3)
    found = sorted(licenses.scan_licenses(docs).collect(), key=lambda r: r["doc_id"])
    for r, (n, places, hits) in zip(found, plain_scan(given), strict=True):
        assert r["n_words"] == n
        assert sorted((p["label"], p["p"]) for p in r["places"]) == places
        assert sorted((p["label"], p["p"], p["share"]) for p in r["found"]) == hits
        base = {p[0] for p in places}
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | {h[0] for h in hits}))
        assert r["score"] == max((h[2] for h in hits), default=0.0)


GPL = "This work is licensed under the GNU General Public License, version 3."


@pytest.mark.parametrize(("held", "of"), [(1, 1), (4, 4), (3, 10), (10, 20), (19, 20)])
def test_a_notice_is_found_however_many_documents_hold_it(spark, held, of):
    given = [(i, GPL if i < held else "plain words") for i in range(of)]
    found = licenses.scan_licenses(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in found} == {i: ("gpl-3", 1.0) if i < held else ("", 0.0) for i in range(of)}


def test_planted_wordings_with_other_words_changed_are_found(spark):
    rng = random.Random(8)
    given = []
    for t in licenses.TEMPLATES * 4:
        words, key = t.words, range(t.key_at, t.key_at + len(t.key.split()))
        words = [w if i in key or rng.random() < 0.7 else rng.choice(["foo", "license", "the"]) for i, w in enumerate(words)]
        given.append((len(given), " ".join(f"w{rng.randrange(900)}" for _ in range(80)) + " " + rng.choice([", ", " ", "\n# "]).join(words).upper() + " tail", t.label))
    found = licenses.scan_licenses(spark.createDataFrame(given, "doc_id long, text string, planted string")).collect()
    assert [r for r in found if r["planted"] not in r["labels"].split(",")] == []


def test_a_file_of_many_notices_keeps_every_license(spark):
    text = " ".join(t.wording for t in licenses.TEMPLATES)
    given = [(0, text)] + [(i, "licensed under cc by 4 0 sa") for i in range(1, 9)]
    found = licenses.scan_licenses(spark.createDataFrame(given, "doc_id long, text string")).where("doc_id = 0").first()
    assert found["labels"] == ",".join(sorted({t.label for t in licenses.TEMPLATES})) and found["score"] == 1.0


def test_license_scan_of_nothing(spark):
    assert licenses.scan_licenses(no_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        licenses.scan_licenses(no_documents(spark).withColumnRenamed("lang", "labels"))


def test_lookup_table_is_fair_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = [table.count(i) for i in range(10)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009  # few slots beyond the lost shard's change hands
    order = names[::-1]
    assert [order[i] for i in sharding.fill_table(order, 1009)] == [names[i] for i in table]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 1000)


def test_placement(spark):
    import hashlib

    names = ["b", "a", "c"]
    table = sharding.fill_table(names, 101)
    found = sharding.assign_shards(documents(spark), names, size=101)
    assert found.columns == [*documents(spark).columns, "slot", "shard"]
    got = found.collect()
    assert len(got) == len(rows())
    for r in got:
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:12], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign_shards(no_documents(spark), names, size=101).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(documents(spark).withColumnRenamed("lang", "Slot"), names)


def test_lookup_table_matches_a_plain_fill():
    """Shards in name order take turns; each claims the next free slot of its preference list."""
    names, size = [f"shard-{i}" for i in range(7)], 211
    order = sorted(range(7), key=lambda i: names[i])
    lists = {}
    for i in order:
        digest = hashlib.md5(names[i].encode()).hexdigest()
        offset, step = int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1
        lists[i] = [(offset + j * step) % size for j in range(size)]
    assert all(sorted(p) == list(range(size)) for p in lists.values())
    want, at = [None] * size, dict.fromkeys(order, 0)
    while None in want:
        for i in order:
            while at[i] < size and want[lists[i][at[i]]] is not None:
                at[i] += 1
            if at[i] < size:
                want[lists[i][at[i]]] = i
    assert sharding.fill_table(names, size) == want
