import re

import corpus_pipeline
from voltrace.llm import quality, simhash
from voltrace.llm.queries import ORACLE_SQL, QUERIES

from .fixtures import rows
from .test_dedup import plain_classes, plain_fingerprint, plain_repeats
from .test_rules_and_scans import plain_failures, plain_measures
from .test_search_and_mixing import plain_mix, token_rows
from .test_tokens_and_files import library_ids


def plain_pipeline(given):
    """(doc_id, length) of all token pieces, stage by stage in plain Python; rows are (doc_id, text, lang, source)."""
    kept = [r for r in given if not plain_failures(plain_measures(r[1]))]
    classes = plain_classes([r[0] for r in kept], [plain_fingerprint(r[1]) for r in kept])
    stay, seen = [], set()
    for r, c in zip(kept, classes, strict=True):
        if r[0] == c and c not in seen:
            seen.add(c)
            stay.append(r)
    split, gone = plain_repeats([r[1] for r in stay])
    cut = [(r[0], " ".join(x for i, x in enumerate(w) if i not in g) if g else r[1], r[2], r[3]) for r, w, g in zip(stay, split, gone, strict=True)]
    copies, _ = plain_mix(token_rows(cut), max_repeats=2.0, cover=True)
    out = []
    for r, c in zip(cut, copies, strict=True):
        n = len(library_ids(r[1], 1))
        out += [(r[0], s, min(2048, n - s)) for _ in range(c) for s in range(0, n, 2048)]
    return sorted(out)


def test_pipeline_matches_plain_stages(spark, tmp_path):
    given = [r[:4] for r in rows() if r[0] is not None]
    given = list({r[0]: r for r in given}.values())
    spark.createDataFrame([(*r, len(r[1] or "")) for r in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(given)
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in found) == want and len(want) > 10


def test_every_stage_but_the_last_returns_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c " * 60, "en", "s", 10), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_each_operator_has_one_query():
    assert sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(QUERIES)
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_defaults_are_the_documented_ones():
    assert simhash.BITS == 64 and {r.name for r in quality.RULES} >= {"few_words", "repeated_words"}
