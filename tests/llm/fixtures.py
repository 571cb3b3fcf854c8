"""Small documents with every awkward case: nulls, empty and very long texts, repeated rows, names that operators use inside."""

from __future__ import annotations

import random

from voltrace.llm._store import quoted

#: Columns that operators use inside under these or like names.
CLASHES = ["row_number", "fp", "key", "grp", "chunk", "words", "spots", "anchors", "start", "place", "bucket", "best", "page", "e", "n", "message", "digest", "rule_1_4", "a.b", "x`y.z"]


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def texts() -> list[str | None]:
    rng = random.Random(7)
    shared = " ".join(words(rng, 60))
    base = " ".join(words(rng, 120))
    near = base.replace(" ", "\n", 3) + " end"
    prose = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(12)]
    return [
        None,
        None,
        "",
        " \t\n",
        "one",
        "two words",
        base,
        base,
        near,
        f"{prose[0]} {shared} {prose[1]}",
        f"{prose[2]}\n{shared}\n{prose[3]}",
        " ".join(words(rng, 40, 5)),
        " ".join(words(rng, 30_000, 1_000_000)),
        "Licensed under the Apache License, Version 2.0. " + prose[4],
        "Released under the MIT License.",
        "LICENSED UNDER CC BY-NC 4.0 " + prose[5] + " under the mit license",
        "This work is licensed under the GNU General Public License, version 3.",
        "café Kelvin İ ß \U0001f600  em space " + prose[6],
        "$$$ ### " * 40 + prose[7],
        "SHOUTING " * 80,
        "\n".join(["same line here"] * 30),
        "a b\x1cc\x85d " + prose[8],
        "ends <|endoftext|> within <|endoftext|>a " + prose[7],
        *prose[9:],
    ]


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, clashing columns...): two rows have no id, some ids and rows repeat."""
    out = []
    for i, text in enumerate(texts()):
        out.append((None if i in (1, 4) else i * 3 - 5, text, None if i % 4 == 0 else "en", None if i == 5 else f"s{min(i, 3) if i < 20 else 0}", *([i] * len(CLASHES))))
    return [*out, out[6], out[6], out[9], (7_000_000_000, texts()[6], "de", "", *([1] * len(CLASHES)))]


SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{quoted(c)} long" for c in CLASHES)


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
