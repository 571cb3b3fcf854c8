"""License scans: a positional index of rare license words, intersected by relative position, confirmed by key phrases.

Every template is a wording with a mandatory key phrase. The index says for each template which words its key has, and
where. How many documents hold each of these words is counted over the whole corpus. For each template the places of the
rarest (highest-IDF) word of its key and those of the second rarest are looked up in the text; each place says where the
template would have to begin, and only the beginnings that both lists say are left. A beginning counts as found if the
key phrase stands there word for word. Rarity orders the look-ups and never leaves a template out, so every key phrase
that stands in a text is found. Built of DataFrame functions only; what goes to the driver is one count for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import free_name


@dataclass(frozen=True)
class Template:
    """A license's label, a usual wording, and the part of it that must be there."""

    label: str
    wording: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.wording.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: Wordings of public licenses and of their usual notices, as words.
TEMPLATES = (
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template(
        "apache-2",
        "the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    Template(
        "bsl-1",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software",
        "boost software license version 1",
    ),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc0", "released under cc0 1 0", "under cc0 1 0"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license as published by the free software foundation",
    ),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    Template(
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation",
    ),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("mit", "released under the mit license", "the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
)
#: (label, phrase) of plain phrase search.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES, _FOUND = "array<struct<label:string,p:int>>", "array<struct<label:string,p:int,share:double>>"


def license_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none. The Kelvin sign is no k."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def vocabulary(templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...]) -> list[str]:
    """The words that the index can be asked for: those of all key phrases."""
    return sorted({w for p in [*(t.key for t in templates), *(p for _, p in phrases)] for w in p.split()})


def _strings(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def scan_licenses(
    docs: DataFrame,
    *,
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    prefix: str = "",
) -> DataFrame:
    """docs without ``text_col``, with ``{prefix}`` n_words, places (array of phrase label and first word number), found
    (array of template label, first word number and the share of its words that stand there), base_labels and labels
    (strings, distinct, sorted, comma-joined) and score (the largest share, else 0).

    A template is found wherever its key phrase stands, however often the corpus holds its words; its first word number
    is below 0 where a text begins within the wording. Null and empty texts have no words, no labels and score 0.
    Repeated rows get equal results, an empty table stays empty. Names that are taken are an error; choose a prefix.
    """
    names = [prefix + x for x in ("n_words", "places", "found", "base_labels", "labels", "score")]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; choose a prefix")
    known = vocabulary(templates, phrases)
    words = license_words(docs[text_col])
    counts = docs.select(F.explode(F.array_intersect(words, _strings(known))).alias("w")).groupBy("w").count()
    held = {r["w"]: r["count"] for r in counts.collect()}  # a row for each license word

    def rarity(word: str) -> tuple[int, str]:
        return held.get(word, 0), word

    def posting(wanted: list[str]) -> list[int]:
        """Word numbers in a phrase of its rarest and its second rarest word (the same, if it has only one)."""
        order = sorted(range(len(wanted)), key=lambda j: (rarity(wanted[j]), j))
        other = next((j for j in order if wanted[j] != wanted[order[0]]), order[0])
        return [order[0], other]

    # a text with a key phrase holds the two words that are looked up; others need no look at positions
    sought = [t.key.split() for t in templates] + [p.split() for _, p in phrases]
    gate = sorted({w[posting(w)[0]] for w in sought})
    indexed = sorted({w[j] for w in sought for j in posting(w)})

    row_words, spots = (free_name(docs, x) for x in ("words", "spots"))
    w, at = F.col(row_words), F.col(spots)
    none = F.array().cast("array<struct<p:int,w:string>>")
    numbered = F.transform(w, lambda x, i: F.struct(i.alias("p"), x.alias("w")))
    seen = F.filter(numbered, lambda s: F.array_contains(_strings(indexed), s["w"]))
    frame = docs.withColumn(row_words, words).drop(text_col)
    frame = frame.withColumn(spots, F.when(F.arrays_overlap(w, _strings(gate)), seen).otherwise(none))

    def begins(wanted: list[str], before: int) -> Column:
        """Where a wording must begin whose key stands ``before`` words in: both postings agree, and the key stands there."""

        def said(j: int) -> Column:
            return F.transform(F.filter(at, lambda s: s["w"] == wanted[j]), lambda s: s["p"] - (j + before))

        one, two = posting(wanted)
        agreed = F.array_intersect(said(one), said(two))
        return F.filter(agreed, lambda p: (p + before >= 0) & (F.slice(w, F.greatest(p + before, F.lit(0)) + 1, len(wanted)) == _strings(wanted)))

    def share(t: Template, p: Column) -> Column:
        """The share of the template's words that stand where they should."""
        cut = F.greatest(-p, F.lit(0))  # words of the wording that would stand before the text
        mine = F.slice(w, F.greatest(p, F.lit(0)) + 1, F.lit(len(t.words)) - cut)
        theirs = F.slice(_strings(t.words), cut + 1, F.lit(len(t.words)))
        return F.size(F.filter(F.zip_with(mine, theirs, lambda a, b: a == b), lambda same: same)) / F.lit(float(len(t.words)))

    def phrase_places(label: str, phrase: str) -> Column:
        return F.transform(begins(phrase.split(), 0), lambda p: F.struct(F.lit(label).alias("label"), p.alias("p")))

    def template_places(t: Template) -> Column:
        return F.transform(begins(t.key.split(), t.key_at), lambda p: F.struct(F.lit(t.label).alias("label"), p.alias("p"), share(t, p).alias("share")))

    places = F.concat(F.array().cast(_PLACES), *(phrase_places(*x) for x in phrases))
    found = F.concat(F.array().cast(_FOUND), *(template_places(t) for t in templates))
    out = frame.withColumns(
        {
            names[0]: F.size(w).cast("long"),
            names[1]: F.when(F.size(at) > 0, places).otherwise(F.array().cast(_PLACES)),
            names[2]: F.when(F.size(at) > 0, found).otherwise(F.array().cast(_FOUND)),
        }
    )
    base = F.transform(F.col(names[1]), lambda s: s["label"])
    both = F.concat(base, F.transform(F.col(names[2]), lambda s: s["label"]))
    out = out.withColumns(
        {
            names[3]: F.array_join(F.array_sort(F.array_distinct(base)), ","),
            names[4]: F.array_join(F.array_sort(F.array_distinct(both)), ","),
            names[5]: F.coalesce(F.array_max(F.transform(F.col(names[2]), lambda s: s["share"])), F.lit(0.0)),
        }
    )
    return out.drop(row_words, spots)
