"""Licence scans by a positional index of the rarest words of licence templates, in SQL functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stored

# Words once A-Z are lower case: digits, a-z and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(LICENSE_WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    """A licence text or notice. Its key phrases must stand word for word; by default that is the whole text."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def key_places(self) -> list[tuple[int, list[str]]]:
        """Key phrases as ``(first word, words)``; each must occur in the text."""
        own = self.words
        places = []
        for key in self.keys or (self.text,):
            part = words_of(key)
            at = [i for i in range(len(own) - len(part) + 1) if own[i : i + len(part)] == part]
            if not part or not at:
                raise ValueError(f"key phrase {key!r} is not in the template of {self.label}")
            places.append((at[0], part))
        return places


# The notices that are looked for, and the phrases of them that may not differ.
TEMPLATES = (
    Template("mit", "under the MIT license", base=True),
    Template("apache-2", "Apache License, Version 2", base=True),
    Template("cc-by-nc", "CC BY-NC", base=True),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    Template("cc-by", "Creative Commons Attribution 4.0 International"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    Template("cc-by-nd", "CC BY-ND"),
    Template("gpl-3", "GNU General Public License, version 3"),
    Template("gpl-2", "GNU General Public License, version 2"),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("mpl-2", "Mozilla Public License, version 2"),
    Template("epl", "Eclipse Public License"),
    Template("boost-1", "Boost Software License, Version 1.0"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "are permitted provided that"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software",
        ("in no event will the authors be held liable",),
    ),
    Template("unlicense", "free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "All rights reserved"),
)


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Two letters beyond ASCII turn into ASCII ones in ``lower`` and take the slow way."""
    turned = text.contains("\u0130") | text.contains("\u212a")
    return F.when(turned, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _shorts(values: Sequence[int]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<smallint>")


def _index(templates: Sequence[Template], code: dict[str, int], frequency: dict[int, int]) -> Column:
    """The templates as an array of structs, each under its two words with the highest IDF and their places."""
    entries = []
    for t in templates:
        words = [code[w] for w in t.words]
        rare = sorted(set(words), key=lambda c: (frequency.get(c, 0), c))[:2]
        first, second = rare[0], rare[-1]
        keys = F.array(*(F.struct(F.lit(at).alias("at"), _shorts([code[w] for w in part]).alias("words")) for at, part in t.key_places))
        entries.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.lit(len(words)).alias("length"),
                F.lit(first).cast("long").alias("first"),
                F.lit(words.index(first)).cast("long").alias("first_at"),
                F.lit(second).cast("long").alias("second"),
                F.lit(words.index(second)).cast("long").alias("second_at"),
                _shorts(words).alias("words"),
                keys.alias("keys"),
            )
        )
    return F.array(*entries)


def license_places(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """Where licence templates stand in each text: doc_id, n_words, places array<(label, base, start, length, share)>.

    A text's words are looked up in the vocabulary of the templates; words of no template become 0, so a text is an
    array of small codes, stored once in the shared folder. Document frequencies of the vocabulary over all documents
    give the IDF. The index holds each template under its two words with the highest IDF (ties: the first in text
    order) and their places in it. A document looks up those of its words that the index has, subtracts the places,
    and the starts on which both postings of a template agree are its candidates. A candidate counts if all key
    phrases stand word for word at their places and at least ``coverage`` of the template's words stand at theirs
    (``share``). A template that is one key phrase cannot be missed, as each place of it holds both words.

    Everything is done within the row: nothing is shuffled but one count for each word of the vocabulary, and texts
    are read once. The driver gets one number for each word of the templates, which are a parameter.

    NULL counts as empty text; both have no word and no place. Repeated rows and rows without an id are rows of
    their own. Texts of any length are looked at as a whole. Other columns are ignored. An empty table gives no rows.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    code = {w: i for i, w in enumerate(vocabulary, 1)}
    known = F.array(*(F.lit(w) for w in vocabulary))
    words = F.regexp_extract_all(_lowered(F.coalesce(F.col("text"), F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))
    coded = F.transform(
        "words",
        lambda w: F.when(w.isin(vocabulary), F.array_position(known, w).cast("smallint")).otherwise(F.lit(0).cast("smallint")),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    rows = stored(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), coded.alias("codes")))

    counted = rows.select(F.explode(F.array_distinct("codes")).alias("code")).where("code > 0").groupBy("code").count()
    frequency = {r["code"]: r["count"] for r in counted.collect()}  # a row for each word of the templates
    index = _index(templates, code, frequency)
    leads = sorted({c for t in templates for c in sorted({code[w] for w in t.words}, key=lambda c: (frequency.get(c, 0), c))[:2]})

    # One number for each place of an indexed word: the code and, in the lower 32 bits, the place.
    place = F.transform("codes", lambda c, i: F.when(c.isin(leads), F.shiftleft(c.cast("long"), 32).bitwiseOR(i.cast("long"))))
    spots = F.filter(place, lambda p: p.isNotNull())

    def starts(word: Column, at: Column) -> Column:
        mine = F.filter("spots", lambda s: F.shiftright(s, 32) == word)
        return F.transform(mine, lambda s: s.bitwiseAND(F.lit((1 << 32) - 1)) - at)

    def places(t: Column) -> Column:
        agreed = F.array_intersect(starts(t["first"], t["first_at"]), starts(t["second"], t["second_at"]))
        inside = F.filter(agreed, lambda s: (s >= 0) & (s + t["length"] <= F.col("n_words")))

        def part(start: Column, length: Column) -> Column:
            return F.slice("codes", (start + 1).cast("int"), length.cast("int"))

        sure = F.filter(inside, lambda s: F.forall(t["keys"], lambda k: part(s + k["at"], F.size(k["words"])) == k["words"]))

        def share(s: Column) -> Column:
            same = F.zip_with(part(s, t["length"]), t["words"], lambda a, b: a == b)
            return F.size(F.filter(same, lambda x: x)) / t["length"]

        found = F.transform(
            sure,
            lambda s: F.struct(
                t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), t["length"].alias("length"), share(s).alias("share")
            ),
        )
        return F.filter(found, lambda f: f["share"] >= coverage)

    spotted = rows.withColumn("spots", spots)
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,length:int,share:double>>")
    every = F.when(F.size("spots") > 0, F.flatten(F.transform(index, places))).otherwise(none)
    return spotted.select("doc_id", "n_words", every.alias("places"))


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places: a row for each row.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word`` are the least and the greatest
    start among them. Labels are distinct, sorted and joined by commas; none are ''. The score is the greatest
    share of a template's words that stand at their places, 0 without a place. See ``license_places``.
    """
    found = license_places(docs, templates, coverage)
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform("base", lambda p: p["start"])

    def joined(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def license_sql(templates: Sequence[Template] = TEMPLATES, coverage: float = 0.8) -> str:
    """The digest columns of ``license_scan`` in DuckDB SQL, by trying every place of every template."""

    def text(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    entries = ",\n".join(
        f"({n}, '{t.label}', {t.base}, {text(t.words)}, "
        "[" + ", ".join(f"{{'at': {at}, 'words': {text(part)}}}" for at, part in t.key_places) + "])"
        for n, t in enumerate(templates)
    )
    return rf"""
    with d as (
        select row_number() over () as row, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') as words
        from documents
    ), t(n, label, base, words, keys) as (values {entries}),
    frequency as (select word, count(*) as df from (select distinct row, unnest(words) as word from d) group by word),
    own as (select distinct n, unnest(words) as word from t),
    rare as (
        select n, o.word, row_number() over (partition by n order by coalesce(df, 0), o.word) as r
        from own o left join frequency f on o.word = f.word
    ), leads as (
        select n, min(word) filter (r = 1) as a, coalesce(min(word) filter (r = 2), min(word) filter (r = 1)) as b
        from rare group by n
    ), places as (
        select d.row, t.label, t.base, t.words,
               unnest(list_filter(range(0, len(d.words) - len(t.words) + 1), lambda i:
                   d.words[i + list_position(t.words, a)] = a and d.words[i + list_position(t.words, b)] = b
                   and len(list_filter(t.keys, lambda k: d.words[i + k.at + 1 : i + k.at + len(k.words)] = k.words)) = len(t.keys)
               )) as start,
               d.words as own
        from d, t join leads using (n)
        where list_has_all(d.words, [a, b])
    ), shares as (
        select *, len(list_filter(range(1, len(words) + 1), lambda j: own[start + j] = words[j]))::double / len(words) as share
        from places
    ), found as (
        select row, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
               string_agg(distinct label, ',' order by label) filter (base) as base_labels,
               string_agg(distinct label, ',' order by label) as labels, max(share) as score
        from shares where share >= {coverage} group by row
    )
    select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
           last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
           coalesce(score, 0)::double as score
    from d left join found using (row)
    """
