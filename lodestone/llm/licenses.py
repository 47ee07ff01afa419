"""License scans by a positional index of rare words.

A rule is a notice of a licence with its mandatory key phrase. It is found in a text at a place where at least `share` percent
of its words, the key phrase's all among them, stand at their relative positions. So of any p of a rule's positions at least
p less the number of words that may miss must agree on the place. The index holds, for each rule, two positions more than
words that may miss (or all), those with the words of highest IDF over the whole corpus. A file's words that the index has,
its rarest licence words, are looked up; their postings vote for places by relative position; a place with enough votes is
verified word by word. The result does not depend on the IDFs, the work does.

Document frequencies are counted of the rules' words alone, some two hundred, so the driver receives a bounded table.

Base phrases are found wherever their words stand consecutively.

Rows: a null or empty text has no words and no places; equal rows have a result each; an empty table gives none. Texts are
taken whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z in lower case; what is no word character as a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory key phrase.
RULES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "required by applicable law"),
    ("mit", "Released under the MIT License", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "Permission is hereby granted, free of charge"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "either version 2 of the License"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "either version 3 of the License"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Percent of a rule's words that must be in place.
SHARE = 80
PLACES = "array<struct<label:string,base:boolean,start:long,words:int,matched:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


@dataclass(frozen=True)
class Rule:
    label: str
    words: tuple[bytes, ...]
    #: Positions of the key phrase.
    key: range
    #: How many words may miss.
    missing: int

    @staticmethod
    def of(label: str, notice: str, phrase: str, share: int) -> Rule:
        words, key = tuple(words_of(notice)), words_of(phrase)
        at = next((i for i in range(len(words)) if list(words[i : i + len(key)]) == key), None)
        if not key or at is None:
            raise ValueError(f"a rule of {label} lacks its key phrase")
        return Rule(label, words, range(at, at + len(key)), len(words) * (100 - share) // 100)


def rules_of(rules: list[tuple[str, str, str]], share: int) -> list[Rule]:
    if not 1 <= share <= 100:
        raise ValueError("share is a percentage from 1")
    return [Rule.of(*r, share) for r in rules]


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of texts, and of those with each word of a bounded vocabulary; each task sends one row a word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0):
                found[b""] += 1
                found.update(vocabulary.intersection(text.as_buffer().to_pybytes().translate(_TABLE).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return found.pop(b"", 0), found


def index(rules: list[Rule], total: int, df: dict[bytes, int]) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
    """Postings (rule, position) of each rule's positions of highest IDF, and the votes that a place of a rule needs."""
    postings, votes = defaultdict(list), []
    for k, rule in enumerate(rules):
        idf = [math.log((total + 1) / (df.get(w, 0) + 1)) for w in rule.words]
        rare = sorted(range(len(idf)), key=lambda p: (-idf[p], p))[: rule.missing + 2]
        votes.append(len(rare) - rule.missing)
        for p in rare:
            postings[rule.words[p]].append((k, p))
    return dict(postings), votes


def places(words: list[bytes], rules: list[Rule], postings: dict[bytes, list[tuple[int, int]]], votes: list[int], base: dict[bytes, list[tuple[str, list[bytes]]]]) -> list[dict]:
    """The places of base phrases and rules in a text's words."""
    out, ballot = [], Counter()
    for i, w in enumerate(words):
        if w in base:
            for label, phrase in base[w]:
                if words[i : i + len(phrase)] == phrase:
                    out.append({"label": label, "base": True, "start": i, "words": len(phrase), "matched": len(phrase)})
        if w in postings:
            for k, p in postings[w]:
                ballot[k, i - p] += 1
    for (k, at), n in ballot.items():
        if n < votes[k]:
            continue
        rule = rules[k]
        if any(not 0 <= at + p < len(words) or words[at + p] != rule.words[p] for p in rule.key):
            continue
        matched = sum(0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(rule.words))
        if len(rule.words) - matched <= rule.missing:
            out.append({"label": rule.label, "base": False, "start": at, "words": len(rule.words), "matched": matched})
    return sorted(out, key=lambda x: (x["start"], not x["base"], x["label"]))


def scan(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES, base: dict[str, str] = BASE, share: int = SHARE, id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, places): for each row of docs its number of words and its places (PLACES) of base phrases and rules, by start; start counts words from 0
    and is negative where a rule's first words are missing before the text."""
    known = rules_of(rules, share)
    postings, votes = index(known, *document_frequencies(docs, frozenset(w for r in known for w in r.words)))
    first = defaultdict(list)
    for phrase, label in base.items():
        first[words_of(phrase)[0]].append((label, words_of(phrase)))
    first = dict(first)
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("matched", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for t in b.column(1):
                words = t.as_buffer().to_pybytes().translate(_TABLE).split() if t.is_valid else []
                counts.append(len(words))
                found.append(places(words, known, postings, votes, first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "places"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, places {PLACES}")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): counts and labels of `scan`. The score is the largest
    share of words in place of any rule or base phrase found, 0 without one."""
    rows = scan(docs, **options)
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    share = F.array_max(F.transform("places", lambda x: x["matched"].cast("double") / x["words"].cast("double")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    def values() -> Iterator[str]:
        for k, r in enumerate(rules_of(RULES, SHARE)):
            for p, w in enumerate(r.words):
                yield f"({k}, '{r.label}', false, {p}, '{w.decode()}', {'true' if p in r.key else 'false'}, {len(r.words)}, {len(r.words) - r.missing})"
        for k, (phrase, label) in enumerate(BASE.items()):
            words = words_of(phrase)
            for p, w in enumerate(words):
                yield f"({-1 - k}, '{label}', true, {p}, '{w.decode()}', true, {len(words)}, {len(words)})"

    return rf"""
WITH rules AS (
  SELECT *, sum(CASE WHEN key THEN 1 ELSE 0 END) OVER (PARTITION BY rule) AS keys
  FROM (VALUES {", ".join(values())}) AS t(rule, label, base, p, word, key, words, least)
), numbered AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tokens AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM numbered
), places AS (
  SELECT r, rule, i - p AS place, any_value(label) AS label, bool_and(base) AS base, count(*) AS matched, any_value(words) AS words
  FROM tokens JOIN rules USING (word) GROUP BY r, rule, i - p
  HAVING count(*) >= any_value(least) AND count(*) FILTER (key) = any_value(keys)
)
SELECT n.doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(matched::DOUBLE / words::DOUBLE), 0.0) AS score
FROM numbered n LEFT JOIN places p USING (r) GROUP BY r, n.doc_id
"""


ORACLE = _oracle()
