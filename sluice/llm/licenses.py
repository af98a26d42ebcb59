"""License texts found by an exact set-similarity join against templates.

A text block is a run of lines without a blank line; its set holds the words
of the block. A template is found in a block when the block holds at least
``threshold`` of the template's distinct words. Words are ordered by the number
of documents that hold them, rare words first, counted over all documents. If
block and template meet the threshold, they share a word among the first
``|T| - need + 1`` of the template in that order (prefix filter), the block has
at least ``need`` words (length filter), and behind the first shared word both
have enough words left (positional filter). Pairs that pass are counted out.

Besides, phrases that name a license are found by their words in a row.

The templates are a parameter; their index has a checked size and is shipped
to the tasks in parts of at most ``INDEX_WORDS`` words. Documents are never shuffled, so no key can be hot.

Null or empty text: no words, no labels, score 0. Null ids and repeated rows
are kept. An empty table gives no rows. Other columns are unused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import records, slices, words
from sluice.llm.registry import query

#: Phrases that name a license, with its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licenses, as their texts give them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
           "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Labels of templates that are not named after theirs.
LABELS = {"gpl-notice": "gpl"}

THRESHOLD = 0.8
INDEX_WORDS = 1_000_000
BLANK = re.compile(rb"\n[ \t\r\f\v]*\n")
PLACES = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
FOUND = "array<struct<label: string, block: int, score: double>>"


class TemplateIndex:
    """Templates in the global order of words, with an inverted list of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float) -> None:
        self.threshold = threshold
        vocabulary = {w for t in templates.values() for w in words(t.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.need, self.prefixes = {}, {}, {}
        for name, text in templates.items():
            held = sorted({self.rank[w] for w in words(text.encode())})
            if held:
                self.sets[name], self.need[name] = held, ceil(round(threshold * len(held), 9))
                for at, word in enumerate(held[:len(held) - self.need[name] + 1]):
                    self.prefixes.setdefault(word, []).append((name, at))

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """Templates of which the block holds enough, with the share it holds."""
        ranks = sorted({self.rank[w] for w in self.rank.keys() & block}) if block else []
        seen = set()
        for at, word in enumerate(ranks):
            for name, place in self.prefixes.get(word, ()):
                need, held = self.need[name], self.sets[name]
                if name in seen or len(ranks) < need or min(len(ranks) - at, len(held) - place) < need:
                    continue
                seen.add(name)
                shared = len(set(ranks) & set(held))
                if shared >= need:
                    yield name, shared / len(held)


def document_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of the templates' vocabulary: a bounded result over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words(text)))
        yield records({"word": (list(seen), pa.binary()), "n": (list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.toLocalIterator()}


def phrase_places(found: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Word numbers at which a phrase begins, one entry per phrase and place, and their labels."""
    line = b" " + b" ".join(found) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            places.append(line.count(b" ", 0, at + 1) - 1)
            labels.add(label)
            at = line.find(b" " + phrase + b" ", at + 1)
    return places, labels


def _phrase_column(phrases: dict[str, str]):
    wanted = {" ".join(k.split()).lower().encode(): v for k, v in phrases.items()}

    @F.pandas_udf(PLACES)
    def places(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = words(text)
            at, labels = phrase_places(found, wanted)
            rows.append((len(found), len(at), min(at, default=None), max(at, default=None), sorted(labels)))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return places


def _template_column(index: TemplateIndex, labels: dict[str, str]):
    @F.pandas_udf(FOUND)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"label": labels.get(name, name), "block": i, "score": score} for i, block in enumerate(BLANK.split(text or b""))
                           for name, score in index.matches(words(block))] for text in texts], dtype=object)

    return matches


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         labels: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD,
         index_words: int = INDEX_WORDS) -> DataFrame:
    """Phrases and templates found in each document; ``found`` lists template label, block and share."""
    templates = TEMPLATES if templates is None else templates
    labels = LABELS if labels is None else labels
    parts, size = [{}], 0
    for name, text in templates.items():
        size += len(words(text.encode()))
        if size > index_words and parts[-1]:
            parts.append({})
            size = len(words(text.encode()))
        parts[-1][name] = text
    text, found = F.col(text_col).cast("binary"), []
    for part in parts:
        counts = document_counts(docs, text_col, {w for t in part.values() for w in words(t.encode())})
        found.append(_template_column(TemplateIndex(part, counts, threshold), labels)(text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _phrase_column(PHRASES if phrases is None else phrases)(text).alias("base"),
                       F.concat(*found).alias("found"))
    return rows.select("doc_id", "base.*", "found")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base_labels, transform(found, f -> f.label)))), ',') AS labels",
        "CASE WHEN n_base > 0 THEN 1.0D ELSE coalesce(array_max(transform(found, f -> f.score)), 0.0D) END AS score")
