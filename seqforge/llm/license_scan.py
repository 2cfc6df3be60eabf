"""License scans with a positional index of rare words.

Each template (a notice, below) posts its words of highest inverse document frequency as (template, position): as many
as it takes that all its other words weigh less than ``least`` of it together, so that no alignment without one of them
can count. A file is looked up by all of these that it holds; postings of one template that agree on the difference
between file and template position make an alignment, whose matched share of the template's weight is its score; an
alignment counts when the score reaches ``least`` and every mandatory key phrase of the template stands in the file.
Document frequencies are counted over all files. Base phrases are found besides, in every file, and always stay.

Defined results: a null text counts as empty; a file without licence words has no label and the score 0; rows that
repeat get a row each; very long texts are scanned whole; an empty table gives no rows; extra columns pass through, and a
column of the added name is replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.text import arrow_column, byte_values, struct_array, words
from seqforge.session import ship_package

#: Phrases that give a label wherever they stand.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Well-known notices, as (label, notice, mandatory key phrases).
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
]
KIND = "struct<n_words: bigint, places: array<struct<label: string, start: bigint>>, labels: array<string>, score: double>"
_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])


class Index:
    """Postings of the templates' words, weighted by rarity in the corpus."""

    def __init__(self, df: dict[bytes, int], n_docs: int, templates=None, base=None, least: float = 0.6):
        self.templates = [(label, words(t.encode()), [b" " + b" ".join(words(k.encode())) + b" " for k in keys]) for label, t, keys in (TEMPLATES if templates is None else templates)]
        self.base = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in (BASE if base is None else base).items()]
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1e-6 for _, t, _ in self.templates for w in t}
        self.least = least
        self.total = [sum(self.idf[w] for w in t) for _, t, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, _) in enumerate(self.templates):
            starts = self.starts(k)
            for i, w in enumerate(t):
                if w in starts:
                    self.postings[w].append((k, i))
        self.postings = dict(self.postings)

    def starts(self, k: int) -> set[bytes]:
        """The rarest words of a template without which it can't reach ``least``; words that are in most files are
        seldom among them."""
        template, chosen = self.templates[k][1], set()
        rest, enough = self.total[k], self.least * self.total[k] * (1 - 1e-9)
        for w in sorted(set(template), key=lambda w: (-self.idf[w], w)):
            if rest < enough:
                break
            chosen.add(w)
            rest -= self.idf[w] * template.count(w)
        return chosen

    def aligned(self, text: list[bytes]) -> dict[int, float]:
        """The best alignment's score of each template that has a start word in the file."""
        if self.postings.keys().isdisjoint(text):
            return {}
        votes = {(k, i - j) for i, w in enumerate(text) if w in self.postings for k, j in self.postings[w]}
        best: dict[int, float] = {}
        for k, offset in votes:
            template = self.templates[k][1]
            low = max(0, -offset)
            here = text[offset + low : offset + len(template)]
            got = sum(self.idf[w] for w, v in zip(template[low:], here, strict=False) if w == v) / self.total[k]
            best[k] = max(best.get(k, 0.0), got)
        return best

    def scan(self, raw: bytes) -> tuple[int, list[tuple[str, int]], set[str], float]:
        """The number of words, the base places, the labels of base and method, and the best score."""
        text = words(raw)
        joined = b" " + b" ".join(text) + b" "
        places = []
        for phrase, label in self.base:
            at, seen, count = joined.find(phrase), 0, 0
            while at >= 0:
                count += joined.count(b" ", seen, at)
                seen = at
                places.append((label, count))
                at = joined.find(phrase, at + 1)
        labels, score = {label for label, _ in places}, 0.0
        for k, got in self.aligned(text).items():
            label, _, keys = self.templates[k]
            if got >= self.least and all(key in joined for key in keys):
                labels.add(label)
                score = max(score, got)
        return len(text), sorted(places, key=lambda x: (x[1], x[0])), labels, min(1.0, score)


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each word of the templates stands, over all texts, and the number of texts. Each task counts
    for itself; what is added up has a row for each task and word of the templates."""
    ship_package(docs.sparkSession)
    spoken = sorted(vocabulary)

    def count(batches):
        seen, n = Counter(), 0
        known = frozenset(spoken)
        for batch in batches:
            for text in byte_values(batch.column(0)):
                seen.update(known.intersection(words(text)))
                n += 1
        yield pa.record_batch([pa.array([w.decode() for w in seen] + [None], pa.string()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = {r[0]: r[1] for r in rows}
    n_docs = counts.pop(None, 0)
    return {w.encode(): n for w, n in counts.items()}, n_docs


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=None, base=None, least: float = 0.6) -> DataFrame:
    """``docs`` with ``license``: n_words, places (label and first word of each base phrase), labels (sorted), score."""
    vocabulary = {w for _, t, _ in (TEMPLATES if templates is None else templates) for w in words(t.encode())}
    df, n_docs = document_frequencies(docs, vocabulary, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Index(df, n_docs, templates, base, least))

    def find(texts: pa.Array) -> pa.Array:
        n, places, labels, scores = [], [], [], []
        for raw in byte_values(texts):
            n_words, at, of, score = shared.value.scan(raw)
            n.append(n_words)
            places.append([{"label": a, "start": b} for a, b in at])
            labels.append(sorted(of))
            scores.append(score)
        return struct_array(n_words=pa.array(n, pa.int64()), places=pa.array(places, pa.list_(_PLACE)), labels=pa.array(labels, pa.list_(pa.string())), score=pa.array(scores, pa.float64()))

    return docs.withColumn("license", arrow_column(lambda: find, KIND, F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`scan_licenses` for each document."""
    out = scan_licenses(docs.select("doc_id", "text"))
    starts = F.col("license.places.start")
    return out.select(
        "doc_id",
        F.col("license.n_words").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("license.places.label")), ",").alias("base_labels"),
        F.array_join("license.labels", ",").alias("labels"),
        F.col("license.score").alias("score"),
    )
