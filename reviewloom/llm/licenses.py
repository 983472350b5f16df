"""Licences in documents, by a positional index of rare words.

The licence notices are templates. Each is indexed by its rarest words, by
their frequency in the documents at hand: word to (template, place). Each of
them in a document votes for where the template may begin. A template has so
many postings that one of which a large enough share stands gets enough votes,
whichever of its words differ; it is then compared there word by word, and its
key phrases must be found.

Null and empty texts have no words and no labels. Rows are judged one by one,
so repeated rows agree; counts are over rows. An empty table has no rows. Texts are
read whole. Of several places of a template the largest share counts. Extra columns are
ignored.
"""

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.textnum import WORDLIKE, Words, slabs

#: The phrases of the contract and what they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of well-known licence notices, and phrases that each
#: must hold.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        ("apache license", "in compliance with the license")),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met")),
    "cc-by-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution",)),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
        ("free software", "gnu general public license")),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("permission to use", "with or without fee")),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction",
        ("permission is hereby granted free of charge", "associated documentation files")),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",)),
    "spdx": ("SPDX-License-Identifier", ("spdx license identifier",)),
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([len(data)]), WORDLIKE).hashes()


def _words(data: np.ndarray, lengths: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, lengths, WORDLIKE)
    return words, words.hashes()


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word; over all documents."""
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for first, last, data, lengths in slabs(batch.column(0)):
                words, h = _words(data, lengths)
                at = np.searchsorted(hashes[order], h)
                hit = np.flatnonzero(hashes[order][np.minimum(at, len(order) - 1)] == h)
                pairs = np.unique(words.doc[hit] * len(order) + at[hit])
                total[:-1] += np.bincount(pairs % len(order), minlength=len(order))
        total[-1] = rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    # One row for each word of the templates.
    rows = (docs.select("text").mapInArrow(count, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {r["word"]: r["n"] for r in rows}
    return found.get(len(vocabulary), 0), {
        vocabulary[order[i]]: found.get(i, 0) for i in range(len(vocabulary))}


class RareWordIndex:
    """Postings of the rarest words of each template.

    At least ``rare`` words, and as many as it takes that three of their places
    are left where a share of ``cover`` stands and all other words differ.
    """

    def __init__(self, templates: dict, documents: int, frequency: dict[str, int], cover: float = 0.7,
                 rare: int = 10):
        self.labels = list(templates)
        texts = [words_of(text) for text, _ in templates.values()]
        self.words = [_hashes(t) for t in texts]
        self.keys = [[_hashes(words_of(k)) for k in keys] for _, keys in templates.values()]
        self.idf = {w: float(np.log((documents + 1) / (frequency.get(w, 0) + 1)))
                    for t in texts for w in t}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        #: Of each template, how many words must agree, and how many postings then do.
        self.least: list[int] = []
        self.votes: list[int] = []
        for number, (text, hashes) in enumerate(zip(texts, self.words, strict=True)):
            least = next((k for k in range(1, len(text) + 1) if k / len(text) >= cover), len(text) + 1)
            differ = len(text) - least
            chosen: set[str] = set()
            placed = 0
            for word in sorted(set(text), key=lambda w: (-self.idf[w], w)):
                if len(chosen) >= rare and placed >= differ + 3:
                    break
                chosen.add(word)
                placed += text.count(word)
            for place, (word, h) in enumerate(zip(text, hashes.tolist(), strict=True)):
                if word in chosen:
                    self.postings[h].append((number, place))
            self.least.append(least)
            self.votes.append(placed - differ)
        self.listed = np.array(sorted(self.postings), dtype=np.uint64)

    def scan(self, words: Words, h: np.ndarray) -> dict[int, dict[str, float]]:
        """By row of a slab, the templates that stand in it: label to share of the template.

        ``h`` are the hashes of the words. All that are listed vote.
        """
        if not len(self.listed) or not len(h):
            return {}
        near = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        hit = np.flatnonzero(self.listed[near] == h)
        hit = hit[np.argsort(near[hit], kind="stable")]
        cuts = np.searchsorted(near[hit], np.arange(len(self.listed) + 1))
        begins: list[list[np.ndarray]] = [[] for _ in self.labels]
        # A beginning ahead of the slab is still a number from 0, one for each row.
        ahead = max(len(t) for t in self.words)
        wide = len(h) + ahead
        for i, value in enumerate(self.listed.tolist()):
            places = hit[cuts[i]:cuts[i + 1]]
            rows = words.doc[places] * wide + places + ahead
            for number, at in self.postings[value]:
                begins[number].append(rows - at)
        out: dict[int, dict[str, float]] = defaultdict(dict)
        for number, found in enumerate(begins):
            if not found:
                continue
            voted, agree = np.unique(np.concatenate(found), return_counts=True)
            voted = voted[agree >= self.votes[number]]
            self._compare(number, voted // wide, voted % wide - ahead, words, h, out)
        return out

    def _compare(self, number: int, doc: np.ndarray, begin: np.ndarray, words: Words, h: np.ndarray, out):
        template, label = self.words[number], self.labels[number]
        low, high = words.bounds[doc], words.bounds[doc + 1]
        same = np.zeros(len(doc), np.int64)
        for i, value in enumerate(template):
            at = begin + i
            inside = (at >= low) & (at < high)
            same += inside & (h[np.where(inside, at, 0)] == value)
        first, last = np.maximum(begin, low), np.minimum(begin + len(template), high)
        for c in np.flatnonzero(same >= self.least[number]):
            share, found = int(same[c]) / len(template), out.get(int(doc[c]), {})
            if share > found.get(label, 0) and all(
                    _stands(key, h[first[c]:last[c]]) for key in self.keys[number]):
                out[int(doc[c])][label] = share


def _stands(key: np.ndarray, own: np.ndarray) -> bool:
    n = len(own) - len(key) + 1
    if n <= 0:
        return False
    found = np.ones(n, bool)
    for i, value in enumerate(key):
        found &= own[i:i + n] == value
    return bool(found.any())


_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, " \
    "base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = PHRASES,
                  cover: float = 0.7) -> DataFrame:
    """One row of findings for each row of ``docs``.

    ``score`` is the largest share of a template that was found, at least a
    half where a phrase stands, else 0.
    """
    vocabulary = sorted({w for text, _ in templates.values() for w in words_of(text)})
    index = RareWordIndex(templates, *document_frequency(docs, vocabulary), cover)
    wanted = [(label, _hashes(words_of(phrase))) for phrase, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, lengths in slabs(batch.column(1)):
                yield _findings(
                    batch.column(0).slice(first, last - first), *_words(data, lengths), index, wanted)

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT)


def _findings(ids, words: Words, h: np.ndarray, index: RareWordIndex, wanted):
    rows, bounds = len(ids), words.bounds
    n_base = np.zeros(rows, np.int64)
    low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
    base: list[set] = [set() for _ in range(rows)]
    for label, key in wanted:
        n = len(h) - len(key) + 1
        at = np.flatnonzero(h[:max(n, 0)] == key[0])
        at = at[words.doc[at] == words.doc[at + len(key) - 1]]
        for i in range(1, len(key)):
            at = at[h[at + i] == key[i]]
        doc = words.doc[at]
        n_base += np.bincount(doc, minlength=rows)
        place = at - bounds[doc]
        np.minimum.at(low, doc, place)
        np.maximum.at(high, doc, place)
        for d in np.unique(doc):
            base[d].add(label)
    more = index.scan(words, h)
    score = [max([0.5 if base[d] else 0.0, *more.get(d, {}).values()]) for d in range(rows)]
    none = n_base == 0
    return pa.RecordBatch.from_arrays([
        ids, pa.array(words.counts.astype(np.int64)), pa.array(n_base),
        pa.array(low, mask=none), pa.array(high, mask=none),
        pa.array([",".join(sorted(b)) for b in base]),
        pa.array([",".join(sorted(b | set(more.get(d, ())))) for d, b in enumerate(base)]),
        pa.array(score, pa.float64())],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def query(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
