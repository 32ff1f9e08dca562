"""License scan: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import frame

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as their licenses print them; "-notice" labels are the join's own.
TEMPLATES = {
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
}
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns what stands in no word into a space; line feeds stay for the blocks.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _LETTERS else 32 for c in range(256))
_TO_BLOCKS = _TO_WORDS[:10] + b"\n" + _TO_WORDS[11:]
_PHRASES = {label: b" " + phrase.encode() + b" " for phrase, label in PHRASES.items()}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for label, phrase in _PHRASES.items():
        at, end, words_before = joined.find(phrase), 0, 0
        while at >= 0:
            words_before += joined.count(b" ", end, at)
            out.append((words_before, label))
            end, at = at, joined.find(phrase, at + 1)
    return sorted(out)


def needed(n: int, containment: float) -> int:
    """Words of a template of n distinct words that a block must hold."""
    return max(1, math.ceil(containment * n - 1e-9))


class TemplateIndex:
    """Templates as arrays of words in ascending global frequency, with an inverted index of their prefixes.

    A block that holds k of a template's n words holds one of the first n - k + 1 of them, in whatever order both
    sides share; rare words first make that test pass seldom.
    """

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], containment: float):
        self.sets, self.least, self.prefix, self.size = {}, {}, {}, {}
        order = lambda w: (frequency.get(w.decode(), 0), w)
        self.rank = {w: i for i, w in enumerate(sorted({w for t in templates.values() for w in words_of(t)}, key=order))}
        for label, text in templates.items():
            ranks = sorted({self.rank[w] for w in words_of(text)})
            if not ranks:
                continue
            self.sets[label], self.least[label] = ranks, needed(len(ranks), containment)
            self.size[label] = len(words_of(text))
            for position, r in enumerate(ranks[: len(ranks) - self.least[label] + 1]):
                self.prefix.setdefault(r, []).append((label, position))

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Containment of each template that reaches the threshold in a block of words."""
        mine = sorted({self.rank[w] for w in block if w in self.rank})
        have, done, out = set(mine), set(), {}
        for position, r in enumerate(mine):
            for label, at in self.prefix.get(r, ()):
                if label in done:
                    continue
                done.add(label)  # the first shared word in the common order decides the positional bound
                ranks, least = self.sets[label], self.least[label]
                if len(mine) < least:  # length filter
                    continue
                if 1 + min(len(mine) - position - 1, len(ranks) - at - 1) < least:  # positional filter
                    continue
                shared = sum(x in have for x in ranks)
                if shared >= least:
                    out[label] = shared / len(ranks)
        return out


    def closest(self, label: str, words: list[bytes]) -> float:
        """The largest containment of a template in a run of as many words as it has itself."""
        ranks, size = set(self.sets[label]), self.size[label]
        inside, count, most = deque(), {}, 0
        for at, w in enumerate(words):
            r = self.rank.get(w)
            if r not in ranks:
                continue
            inside.append((at, r))
            count[r] = count.get(r, 0) + 1
            while inside[0][0] <= at - size:
                old = inside.popleft()[1]
                count[old] -= 1
                if not count[old]:
                    del count[old]
            most = max(most, len(count))
        return most / len(ranks) if most >= self.least[label] else 0.0


def word_frequency(docs: DataFrame, templates: dict[str, str], text_col: str = "text") -> dict[str, int]:
    """Over all texts, how many times each word of the templates occurs. As many rows as the templates have words."""
    known = {w for t in templates.values() for w in words_of(t)}

    def count(batches):
        total = dict.fromkeys(known, 0)
        for pdf in batches:
            for text in pdf.text:
                for w in words_of(text):
                    if w in total:
                        total[w] += 1
        yield frame([(w.decode(), n) for w, n in total.items() if n], "word string, n long")

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(doc_id, text: str, index: TemplateIndex, wrapped: bool = False) -> tuple:
    data = text.encode()
    words = data.translate(_TO_WORDS).split()
    base = places(words)
    found: dict[str, float] = {}
    for line in data.translate(_TO_BLOCKS).split(b"\n"):
        block = line.split()
        for label, share in index.matches(block).items():
            found[label] = max(share, found.get(label, 0.0))
    for label in index.matches(words) if wrapped else ():  # what the whole text doesn't hold, no run of its words does
        share = index.closest(label, words)
        if share:
            found[label] = max(share, found.get(label, 0.0))
    labels = {label for _, label in base}
    score = max([1.0 if base else 0.0, *found.values()])
    return doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """One row per document: counts of words and of phrase places, their first and last start, labels and a score.

    Blocks are the lines of the whole text and, with wrapped, also each run of as many words as a template has,
    wherever lines or paragraphs break, so a notice that is wrapped is found as well. A template's label is added when a block holds at least the given share
    of its distinct words; the join is exact: words in globally ascending frequency, then prefix, length and
    positional filters, then the overlap itself. The templates are parameters of a fixed size, so every task holds
    their index and no row of the corpus moves. score is 1 where a phrase stands, else the best containment, else 0.
    A null text counts as empty (0 words, empty labels), null ids stay null, repeated rows give a row each, an empty
    table gives no rows, other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    index = TemplateIndex(templates, word_frequency(docs, templates, text_col), containment)

    def scan(batches):
        for pdf in batches:
            yield frame([scan_text(None if i is None else int(i), t, index, wrapped) for i, t in zip(pdf.id.tolist(), pdf.text.tolist(), strict=True)], SCAN)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(scan, SCAN)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), wrapped=True)
