"""Licence scan over a positional index of rare template words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut_words, map_batches, slices


@dataclass(frozen=True)
class Template:
    """A wording to look for. ``keys`` are phrases that must stand at their place in it."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


#: Base phrases count wherever their words stand consecutively.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

NOTICES = (
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ("redistribute it and or modify it", "general public license"),
    ),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license",
        ("mozilla public license",),
    ),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "cc by sa", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
)


class RareWordIndex:
    """Template postings by the rarest words of the key phrases, without which a template is not verified."""

    def __init__(self, templates: Sequence[Template], idf: Mapping[bytes, float], anchors: int = 2):
        self.templates = templates
        self.words = [t.text.encode().split() for t in templates]
        unseen = max(idf.values(), default=0.0) + 1.0
        weight = lambda w: idf.get(w, unseen)
        self.weights = [[weight(w) for w in words] for words in self.words]
        self.totals = [math.fsum(w) for w in self.weights]
        self.keys = [[(0, len(words))] if t.base else [self._place(words, k.encode().split()) for k in t.keys] for t, words in zip(templates, self.words, strict=True)]
        #: rare word -> (template, place of the word in it); and how many words each template is entered by
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = [0] * len(templates)
        for t, words in enumerate(self.words):
            for first, last in self.keys[t]:
                rarest = sorted(range(first, last), key=lambda i: (-weight(words[i]), i))
                for i in rarest[:anchors]:
                    self.postings[words[i]].append((t, i))
                    self.needed[t] += 1
        #: the index's words, rarest first
        self.rare = {w: -weight(w) for w in sorted(self.postings, key=lambda w: (-weight(w), w))}

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> tuple[int, int]:
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                return i, i + len(key)
        raise ValueError(f"key phrase {b' '.join(key)!r} is not in its template")

    def starts(self, words: list[bytes]) -> dict[int, set[int]]:
        """Places where a template may begin: those that all words agree on by which it is entered.

        The file's licence words are taken rarest first, so that a template is given
        up before a common word is looked at in all its places.
        """
        present = self.rare.keys() & set(words)
        known = defaultdict(int)
        for w in present:
            for t, _ in self.postings[w]:
                known[t] += 1
        whole = {t for t, n in known.items() if n == self.needed[t]}
        wanted = {w for w in present if any(t in whole for t, _ in self.postings[w])}
        if not wanted:
            return {}
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        found: dict[int, set[int]] = {}
        for w in sorted(wanted, key=lambda w: (self.rare[w], len(places[w]), w)):
            for t, at in self.postings[w]:
                if t not in whole:
                    continue
                if t not in found:
                    found[t] = {i - at for i in places[w]}
                elif len(found[t]) < len(places[w]) // 16:
                    found[t] = {s for s in found[t] if 0 <= s + at < len(words) and words[s + at] == w}
                else:
                    found[t].intersection_update([i - at for i in places[w]])
        return {t: s for t, s in found.items() if s}

    def places(self, words: list[bytes]) -> dict[tuple[int, int], float]:
        """(template, start in the file) of every verified place, with the share of IDF weight found there.

        A place is verified where all key phrases of the template stand; of a base
        phrase that is the phrase.
        """
        found = {}
        for t, starts in self.starts(words).items():
            wanted, keys = self.words[t], self.keys[t]
            for start in starts:
                if all(start + a >= 0 and words[start + a : start + b] == wanted[a:b] for a, b in keys):
                    same = [w for i, w in enumerate(self.weights[t]) if 0 <= start + i < len(words) and words[start + i] == wanted[i]]
                    found[t, start] = math.fsum(same) / self.totals[t]
        return found


def word_idf(documents: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[bytes, float]:
    """IDF over all documents of the words of the templates (a few hundred at most); above 0 for words of every document."""
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        n = 0
        for part in slices(batches):
            for text in as_bytes(part.column("text")):
                n += 1
                for w in vocabulary.intersection(cut_words(text)):
                    seen[w] += 1
        words = [None, *seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w and w.decode() for w in words], pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"]
        )

    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    counts = {r["word"]: r["n"] for r in map_batches(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(None, 0)
    return {w: math.log(1 + (total + 1) / (counts.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan_licenses(
    documents: DataFrame,
    *,
    notices: Sequence[Template] = NOTICES,
    base: Sequence[Template] = BASE,
    min_share: float = 0.6,
    anchors: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence places of every whole text.

    One pass counts in how many documents each template word stands. The second
    takes a file's licence words, rarest first: a template is entered by the
    ``anchors`` rarest words of each of its key phrases (a base phrase is its own
    key), whose places, less the place in the template, are intersected. What all
    agree on is verified: every key phrase must stand. As no place passes without
    its key phrases, none is missed by the index, whatever else was edited. A notice
    counts when the words found at its start carry ``min_share`` of its IDF weight.
    Both passes are maps; only the word counts (bounded by the templates) reach the
    driver.

    Columns: id, ``n_words, n_base, first_word, last_word, base_labels, labels,
    score, places`` with score the best share (0 without a licence) and places
    the label, first and last word and share of all that was found.

    Null and empty texts have no words and no labels. Repeated rows give repeated
    rows; an empty table gives none. Other columns are not read.
    """
    templates = [*base, *notices]
    idf = word_idf(documents, templates, text_col)
    schema_tail = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "places array<struct<label:string,start:long,stop:long,share:double>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareWordIndex(templates, idf, anchors)
        place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
        for part in slices(batches):
            rows = [_row(cut_words(text), index, min_share) for text in as_bytes(part.column("text"))]
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    *(column(k, pa.int64()) for k in range(4)),
                    column(4, pa.string()),
                    column(5, pa.string()),
                    column(6, pa.float64()),
                    column(7, pa.list_(place)),
                ],
                names=["_id", *(c.split()[0] for c in schema_tail.split(", places")[0].split(", ")), "places"],
            )

    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["_id"].dataType.simpleString()
    return map_batches(texts, run, f"_id {kind}, {schema_tail}").withColumnRenamed("_id", id_col)


def _row(words: list[bytes], index: RareWordIndex, min_share: float) -> tuple:
    found = index.places(words)
    is_base = lambda t: index.templates[t].base
    starts = [s for t, s in found if is_base(t)]
    kept = {k: share for k, share in found.items() if is_base(k[0]) or share >= min_share}
    label = lambda t: index.templates[t].label
    spans = sorted((s, s + len(index.words[t]), label(t), share) for (t, s), share in kept.items())
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label(t) for t, _ in found if is_base(t)})),
        ",".join(sorted({label(t) for t, _ in kept})),
        min(1.0, max(kept.values(), default=0.0)),
        [{"label": name, "start": max(0, a), "stop": min(b, len(words)), "share": share} for a, b, name, share in spans],
    )
