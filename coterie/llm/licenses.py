"""License scans by a positional index of rare words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import appended, flat_text, map_batches, steps

#: Highest-IDF words of a template that are looked up, words that may be missing or
#: added between them, share of their IDF that must fit, and the score of a bare phrase.
RARE, SLACK, SHARE, MENTION = 16, 6, 0.6, 0.5
#: Words of all templates and phrases together: the index goes to every task.
MAX_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    """A license text, and phrases that must all stand in it."""

    label: str
    text: str
    keys: tuple[str, ...]


# Phrases that name a license, and public license texts (openings or
# notices) with the phrases that tell them from their relatives.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee", "appear in all copies")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met: Redistributions of source code must retain the above "
             "copyright notice, this list of conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
             "in compliance with the License. You may obtain a copy of the License at",
             ("apache license", "except in compliance with the license")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2", ("apache license version 2",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version", ("general public license as published by the free software foundation",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
             "MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4", ("cc by nc",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
             "modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
)


def words_of(text: str) -> list[str]:
    """The words of a template, as a scan finds them in a document."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Index:
    """Postings of the words of templates and phrases, by relative position."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.templates, self.phrases = list(templates), list(phrases)
        self.bodies = [words_of(t.text) for t in templates]
        self.searched = [words_of(p) for _, p in phrases]
        self.base = len(self.searched)
        self.keys: list[list[int]] = []
        for t in templates:
            self.keys.append(list(range(len(self.searched), len(self.searched) + len(t.keys))))
            self.searched += [words_of(key) for key in t.keys]
        if not all(self.searched) or not all(self.bodies):
            raise ValueError("a template or phrase without words")
        self.vocabulary = sorted({w for ws in (*self.bodies, *self.searched) for w in ws})
        if sum(map(len, (*self.bodies, *self.searched))) > MAX_WORDS:
            raise ValueError(f"more than {MAX_WORDS} words in the templates")
        raw = "".join(self.vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in self.vocabulary]).astype(np.int64)
        hashes = words.word_hashes(np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {self.vocabulary[at]: k for k, at in enumerate(order.tolist())}
        self.vocabulary = [self.vocabulary[at] for at in order.tolist()]
        self.bodies = [np.array([number[w] for w in ws]) for ws in self.bodies]
        self.searched = [np.array([number[w] for w in ws]) for ws in self.searched]
        self.idf = np.ones(len(self.vocabulary))

    def weigh(self, n_docs: int, n_with: np.ndarray) -> None:
        """IDF of every word, and the postings (template, place) of each template's RARE
        words of the highest."""
        self.idf = np.log1p((n_docs + 1) / (n_with + 1))
        rows = []
        for t, body in enumerate(self.bodies):
            own = np.unique(body)
            rare = own[np.lexsort((own, -self.idf[own]))[:RARE]]
            rows += [(w, t, place) for place, w in enumerate(body.tolist()) if w in rare]
        postings = np.array(sorted(rows)).reshape(-1, 3)
        self.first = np.searchsorted(postings[:, 0], np.arange(len(self.vocabulary) + 1))
        self.template, self.place = postings[:, 1], postings[:, 2]
        self.total = np.bincount(self.template, self.idf[postings[:, 0]], len(self.templates))


class Scan:
    """The words of some texts; ``word`` holds their numbers in the index, else -1."""

    def __init__(self, index: Index, data: np.ndarray, offsets: np.ndarray):
        data = words.lower_ascii(data)
        starts, ends, self.first = words.spans(data, offsets, words.NOT_ALNUM)
        self.index, self.n_texts = index, len(offsets) - 1
        hashes = words.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(index.hashes, hashes), len(index.hashes) - 1)
        self.word = np.where(index.hashes[at] == hashes, at, -1)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(self.first))
        self.known = np.flatnonzero(self.word >= 0)

    def places(self, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase stands: its rarest word's postings, each other word's
        intersected by relative position, the rarer first."""
        order = np.lexsort((np.arange(len(phrase)), -self.index.idf[phrase]))
        start = self.known[self.word[self.known] == phrase[order[0]]] - order[0]
        start = start[(start >= 0) & (start + len(phrase) <= len(self.word))]
        start = start[self.text[start] == self.text[start + len(phrase) - 1]]
        for at in order[1:]:
            start = start[self.word[start + at] == phrase[at]]
        return start

    def templates(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, score, begin, end) of every template that stands somewhere:
        its rare words' occurrences agree on where it begins, up to SLACK words between
        neighbours, and all its key phrases (their places are in ``found``) are inside.
        The score is the share of the rare words' IDF that fits."""
        x = self.index
        count = x.first[self.word[self.known] + 1] - x.first[self.word[self.known]]
        at = np.repeat(self.known, count)
        post = np.repeat(x.first[self.word[self.known]], count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        template, place = x.template[post], x.place[post]
        begin = at - place
        order = np.lexsort((place, begin, template, self.text[at]))
        at, template, place, begin = at[order], template[order], place[order], begin[order]
        new = np.ones(len(at), bool)
        new[1:] = (self.text[at[1:]] != self.text[at[:-1]]) | (np.diff(template) != 0) | (np.diff(begin) > SLACK)
        group = np.cumsum(new) - 1
        # A word of the template counts once in each group.
        first = np.unique(group * (int(x.place.max(initial=0)) + 1) + place, return_index=True)[1]
        gain = np.bincount(group[first], x.idf[self.word[at[first]]], int(new.sum()))
        lead = np.flatnonzero(new)
        tail = np.append(lead, len(at))[1:] - 1
        text, which = self.text[at[lead]], template[lead]
        share = gain / np.maximum(x.total[which], 1e-300)
        sizes = np.array([len(body) for body in x.bodies])
        lo = np.maximum(begin[lead] - SLACK, self.first[:-1][text])
        hi = np.minimum(begin[tail] + sizes[which] + SLACK, self.first[1:][text])
        good = share >= SHARE
        for t in np.unique(which[good]).tolist():
            for key in x.keys[t]:
                mine = np.flatnonzero(good & (which == t))
                next_at = np.searchsorted(found[key], lo[mine])
                stands = np.append(found[key], len(self.word) + hi.max(initial=0))[next_at] + len(x.searched[key]) <= hi[mine]
                good[mine[~stands]] = False
        return text[good], which[good], np.minimum(share[good], 1.0), lo[good], hi[good]


def word_documents(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that hold each word of the index: over all
    texts; a row per word comes to the driver."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.hashes), np.int64), 0
        for batch in batches:
            data, offsets = flat_text(batch.column(0))
            n += len(batch)
            for lo, hi in steps(offsets):
                scan = Scan(index, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                held = np.unique(scan.text[scan.known] * len(total) + scan.word[scan.known])
                total += np.bincount(held % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))],
                                         names=["word", "n"])

    rows = docs.select("text").transform(map_batches, of, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n_with, n_docs = np.zeros(len(index.hashes), np.int64), 0
    for row in rows.collect():
        if row.word < 0:
            n_docs = row.n
        else:
            n_with[row.word] = row.n
    return n_docs, n_with


ADDED = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
         "score double, matches array<struct<label:string,score:double,begin:int,end:int>>")


def license_labels(docs: DataFrame, templates: Sequence[Template] = TEMPLATES,
                   phrases: Sequence[tuple[str, str]] = PHRASES, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the licenses that their texts name or hold:

    * n_words; n_base, places at which a phrase's words stand one after another, and
      first_word and last_word, the least and largest of them (words count from 0; null
      without any); base_labels, the phrases' labels,
    * labels: these and the labels of templates that stand in the text; both sorted and
      distinct,
    * matches: label, score and word range (end exclusive) of each template found,
    * score: the best of them, 0.5 at least if there is a base label, else 0.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and all other
    characters beyond ASCII.  IDF is counted over all texts.  Templates and phrases are
    looked up by their rarest words; postings are intersected by relative position, and
    a template needs all its key phrases within its range.  Every occurrence in the
    whole text is looked up; copies of a row are each scanned.  A null or empty text has
    no words, labels or matches and score 0.  Columns named like the results are replaced.
    """
    index = Index(templates, phrases)
    index.weigh(*word_documents(docs, index))
    return appended(docs, ADDED, _Labels(index), without)


class _Labels:
    def __init__(self, index: Index):
        self.index = index

    def __call__(self, batch: pa.RecordBatch) -> dict:
        data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
        out: dict[str, list] = {name: [] for name in (
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
        for lo, hi in steps(offsets):
            self._texts(Scan(self.index, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]), out)
        return out

    def _texts(self, scan: Scan, out: dict[str, list]) -> None:
        x, n = self.index, scan.n_texts
        found = [scan.places(phrase) for phrase in x.searched]
        base: dict[int, list[tuple[int, str]]] = {}
        for (label, _), starts in zip(x.phrases, found):
            for at in starts.tolist():
                base.setdefault(int(scan.text[at]), []).append((at, label))
        matches: dict[int, list[dict]] = {}
        for text, t, share, lo, hi in zip(*(a.tolist() for a in scan.templates(found))):
            begin = int(scan.first[text])
            matches.setdefault(text, []).append(
                {"label": x.templates[t].label, "score": share, "begin": lo - begin, "end": hi - begin})
        out["n_words"] += np.diff(scan.first).tolist()
        for k in range(n):
            places, held = base.get(k, []), matches.get(k, [])
            at = [p for p, _ in places]
            named, begin = sorted({label for _, label in places}), int(scan.first[k])
            out["n_base"].append(len(at))
            out["first_word"].append(min(at) - begin if at else None)
            out["last_word"].append(max(at) - begin if at else None)
            out["base_labels"].append(named)
            out["labels"].append(sorted({*named, *(m["label"] for m in held)}))
            out["score"].append(max([MENTION * bool(at), *(m["score"] for m in held)]))
            out["matches"].append(sorted(held, key=lambda m: (m["begin"], m["label"])))
