"""Licence notices found through a positional index of rare words.

The words of all templates are counted over all documents. A template is indexed
by the positions of its highest-IDF words. In a document every rare word votes for
the place where its template would start; places on which enough different rare
words agree are kept, compared word by word with the template and accepted when
the template's mandatory phrases stand there. Base phrases, found wherever their
words stand consecutively, are reported beside that.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.llm.arrays import ascii_lower, blocks, span_hashes, word_spans

# Label, notice, phrases that must stand in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ("hereby granted free of charge", "copy of this software")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
RARE = 4
AGREE = 0.5
NEAR = 3


def is_word_byte(data):
    """Digits, a-z and every byte of a non-ASCII character."""
    return (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


class Vocabulary:
    """Numbers for the words of templates and phrases, found by hash."""

    def __init__(self, templates, base):
        texts = [t for _, t, _ in templates] + [p for _, _, ps in templates for p in ps] + [p for _, p in base]
        self.words = sorted({w for t in texts for w in t.split()})
        order = sorted(range(len(self.words)), key=lambda i: _hash(self.words[i]))
        self.hashes = np.array([_hash(self.words[i]) for i in order], np.uint64)
        self.numbers = np.array(order, np.int32)
        self.by_word = {w: i for i, w in enumerate(self.words)}

    def ids(self, text: str) -> list[int]:
        return [self.by_word[w] for w in text.split()]

    def find(self, hashes):
        """Number of every hash, -1 for words outside."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def _tokens(data, offsets, vocabulary):
    """Vocabulary numbers of all words of a block and the word range of every document."""
    data = ascii_lower(data)
    starts, ends = word_spans(is_word_byte(data), offsets)
    return vocabulary.find(span_hashes(data, starts, ends)), np.searchsorted(starts, offsets)


def _consecutive(ids, doc, phrase):
    """Word numbers at which a phrase starts."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = ids[:n] == phrase[0]
    for k in range(1, len(phrase)):
        hit &= ids[k:k + n] == phrase[k]
    at = np.flatnonzero(hit)
    return at[doc[at] == doc[at + len(phrase) - 1]]


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> dict:
    """Documents that hold each licence word, counted over all of ``docs``."""
    def count(batches):
        total = np.zeros(len(vocabulary.words), np.int64)
        for _, data, offsets in blocks(batches, "text"):
            ids, bounds = _tokens(data, offsets, vocabulary)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            known = ids >= 0
            pairs = np.unique(doc[known].astype(np.int64) * len(total) + ids[known])
            total += np.bincount(pairs % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word long, n long")
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = RARE, agree: float = AGREE,
                 near: int = NEAR) -> DataFrame:
    """Licence notices of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word``
    and ``last_word`` (their least and greatest start, null without any), ``base_labels``
    and ``labels`` (distinct, sorted, comma-joined, empty without any; ``labels`` adds the
    templates'), ``score`` (greatest share of a template's words found at its place, over
    accepted places) and ``places`` (label, start word and share of each accepted place).

    ``rare`` words index each template; a place is looked at when ``agree`` of them or
    more vote for it; phrases may stand ``near`` words off. Null and empty texts have no
    words and no labels; every row is judged on its own, repeated ones alike. Other
    columns are ignored. An empty table gives an empty one.
    """
    vocabulary = Vocabulary(templates, base)
    counts = word_counts(docs, vocabulary)
    # The fewer documents hold a word the higher its IDF; ties go by the word itself.
    rank = sorted(range(len(vocabulary.words)), key=lambda i: (counts.get(i, 0), vocabulary.words[i]))
    place = {w: r for r, w in enumerate(rank)}
    known = [(label, vocabulary.ids(text), [vocabulary.ids(p) for p in phrases]) for label, text, phrases in templates]
    postings = {}  # word -> [(template, position)]
    need = []
    for t, (_, ids, _) in enumerate(known):
        chosen = sorted(set(ids), key=place.get)[:rare]
        need.append(max(1, math.ceil(agree * len(chosen))))
        for q, w in enumerate(ids):
            if w in chosen:
                postings.setdefault(w, []).append((t, q))
    phrases = [(label, vocabulary.ids(p)) for label, p in base]

    def scan(batches):
        for rows, data, offsets in blocks(batches, "text"):
            ids, bounds = _tokens(data, offsets, vocabulary)
            n = len(offsets) - 1
            doc = np.repeat(np.arange(n), np.diff(bounds))
            n_base = np.zeros(n, np.int64)
            first, last = [None] * n, [None] * n
            labels, own, found = {}, {}, {}
            for label, phrase in phrases:
                for i in _consecutive(ids, doc, phrase):
                    d = int(doc[i])
                    at = int(i - bounds[d])
                    n_base[d] += 1
                    first[d] = at if first[d] is None else min(first[d], at)
                    last[d] = at if last[d] is None else max(last[d], at)
                    labels.setdefault(d, set()).add(label)
            votes = {}  # (document, template, start) -> rare words that agree
            for w, where in postings.items():
                for i in np.flatnonzero(ids == w):
                    for t, q in where:
                        votes.setdefault((int(doc[i]), t, int(i) - q), set()).add(w)
            for (d, t, start), words in votes.items():
                label, template, must = known[t]
                if len(words) < need[t]:
                    continue
                low, high = max(bounds[d], start - near), min(bounds[d + 1], start + len(template) + near)
                region, same = ids[low:high], np.zeros(high - low, np.int8)
                if not all(len(_consecutive(region, same, p)) for p in must):
                    continue
                a, b = max(bounds[d], start), min(bounds[d + 1], start + len(template))
                share = sum(int(ids[i] == template[i - start]) for i in range(a, b)) / len(template)
                own.setdefault(d, set()).add(label)
                found.setdefault(d, []).append((label, int(start - bounds[d]), share))
            every = {d: labels.get(d, set()) | own.get(d, set()) for d in {*labels, *own}}
            joined = lambda sets: pa.array([",".join(sorted(sets.get(d, ()))) for d in range(n)])
            places = [[{"label": x, "word": w, "share": s} for x, w, s in sorted(found.get(d, []))] for d in range(n)]
            kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()),
                 pa.array(last, pa.int64()), joined(labels), joined(every),
                 pa.array([max((s for _, _, s in found.get(d, [])), default=0.0) for d in range(n)], pa.float64()),
                 pa.array(places, kind)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, places array<struct<label string, word long, share double>>")
