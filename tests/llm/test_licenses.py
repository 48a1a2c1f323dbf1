import re

from isoplane.llm import licenses as op
from tests.llm.helpers import DOCS, documents, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_counts(text):
    words = [w.decode(errors="replace") for w in WORD.findall((text or "").encode().lower())]
    places, labels = [], set()
    for label, phrase in op.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


ROWS = [
    (1, "Licensed under the Apache License, Version 2.0.\n" + prose(1, 50), "s"), (2, prose(2, 300) + " Released under the MIT License.", "s"),
    (3, "This work is licensed under the GNU General Public License, version 3.", "s"), (4, "Licensed under CC BY-NC 4.0. cc\nBY cc-by", "s"),
    (5, "All rights reserved. ALL RIGHTS RESERVED all rights", "s"), (6, None, "s"), (7, "", "s"), (8, "!!! ...", "s"),
    (9, "allx rights reserved ällrights all rightsé reserved", "s"), (10, prose(10, 30_000) + " general public license", "s"),
    (11, "permission is hereby granted free of charge, to any person obtaining a copy of this software and the associated files", "s"),
    (12, "the license is not the apache version nor mit 2 0", "s"), (3, "repeated row", "s"), (None, "cc by", "s"),
    (13, "\x1f_cc_by_ \x7fgeneral{public}license", "s"), (14, "licensed under the gnu general private license version 3", "s")]


def test_base_columns_match_brute_force(spark):
    out = op.license_scan(documents(spark, ROWS)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert got == sorted(((i, *base_counts(t)) for i, t, _ in ROWS), key=repr)


def test_labels_of_templates(spark):
    out = {r.doc_id: r for r in op.license_scan(documents(spark, [r for r in ROWS if r[1] != "repeated row"])).collect()}
    labels = {i: r.labels.split(",") for i, r in out.items()}
    assert "apache-2.0" in labels[1] and labels[2] == ["mit"] and labels[3] == ["gpl", "gpl-3.0"]
    assert "cc-by-nc-4.0" in labels[4] and "cc-by" in labels[4] and "all-rights-reserved" in labels[5]
    assert labels[11] == ["mit"] and 0.5 < out[11].score < 1  # a changed notice, its key phrases intact
    assert labels[6] == labels[7] == labels[8] == labels[12] == labels[14] == [""]
    assert out[1].score == out[2].score == 1 and out[12].score == 0
    assert [(p.label, p.word) for p in out[2].places] == [("mit", 300)]


def test_rare_words_come_from_all_documents(spark):
    vocabulary = op.Vocabulary(op.TEMPLATES, op.BASE)
    counts = op.word_counts(documents(spark, [(i, "the license the " + ("gnu" if i == 7 else ""), "s") for i in range(40)]), vocabulary)
    assert [counts[vocabulary.by_word[w]] for w in ("the", "license", "gnu", "mozilla")] == [40, 40, 1, 0]


def test_empty_table(spark):
    assert op.license_scan(spark.createDataFrame([], DOCS)).count() == 0
