import random
import re
from collections import Counter

import numpy as np
import pytest

from isoplane.llm import collocations as op


def brute_force(rows, least, top, cover):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, op.DEPTH + 1):
                own.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in found.items():
            inside = any(len(h) > len(g) and 100 * b >= cover * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items())
            if not inside:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n, vocabulary=9):
    r = random.Random(seed)
    words = ["a", "B", "ç", "d'e", "x-1", "\x0b", "Über", "w" * 70, "\xa0", "z"][:vocabulary]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ", " "]
    return ["".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(60))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(lang, text, "mine", "mine") for lang, text in rows], "lang string, text string, phrase string, f string")


@pytest.mark.parametrize("least", [1, 100])
def test_suffix_sort_counts_prefixes_and_whole_suffixes(least):
    r = np.random.default_rng(least)
    words = r.integers(1, 5, (2000, 4)).astype(np.uint64) << np.uint64(61)
    words[np.arange(4)[None] >= r.integers(1, 5, 2000)[:, None]] = 0
    weights = r.integers(1, 4, 2000)
    prefixes, whole = Counter(), Counter()
    for row, w in zip(words.tolist(), weights.tolist()):
        row = tuple(x for x in row if x)
        whole[row] += w
        prefixes.update({row[:d]: w for d in range(1, len(row) + 1)})
    (depth, at, f), (length, place, g) = op.suffix_sort(words, weights, least)
    assert sorted((tuple(words[p, :d].tolist()), c) for d, p, c in zip(depth, at, f)) == sorted((k, c) for k, c in prefixes.items() if c >= least)
    assert {tuple(words[p, :d].tolist()): c for d, p, c in zip(length, place, g)}.items() <= whole.items()
    if least == 1:
        assert len(length) == len(whole)
    empty = op.suffix_sort(words[:0], weights[:0], least)
    assert [len(x) for found in empty for x in found] == [0] * 6


@pytest.mark.parametrize("least, top, cover", [(3, 2000, 100), (5, 7, 100), (4, 2000, 60)])
def test_phrases_match_brute_force(spark, least, top, cover):
    rows = [("en", t) for t in texts(1, 60)] + [("de", t) for t in texts(2, 20, 5)] + [(None, t) for t in texts(3, 10, 3)] + [("fr", None), ("en", "")]
    rows += [("en", "one passage that many documents share, and more of it")] * 12
    assert got(op.collocations(table(spark, rows).repartition(7), least, top, cover)) == brute_force(rows, least, top, cover)


def test_hot_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """A pair that holds most suffixes gives the same counts from tasks that each see some of them."""
    monkeypatch.setattr(op, "TASK_ROWS", 40)
    monkeypatch.setattr(op, "BLOCK", 300)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 3)
    r = random.Random(5)
    rows = [("en", " ".join("hot pair " + r.choice("abc") + " " + r.choice("de") for _ in range(40))) for _ in range(30)]
    assert got(op.collocations(table(spark, rows).repartition(6), 10)) == brute_force(rows, 10, 2000, 100)


def test_filter_of_pairs_may_only_pass_too_many(spark, monkeypatch):
    rows = [("en", t) for t in texts(9, 50)]
    monkeypatch.setattr(op, "in_filter", lambda p, field, bits: np.ones(len(p), bool))
    assert got(op.collocations(table(spark, rows), 4)) == brute_force(rows, 4, 2000, 100)


def test_scores_beyond_64_bits(spark):
    key = lambda *w: b"".join(x.to_bytes(8, "big") for x in w)
    a, n, one, two = 3 * 10**12, 7 * 10**14, 5 * 10**12 + 1, 4 * 10**12 + 3
    phrases = spark.createDataFrame([("en", key(1, 2), a)], "lang string, phrase binary, f long")
    words = spark.createDataFrame([("en", key(1), one), ("en", key(2), two)], "lang string, phrase binary, f long")
    row = op.scored(phrases, words, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (one * two) and (row.l, row.r) == (one, two)


def test_empty_tables(spark):
    assert op.collocations(table(spark, [("en", "a b")]).limit(0)).count() == 0
    assert op.collocations(table(spark, [("en", None), (None, " , ")])).count() == 0
