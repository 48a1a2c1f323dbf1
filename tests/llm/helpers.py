"""Tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, source string, slot string"


def documents(spark, rows):
    """Documents with a source and a column that clashes with operators' own."""
    return spark.createDataFrame([(i, t, s, "mine") for i, t, s in rows], DOCS)


def prose(seed, words, vocabulary=400):
    """Random words of a small language."""
    r = random.Random(seed)
    return " ".join("w" + "".join(chr(97 + (k * 7 + j) % 26) for j in range(3 + k % 5)) + str(k)
                    for k in (r.randrange(vocabulary) for _ in range(words)))


def edited(text, seed, share):
    """The text with a share of its words replaced."""
    r = random.Random(seed)
    return " ".join("new" + str(r.randrange(10**6)) if r.random() < share else w for w in text.split())


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
