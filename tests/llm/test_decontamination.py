import numpy as np

from isoplane.llm import decontamination as op
from tests.llm.helpers import DOCS, documents, prose

ITEMS = "item_id long, text string, label string"


def normal(text):
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    return op.symbols(data, np.array([0, len(data)]))[0].tobytes().rstrip()


def distance(pattern, text):
    """Least edits from the whole pattern to any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in pattern:
        step = np.minimum(row[1:] + 1, row[:-1] + (np.frombuffer(text, np.uint8) != c))
        full = np.concatenate([[row[0] + 1], step])
        row = np.minimum.accumulate(full - np.arange(len(full))) + np.arange(len(full))
    return row.min()


def brute_force(docs, items):
    found = set()
    index = op.Index([(i, (t or "").lower()) for i, t in items])
    for doc, text, _ in docs:
        body = normal(text)
        for item, short in zip(index.short_item, index.short):
            if b" " + short.tobytes() + b" " in b" " + body.strip() + b" ":
                found.add((doc, item))
        for w, pattern in enumerate(index.text):
            if len(body) >= 8 and distance(pattern.tobytes(), body) <= index.edits[w]:
                found.add((doc, index.item[w]))
    return found


def spoiled(text, places):
    """The text with a letter exchanged, dropped or doubled at some places."""
    out = list(text)
    for k, p in enumerate(sorted(places, reverse=True)):
        out[p:p + 1] = [["Q"], [], [out[p]] * 2][k % 3]
    return "".join(out)


def corpus():
    items = [(k, prose(k, 40)) for k in range(6)] + [(6, "tiny"), (7, None), (8, ""), (9, prose(9, 5)), (0, prose(0, 40))]
    base = items[1][1]
    docs = [(i, prose(100 + i, 200), "s") for i in range(20)]
    docs += [
        (20, prose(1, 300) + " " + base + " " + prose(2000, 50), "s"),
        (21, base.upper().replace(" ", ",\n  "), "s"),
        (22, "x " + spoiled(base, range(5, len(base), 30)) + " y", "s"),
        (23, spoiled(base, range(5, len(base), 8)), "s"),
        (24, " ".join(base.split()[:22]), "s"), (25, " ".join(base.split()[10:16]), "s"),
        (26, None, "s"), (27, "", "s"), (28, "-- !! --", "s"), (29, items[9][1], "s"), (30, "so (Tiny) it is", "s"), (33, "tinyish", "s"),
        (31, prose(333, 3_000) + " " + items[3][1], "s"), (32, "é" + items[2][1] + "ß", "s"), (20, base, "s"), (None, base, "s")]
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    found = op.leaks(documents(spark, docs), table).collect()
    want = brute_force(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert {20, 21, 22, 24, 29, 30, 31, 32, None} <= {d for d, _ in want} and not {23, 25, 33} & {d for d, _ in want}
    one = next(r for r in found if r.doc_id == 31)
    text = next(t for i, t, _ in docs if i == 31).lower()[one["first"]:one["last"] + 1]
    assert text.strip().endswith(items[3][1]) and len(text) <= len(items[3][1]) + 8 and one.edits == 0


def test_blocks_of_the_benchmark_find_the_same(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    whole, parts = ({(r.doc_id, r.item_id, r.edits) for r in op.leaks(documents(spark, docs), table, block_chars=n).collect()}
                    for n in (op.BLOCK_CHARS, 200))
    assert whole == parts


def test_clean_rows_keep_all_columns(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    kept = op.without_leaks(documents(spark, docs), table, block_chars=400)
    bad = {d for d, _ in brute_force(docs, items)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _ in docs if i not in bad)
    assert kept.columns == documents(spark, docs).columns


def test_empty_tables(spark):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = documents(spark, [(1, prose(1, 50), "s")])
    assert op.leaks(some, nothing).count() == 0
    assert op.leaks(none, spark.createDataFrame([(1, prose(1, 50), "x")], ITEMS)).count() == 0
    assert op.without_leaks(some, nothing).count() == 1


def test_every_region_has_its_row(spark):
    item = prose(3, 40)
    text = "intro " + item + " " + prose(50, 300) + " " + item.upper() + " " + prose(51, 300) + " " + item[:110] + " end"
    table = spark.createDataFrame([(3, item, "x"), (4, "In Short", "x")], ITEMS)
    found = sorted(op.leaks(documents(spark, [(1, text, "s"), (2, "in  short, in short", "s")]), table).collect(), key=lambda r: (r.doc_id, r["first"]))
    places = [text.lower().index(item), text.lower().rindex(item), len(text) - 4 - 110]
    assert [r.doc_id for r in found] == [1, 1, 1, 2, 2]
    assert all(abs(r["first"] - p) <= 8 for r, p in zip(found, places)) and [r["first"] for r in found[3:]] == [0, 11]
    assert [r["last"] for r in found[3:]] == [8, 18] and [r.windows for r in found[3:]] == [1, 1]


def test_exact_pieces_are_found(spark):
    """Pieces of 96 and more characters cut from a long item, at any place."""
    item = prose(8, 120)
    table = spark.createDataFrame([(1, item, "x")], ITEMS)
    for n in (96, 100, 104, 112, 120, 128):
        cut = [item[k:k + n] for k in range(0, len(item) - n, 5)]
        rows = [(k, prose(500 + k, 30) + " " + piece.strip() + " " + prose(900 + k, 30), "s") for k, piece in enumerate(cut)]
        got = {r.doc_id for r in op.leaks(documents(spark, rows), table).collect()}
        assert len(got) >= 0.9 * len(rows), (n, len(got), len(rows))


def test_typographic_punctuation_is_folded(spark):
    item = "it's said - \"the quick brown fox isn't slow\" - and that the dog's owner, who's lazy, can't run (or won't) at all"
    fancy = item.replace("'", "\u2019").replace(" \"", " \u201c").replace("\"", "\u201d").replace(" - ", "\u00a0\u2014 ").replace("(", "\u3008").replace(")", "\u3009")
    assert normal(fancy) == normal(item) and normal("x\u00b2 \u00aa\u00b5 \u00ab\u00e9\u00bb") == normal("x\u00b2 \u00aa\u00b5 \u00e9")
    table = spark.createDataFrame([(1, item, "x")], ITEMS)
    assert [r.edits for r in op.leaks(documents(spark, [(5, fancy, "s")]), table).collect()] == [0]
