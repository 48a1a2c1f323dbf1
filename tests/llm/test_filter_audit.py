import itertools
import random

import pytest
from pyspark.sql import functions as F

from isoplane.llm.filter_audit import Diagram, adjacent_swaps, all_orders, failure_masks, filter_audit
from tests.llm.helpers import prose


def brute_force(names, counts):
    """Steps of all orders by walking every mask through every order."""
    rows, shapley = [], dict.fromkeys(names, 0)
    for order in itertools.permutations(range(len(names))):
        left = dict(counts)
        for k, f in enumerate(order, 1):
            gone = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if not m >> f & 1}
            total = lambda of, j: sum(c[j] for c in of.values())
            failing = {m: c for m, c in counts.items() if m >> f & 1}
            alone = {m: c for m, c in counts.items() if m == 1 << f}
            shapley[names[f]] += total(gone, 0)
            rows.append(["".join(names[g] for g in order), k, total(left, 0), total(gone, 0), total(failing, 0) - total(gone, 0),
                         total(alone, 0), total(gone, 1), total(gone, 2), names[f]])
    return sorted((*r[:-1], shapley[r[-1]]) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


@pytest.mark.parametrize("seed", range(6))
def test_diagrams_match_brute_force(seed):
    r = random.Random(seed)
    n = 2 + seed % 4
    counts = {m: (v := r.randrange(6), r.randint(0, v), r.randint(0, v)) for m in range(1 << n) if r.random() < 0.7}
    names = list("ABCDE")[:n]
    assert all_orders(names, counts) == brute_force(names, counts)


def test_diagrams_share_nodes_and_swap_back():
    diagram = Diagram(list("ABC"), {m: (2, 1, 0) for m in range(8)})
    assert [len(level) for level in diagram.levels] == [1, 1, 1] and diagram.root.weight == (16, 8, 0)
    mixed = Diagram(list("ABC"), {m: (m, 0, 0) for m in range(8)})
    before = mixed.steps()
    mixed.swap(1)
    assert mixed.order == ["A", "C", "B"] and mixed.steps() != before
    mixed.swap(1)
    assert mixed.steps() == before
    assert all(w == (0, 0, 0) for _, *ws in Diagram(list("AB"), {}).steps() for w in ws)


def flags(rows, labels):
    """Mask, good and toxic of every row, one at a time."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang in rows:
        t, words = t or "", (t or "").split()
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        own = [x for x in labels if x[0] == i and i is not None]
        yield (lang or "", sum(1 << k for k, f in enumerate(fails) if f), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own))


def test_masks_and_audit_match_brute_force(spark):
    r = random.Random(4)
    texts = [prose(k, r.choice([5, 199, 200, 260]), r.choice([40, 400])) + r.choice(["", " #", " ABC" * 80]) for k in range(12)] + [None, "", " \t"]
    rows = [(r.choice([*range(40), None]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(i % 45, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(60)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit("mine").alias("quality"), F.lit(1).alias("mask"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    want = {}
    for part, mask, good, toxic in flags(rows, labels):
        n, g, t = want.get((part, mask), (0, 0, 0))
        want[part, mask] = (n + 1, g + good, t + toxic)
    masks = failure_masks(docs, known)
    assert {(x.part, x.mask): (x.n, x.good, x.toxic) for x in masks.collect() if x.n} == want
    got = filter_audit(masks, list("ABCDE"))
    for part in ("", "en", "de"):
        counts = {m: c for (p, m), c in want.items() if p == part}
        assert sorted(tuple(x)[1:] for x in got.where(F.col("part") == part).collect()) == brute_force(list("ABCDE"), counts)
    assert got.count() == 3 * 600


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(failure_masks(docs, labels), list("ABCDE")).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    out = filter_audit(failure_masks(one, labels), list("ABCDE"))
    assert out.count() == 600 and out.where("removed = 1").select("step").distinct().count() == 5
