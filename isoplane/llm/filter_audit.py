"""How filters interact: every order's steps from count-weighted decision diagrams.

Spark reduces the documents to the number of rows of every failure mask of a part. A
part's masks become a decision diagram with one level per filter, whose nodes carry the
rows beneath them and are shared where their counts are equal. Adjacent levels are
swapped until every order of the filters has stood; in each, the path on which
everything passes gives what every step removes and keeps.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

STEP_COLUMNS = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
                "unique_fails long, good_lost long, toxic_lost long, shapley long")


class Node:
    """Rows beneath (``weight``: all, good, toxic), and where passing (``low``) and failing (``high``) lead."""

    __slots__ = ("high", "low", "weight")

    def __init__(self, low, high, weight):
        self.low, self.high, self.weight = low, high, weight


class Diagram:
    """A decision diagram of failure masks; ``order[k]`` names the filter of level ``k``.

    Bit ``k`` of a mask says that filter ``k`` fails. Below a node without rows there is nothing.
    """

    def __init__(self, names: list[str], counts: dict[int, tuple[int, ...]]):
        self.order = list(names)
        self.zero = (0,) * len(next(iter(counts.values()), (0, 0, 0)))
        self.levels = [{} for _ in names]
        leaves, layer = {}, {}
        for mask, weight in counts.items():
            if any(weight):
                layer[mask] = leaves.setdefault(weight, Node(None, None, weight))
        for level in reversed(range(len(names))):  # join the two halves that differ in the level's bit
            bit, above = 1 << level, {}
            for mask in {m & ~bit for m in layer}:
                above[mask] = self._node(level, layer.get(mask), layer.get(mask | bit))
            layer = above
        self.root = layer.get(0)

    def weight(self, node) -> tuple[int, ...]:
        return node.weight if node else self.zero

    def _node(self, level: int, low, high):
        """The only node of a level with these children, None without any."""
        if low is None and high is None:
            return None
        found = self.levels[level].get((low, high))
        if found is None:
            weight = tuple(a + b for a, b in zip(self.weight(low), self.weight(high)))
            found = self.levels[level][low, high] = Node(low, high, weight)
        return found

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; its nodes stay what their parents point to."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            (ll, lh), (hl, hh) = ((c.low, c.high) if c else (None, None) for c in (node.low, node.high))
            node.low, node.high = self._node(level + 1, ll, hl), self._node(level + 1, lh, hh)
            self.levels[level][node.low, node.high] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple]:
        """Along the path that passes everything: filter, weight kept, weight removed."""
        node, out = self.root, []
        for name in self.order:
            low, high = (node.low, node.high) if node else (None, None)
            out.append((name, self.weight(low), self.weight(high)))
            node = low
        return out


def adjacent_swaps(n: int):
    """Upper levels of the swaps that lead once through all orders of ``n`` levels.

    The last thing sweeps through all others, which take one swap of their own after each sweep.
    """
    if n < 2:
        return
    at_top = False
    for inner in [None, *adjacent_swaps(n - 1)]:
        if inner is not None:
            yield inner + at_top
        yield from range(n - 1) if at_top else range(n - 2, -1, -1)
        at_top = not at_top


def all_orders(names: list[str], counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Rows of ``STEP_COLUMNS`` without the part, for every order of the filters."""
    diagram = Diagram(names, counts)
    orders = {"".join(diagram.order): diagram.steps()}
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        orders["".join(diagram.order)] = diagram.steps()
    failing = {steps[0][0]: steps[0][2][0] for steps in orders.values()}  # first of its order, a filter removes all it fails
    alone = {steps[-1][0]: steps[-1][2][0] for steps in orders.values()}  # last, only what no other removes
    shapley = dict.fromkeys(names, 0)
    for steps in orders.values():
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [(order, k, kept[0], gone[0], failing[name] - gone[0], alone[name], gone[1], gone[2], shapley[name])
            for order, steps in sorted(orders.items()) for k, (name, kept, gone) in enumerate(steps, 1)]


def filter_audit(masks: DataFrame, names: list[str]) -> DataFrame:
    """Steps of all orders of the filters ``names`` (single letters), for every part.

    ``masks`` holds ``part``, ``mask`` (bit k: filter k fails), ``n``, ``good`` and ``toxic`` rows; one
    part's rows, at most two to the number of filters, are a task's group. Parts without
    rows do not appear; an empty table gives an empty one. Orders grow with the
    factorial of the filters, so keep those few.
    """
    summed = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])

    def audit(frame: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(frame["mask"], frame["n"], frame["good"], frame["toxic"])}
        out = pd.DataFrame(all_orders(names, counts), columns=[c.split()[0] for c in STEP_COLUMNS.split(", ")[1:]])
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    return summed.groupBy("part").applyInPandas(audit, STEP_COLUMNS)


def text_failures(text: Column) -> list[Column]:
    """Under 200 words; fewer than half distinct; over 3 % capitals; a character of ``#$%&*|``."""
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame, failures=text_failures) -> DataFrame:
    """Rows by ``part`` and failure ``mask``: ``n`` of them, ``good`` and ``toxic`` ones.

    ``docs`` holds ``doc_id``, ``text`` and ``lang`` (the part; null: empty), ``labels`` ``doc_id``, ``quality`` and
    ``toxic``; of several labels of a document the greatest counts, without any it is neither
    good nor toxic. ``failures(text)`` gives the conditions on the text, the lowest bits; the
    last bit says that a smaller doc_id has the same text, in any part. Null texts are empty.
    Rows without a doc_id have no label, are copies of nothing and nothing is a copy of
    them. Repeated rows count each; of a doc_id's rows none is a copy of another. Other
    columns are ignored.

    Texts do not travel, their SHA-256 does. Equal texts are counted map-side by part,
    mask and labels before they meet, so a group of copies of any size is a few rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(text))])
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("mask"), digest.alias("digest"))
    # Rows without a doc_id meet no label; a salt keeps them from meeting each other in one task.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(0).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0))
    no = F.lit(False)
    labelled = rows.join(known, ["doc_id", "salt"], "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = labelled.groupBy("doc_id", "salt", *kind).agg(F.count(F.lit(1)).alias("c"))
    nameless = F.col("doc_id").isNull()
    first = F.min(F.when(~nameless, F.struct("doc_id", "c")))
    alike = each.groupBy(*kind).agg(F.sum("c").alias("n"), F.sum(F.when(nameless, F.col("c")).otherwise(0)).alias("free"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a few rows per text
    passing = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    copy_bit = 1 << len(failures(text))
    split = alike.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - passing).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
