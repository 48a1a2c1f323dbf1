import pytest
from pyspark.sql import functions as F

from isoplane.llm import sharding as op
from tests.llm.helpers import documents, prose


def keyed(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), op.uniform_key(text).alias("k1"),
                       op.uniform_key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k2"), F.col("doc_id").alias("tie"),
                       F.col("slot").alias("extra"))


def check(out, shards, total_rows):
    rows = out.collect()
    assert len(rows) == total_rows
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.k1, r.k2) for r in ordered] == sorted((r.k1, r.k2) for r in rows)
    return rows, sizes


def test_near_equal_and_groups_together(spark):
    rows = [(i, prose(i % 700, 5 + i % 60), "s") for i in range(900)] + [(900, None, "s"), (901, "", "s"), (None, "x", "s")]
    out, sizes = check(op.histogram_shards(keyed(documents(spark, rows)), 8), 8, len(rows))
    ideal = sum(sizes) / 8
    groups = {}
    for r in out:
        groups.setdefault(r.k1, set()).add(r.shard)
    assert max(map(len, groups.values())) == 1
    assert all(abs(s - ideal) <= 0.1 * ideal for s in sizes)


def test_a_hot_group_is_cut_between_its_rows(spark):
    rows = [(i, "the same text again and again" if i % 3 == 0 else prose(i, 6), "s") for i in range(3000)]
    _, sizes = check(op.histogram_shards(keyed(documents(spark, rows)), 8), 8, len(rows))
    assert max(sizes) - min(sizes) < 200


def test_tolerance_saves_rounds(spark, monkeypatch):
    docs = keyed(documents(spark, [(i, prose(i, 6), "s") for i in range(2000)]))
    seen = []
    real = op._histogram
    monkeypatch.setattr(op, "_histogram", lambda *a: seen.append(a[2]) or real(*a))
    rows = docs.select("k1", "k2", "size")
    total = rows.agg(F.sum("size")).first()[0]
    op.splitters(rows, 8, total, tolerance=0.01)
    loose = len(seen)
    op.splitters(rows, 8, total)
    assert loose == 1 < len(seen) - loose


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    docs = documents(spark, [(i, "t" * (i + 1), "s") for i in range(n)])
    check(op.histogram_shards(keyed(docs), 8), 8, n)


def test_repeated_rows_and_one_shard(spark):
    docs = documents(spark, [(1, "a", "s")] * 5)
    check(op.histogram_shards(keyed(docs), 8), 8, 5)
    check(op.histogram_shards(keyed(docs), 1), 1, 5)
