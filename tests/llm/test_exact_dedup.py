import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from isoplane.llm import exact_dedup as op
from tests.llm.helpers import DOCS, documents


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 20_000))
def test_fingerprints_of_parts_combine(data, at):
    at = min(at, len(data))
    hasher = op.Fingerprint()
    whole, left, right = (hasher.of(np.frombuffer(x, np.uint8)) for x in (data, data[:at], data[at:]))
    assert whole == [op.combine(a, at, b, base) for a, b, base in zip(left, right, op.BASES)]
    for value, base in zip(whole, op.BASES):
        assert value == sum(b * pow(base, i, op.PRIME) for i, b in enumerate(data[:300])) % op.PRIME or len(data) > 300


ROWS = [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "x"), (5, "", "x"), (6, "B", "x"), (7, "a ", "x"),
        (8, "é" * 3000, "x"), (9, "é" * 3000, "x"), (10, "é" * 2999 + "e", "x"), (3, "b", None), (None, "b", "x"), (None, "lone", "x")]


@pytest.mark.parametrize("huge", [8 << 20, 2_000])
def test_groups_match_brute_force(spark, huge):
    out = op.exact_duplicates(documents(spark, ROWS), huge_bytes=huge).collect()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_segments_give_the_same_fingerprints(spark):
    docs = documents(spark, ROWS)
    a, b = (sorted(map(repr, op.fingerprints(docs, h, 512).collect())) for h in (8 << 20, 1_000))
    assert a == b


def test_unequal_texts_with_equal_fingerprints_are_found(spark):
    docs = documents(spark, [(1, "x" * 70_000 + "a", "s"), (2, "x" * 70_000 + "b", "s"), (3, "same", "s"), (4, "same", "s")])
    text = F.col("text")
    members = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("quick"),
                          F.when(F.col("doc_id") < 3, 1).otherwise(2).cast("long").alias("gid"))
    assert [r.gid for r in op.unequal_groups(docs, members).collect()] == [1]


def test_collisions_are_split(spark, monkeypatch):
    monkeypatch.setattr(op, "BASES", (1, 1, 1))  # fingerprints are sums of bytes now
    docs = documents(spark, [(1, "ab", "s"), (2, "ba", "s"), (3, "ab", "s")])
    out = op.exact_duplicates(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_empty_table(spark):
    assert op.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
