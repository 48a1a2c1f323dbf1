import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from isoplane.llm import queries, rarity_digest as op
from isoplane.llm.arrays import text_bytes
from tests.llm.helpers import documents, edited as replaced, prose
from tests.llm.test_queries import SF_DIR

TEXTS = ["", "a", "short text", "x" * 500, prose(1, 4), prose(1, 5), prose(2, 8), prose(3, 15), prose(4, 400), "ünï " * 60, prose(5, 3_000, 10**6)]


def windows(raw):
    return [raw[i:i + op.WINDOW] for i in range(len(raw) - op.WINDOW + 1)]


def level(window):
    top = round(op.WINDOW * math.log2(op.WINDOW) * op.SCALE)
    total = sum(round(k * math.log2(k) * op.SCALE) for k in Counter(window).values())
    return min((top - total) * op.LEVELS // top, op.LEVELS - 1)


def plain_features(raw, ranks):
    """Selected windows of one text, one span at a time."""
    if not raw:
        return []
    rank = [ranks[level(w)] for w in windows(raw)]
    points = Counter()
    for at in range(len(rank) - op.SPAN + 1):
        points[min(range(at, at + op.SPAN), key=lambda i: (rank[i], i))] += 1
    if 0 < len(rank) < op.SPAN:
        points[min(range(len(rank)), key=lambda i: (rank[i], i))] = op.SPAN
    chosen = sorted(i for i, n in points.items() if n >= op.POINTS) or [max(range(max(len(rank), 1)), key=lambda i: (points[i], -i))]
    return [raw[i:i + op.WINDOW] for i in chosen]


def plain_digest(raw, ranks):
    found = plain_features(raw, ranks)
    out = []
    for at in range(0, len(found), op.FILTER_FEATURES):
        bits = np.zeros(op.FILTER_BITS, np.uint8)
        for window in found[at:at + op.FILTER_FEATURES]:
            data = np.frombuffer(window, np.uint8)
            h = int(op.mixed(op.span_hashes(data, np.array([0]), np.array([len(data)])) ^ op.MIX)[0])
            for k in range(op.HASHES):
                bits[(h >> 11 * k) % op.FILTER_BITS] = 1
        out.append(np.packbits(bits))
    return np.array(out, np.uint8).reshape(-1, op.FILTER_BITS // 8)


def plain_ranks(texts):
    counts = Counter(level(w) for t in texts for w in windows(t.encode()))
    weak = op.WEAK_BITS / math.log2(op.WINDOW) * op.LEVELS
    order = sorted(range(op.LEVELS), key=lambda v: (v < weak, counts[v], v))
    return {v: i for i, v in enumerate(order)}


def plain_likeness(a, b):
    if a.tobytes() == b.tobytes():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a

    def score(x, y):
        x, y = np.unpackbits(x), np.unpackbits(y)
        both, nx, ny = int((x & y).sum()), int(x.sum()), int(y.sum())
        chance = nx * ny / op.FILTER_BITS
        noise = op.SIGNIFICANT * math.sqrt(chance * (1 - nx / op.FILTER_BITS) * (1 - ny / op.FILTER_BITS))
        return (both - chance) / (min(nx, ny) - chance) if both > chance + noise else 0.0

    def best(x, y):
        weights = [int(np.unpackbits(f).sum()) for f in x]
        return sum(w * max(score(f, g) for g in y) for w, f in zip(weights, x)) / sum(weights)

    return best(a, b) if len(a) != len(b) else (best(a, b) + best(b, a)) / 2


@pytest.fixture(scope="module")
def ranks():
    return plain_ranks(TEXTS)


def arrays(texts):
    return text_bytes(pa.array(texts, pa.string()))


def test_levels_across_pieces(monkeypatch):
    data, _ = arrays(["".join(TEXTS)])
    want = [level(w) for w in windows(data.tobytes())]
    assert op.levels_of(data).tolist() == want
    monkeypatch.setattr(op, "PIECE", 100)
    assert op.levels_of(data).tolist() == want


def test_ranks_cover_all_documents(spark, ranks):
    got = op.fit_ranks(documents(spark, [(i, t, "s") for i, t in enumerate([*TEXTS, None])]).repartition(4))
    assert got.tolist() == [ranks[v] for v in range(op.LEVELS)]


def test_digests_match_plain_ones(ranks):
    array = np.array([ranks[v] for v in range(op.LEVELS)])
    together = op.digests(*arrays(TEXTS), array)
    for text, got in zip(TEXTS, together):
        assert np.array_equal(got, plain_digest(text.encode(), ranks)), text[:20]
        assert np.array_equal(op.read(op.written(got)), got)
    assert len(together[-1]) > 1 and len(together[0]) == 0


def test_likeness(ranks):
    array = np.array([ranks[v] for v in range(op.LEVELS)])
    base = prose(7, 900, 10**6)
    texts = [base, replaced(base, 1, 0.02), replaced(base, 2, 0.5), prose(8, 900, 10**6), base[:len(base) // 2], "", "", prose(9, 30)]
    found = op.digests(*arrays(texts), array)
    for a in found:
        for b in found:
            assert op.likeness(a, b) == pytest.approx(plain_likeness(a, b), abs=1e-9)
            assert op.likeness(a, b) == pytest.approx(op.likeness(b, a))
    near = [op.likeness(found[0], f) for f in found]
    assert near[0] == 1 and near[1] > 0.6 and near[2] < 0.3 and near[3] < 0.05 and near[4] > 0.8 and near[5] == 0 and op.likeness(found[5], found[6]) == 1


def brute_force(rows, ranks, key):
    rows = sorted(((i, t or "") for i, t, _ in rows), key=key)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        own, changed, nxt = (plain_digest(x.encode(), ranks) for x in (t, new, after))
        yield (i, len(t), hashlib.sha256(new.encode()).hexdigest(), op.written(own), op.written(changed),
               round(plain_likeness(own, changed), 9), round(plain_likeness(own, nxt), 9))


def result(df):
    return sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                  for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 23])
def test_rows_match_brute_force(spark, ranks, n):
    rows = [(100 - 7 * k, TEXTS[k % len(TEXTS)] if k % 9 else None, "s") for k in range(n)]
    array = np.array([ranks[v] for v in range(op.LEVELS)])
    out = op.edited_likeness(documents(spark, rows).repartition(5), array)
    assert result(out) == sorted(brute_force(rows, ranks, lambda r: r[0]))


def test_repeated_rows_missing_ids_and_empty_table(spark, ranks):
    array = np.array([ranks[v] for v in range(op.LEVELS)])
    rows = [(None, "b" * 90, "s"), (1, TEXTS[7], "s"), (1, TEXTS[7], "s"), (1, TEXTS[8], "s"), (2, None, "s"), (None, "a" * 90, "s")]
    out = op.edited_likeness(documents(spark, rows), array).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((i or 0, len(t or "")) for i, t, _ in rows)
    assert {r.fingerprint for r in out if r.n_chars == len(TEXTS[7])} == {op.written(plain_digest(TEXTS[7].encode(), ranks))}
    assert op.edited_likeness(documents(spark, rows).limit(0), array).count() == 0
    assert op.fingerprints(documents(spark, rows), array).count() == 6


def test_query_on_its_table(spark):
    """Every row's fingerprints and likeness from plain versions over the whole table."""
    rows = [(r.doc_id, r.text, None) for r in queries.table(spark, SF_DIR, "documents").collect()]
    known = plain_ranks([t or "" for _, t, _ in rows])
    assert result(queries.QUERIES["op11_rarity_digest"](spark, SF_DIR)) == sorted(brute_force(rows, known, lambda r: r[0]))
