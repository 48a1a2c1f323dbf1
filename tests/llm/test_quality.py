import zlib

import numpy as np
import pytest

from isoplane.llm import quality as op
from tests.llm.helpers import DOCS, documents, prose


def bytes_of(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def junk(seed, n):
    word = prose(seed, 1)
    return " ".join([word] * n) if seed % 2 else " ".join(w.upper() + "!!" for w in prose(seed, n).split())


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, op.CHUNK, op.CHUNK + 1, 5000):
        data = np.arange(n) % 255 + 1
        codes, _, doc = op.chunked(data.astype(np.uint8), np.array([0, n]))
        step = op.CHUNK - op.OVERLAP
        seen = {k * step + i for k in range(len(codes)) for i in range(op.CHUNK) if codes[k, i]}
        assert seen == set(range(n)) and len(doc) == len(codes) >= 1


def test_repeats_do_not_look_into_other_texts():
    data, at = bytes_of(["ab cd ef gh", "ab cd ef gh", "xyzw " * 6])
    out = op.repeats(data, at)
    assert not out[:22].any() and out[27:44].all()
    alone, _ = bytes_of(["xyzw " * 6])
    assert (out[22:] == op.repeats(alone, np.array([0, len(alone)]))).all()


def test_gradients_are_those_of_the_loss():
    texts = [prose(i, 60) for i in range(4)] + [junk(i, 60) for i in range(4)]
    labels, weight = np.array([1.0] * 4 + [0.0] * 4), np.ones(8)
    data, at = bytes_of(texts)
    net = op.Network()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        p = net.probability(data, at)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    g, _ = net.gradients(data, at, labels, weight)
    for name, place in (("out", (3,)), ("out", (op.FILTERS + 3,)), ("offset", (0,)), ("bias", (2,)), ("filters", (1, 2, 3)), ("filters", (4, 0, 7))):
        old, step = net.weights[name][place], 1e-3
        net.weights[name][place] = old + step
        up = loss()
        net.weights[name][place] = old - step
        down = loss()
        net.weights[name][place] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][place], rel=0.1, abs=1e-3)


def test_long_texts_score_like_short_ones():
    net = op.Network()
    for n in (1, 600, 3000, 20_011):
        data, at = bytes_of([("some words and more of them " * 800)[:n]])
        assert net.probability(data, at) == pytest.approx(net.probability_of_long(data, 3), rel=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = [(i, prose(i, 20 + i % 200) if i % 3 else junk(i, 20 + i % 200), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (5000, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + [(401, None, "s"), (402, "", "s"), (1, rows[1][1], "s"), (403, "word " * 60_000, "s")])
    model = op.fit_network(docs, labels)
    out = op.quality_scores(docs, model, "slot")
    assert out.columns == ["doc_id", "text", "source", "slot"]
    scores = {}
    for r in out.collect():
        scores.setdefault(r.doc_id, set()).add(r.slot)
        assert 0 <= r.slot <= 1
    assert all(len(s) == 1 for s in scores.values()) and scores[401] == scores[402]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(min(scores[i]) >= 0.7) == (i % 3 > 0) for i in held]) >= 0.95
    assert op.quality_scores(spark.createDataFrame([], DOCS), model).count() == 0


def test_without_both_classes_the_share_is_the_score(spark):
    docs = documents(spark, [(i, "text", "s") for i in range(8)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.fit_network(docs, none) == 0.9
    assert {r.score for r in op.quality_scores(docs, 0.9).collect()} == {0.9}
    bad = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, quality int")
    assert op.fit_network(docs, bad) < 0.7


def plain_probability(weights, raw):
    """The network on one text, one chunk, window and filter at a time."""
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    again = [any(raw[i:i + 8] == raw[i - lag:i - lag + 8] for lag in range(1, op.LAG + 1) if i >= lag) and i + 8 <= len(raw) for i in range(len(raw))]
    step, found = op.CHUNK - op.OVERLAP, []
    for first in range(0, max(1, len(raw) - op.OVERLAP), step):
        codes = list(raw[first:first + op.CHUNK]) + [0] * (op.CHUNK - len(raw[first:first + op.CHUNK]))
        twice = again[first:first + op.CHUNK] + [False] * (op.CHUNK - len(again[first:first + op.CHUNK]))
        best = np.full(op.FILTERS, -np.inf)
        for at in range(0, op.CHUNK - op.WIDTH + 1, op.STRIDE):
            value = sum(w["embed"][codes[at + k]] @ w["filters"][k] + twice[at + k] * w["again"][k] for k in range(op.WIDTH))
            best = np.maximum(best, value)
        found.append(np.maximum(best + w["bias"], 0))
    both = np.concatenate([np.mean(found, axis=0), np.max(found, axis=0)])
    return 1 / (1 + np.exp(-(both @ w["out"] + w["offset"][0])))


def test_forward_pass_matches_plain_loops():
    net = op.Network(3)
    texts = ["", "x", "eight by", prose(1, 90), junk(1, 60), "ünïcödé " * 120, prose(2, 200) + "repeat me " * 40]
    got = net.probability(*bytes_of(texts))
    assert got == pytest.approx([plain_probability(net.weights, t.encode()) for t in texts], rel=1e-4)
