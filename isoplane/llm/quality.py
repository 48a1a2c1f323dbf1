"""Document quality by a byte-level convolutional network, trained and run in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Two channels feed
the filters: a learned embedding of the byte and whether the eight bytes from here on
also stand a few bytes earlier. Every learned filter slides over a chunk, its greatest
response is the chunk's feature, and the mean and the greatest feature over all chunks
are combined into one probability. Training sees a bounded sample of labelled whole
texts; scoring is a map over all documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.llm.arrays import blocks

CHUNK = 512
OVERLAP = 64
WIDTH = 6
STRIDE = 2
FILTERS = 16
DEPTH = 6
LAG = 32
SAMPLE = 800
SAMPLE_BYTES = 16 << 10
STEPS = 500
BATCH = 32
RATE = 0.01
SCORE_BYTES = 1 << 20


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 where the next eight bytes also stand up to LAG bytes earlier in the same text."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 8:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    length = np.diff(offsets)
    place = np.arange(n) - np.repeat(offsets[:-1], length)
    for lag in range(1, LAG + 1):
        same = eight[lag:] == eight[:-lag] if lag < n else np.zeros(0, bool)
        out[lag:] |= same & (place[lag:] >= lag)
    return out & (place <= np.repeat(length, length) - 8)


def chunked(data: np.ndarray, offsets: np.ndarray):
    """Bytes (0 beyond the end) and repeats of all chunks, and the text of each."""
    step = CHUNK - OVERLAP
    length = np.diff(offsets)
    many = np.maximum(1, -(-(length - OVERLAP) // step))
    doc = np.repeat(np.arange(len(length)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    place = (offsets[:-1][doc] + nth * step)[:, None] + np.arange(CHUNK)
    inside = place < offsets[1:][doc][:, None]
    place = np.where(inside, place, 0)
    if not len(data):
        return np.zeros(place.shape, np.uint8), np.zeros(place.shape, np.float32), doc
    twice = repeats(data, offsets)
    return np.where(inside, data[place], 0).astype(np.uint8), (twice[place] & inside).astype(np.float32), doc


class Network:
    """Weights and the forward and backward passes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "embed": f32(256, DEPTH, scale=0.5), "filters": f32(WIDTH, DEPTH, FILTERS, scale=0.2),
            "again": f32(WIDTH, FILTERS, scale=0.2), "bias": np.zeros(FILTERS, np.float32),
            "out": f32(2 * FILTERS, scale=0.1), "offset": np.zeros(1, np.float32)}

    def features(self, codes, again, places: bool = False):
        """Greatest response of every filter in every chunk, and where it is."""
        w = self.weights
        n = (CHUNK - WIDTH) // STRIDE + 1
        span = lambda k: slice(k, k + STRIDE * n, STRIDE)
        z = np.zeros((len(codes), n, FILTERS), np.float32)
        for k in range(WIDTH):
            z += (w["embed"] @ w["filters"][k])[codes[:, span(k)]]
            z += again[:, span(k), None] * w["again"][k]
        if places:
            at = z.argmax(1)
            best = np.take_along_axis(z, at[:, None], 1)[:, 0]
        else:
            at, best = None, z.max(1)
        return np.maximum(best + w["bias"], 0), at

    def pooled(self, features, doc, docs):
        """Mean and greatest chunk features of every text."""
        count = np.maximum(1, np.bincount(doc, minlength=docs))[:, None]
        mean = np.zeros((docs, FILTERS), np.float64)
        np.add.at(mean, doc, features)
        first = np.searchsorted(doc, np.arange(docs))
        return np.concatenate([mean / count, np.maximum.reduceat(features, first, axis=0)], 1), count

    def chunk_features(self, data, offsets):
        """Features of all chunks, a few chunks at a time, and the text of each."""
        codes, again, doc = chunked(data, offsets)
        return np.concatenate([self.features(codes[i:i + 128], again[i:i + 128])[0] for i in range(0, len(codes), 128)]), doc

    def squash(self, pooled):
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights["out"] + self.weights["offset"], -30, 30)))

    def probability(self, data, offsets):
        """One number per text."""
        found, doc = self.chunk_features(data, offsets)
        return self.squash(self.pooled(found, doc, len(offsets) - 1)[0])

    def probability_of_long(self, data, chunks: int = 2048):
        """The same for one text of any length, in runs of chunks that share one on either side."""
        step, last = CHUNK - OVERLAP, max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
        total, most = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
        for first in range(0, last, chunks):
            low, high = max(0, first - 1), min(last, first + chunks + 1)
            part = data[low * step:min(len(data), high * step + OVERLAP)]
            found, _ = self.chunk_features(part, np.array([0, len(part)]))
            found = found[first - low:first - low + min(chunks, last - first)]
            total, most = total + found.sum(0, dtype=np.float64), np.maximum(most, found.max(0))
        return self.squash(np.concatenate([total / last, most])[None])

    def gradients(self, data, offsets, labels, importance):
        """Of the weighted cross entropy of some texts."""
        w = self.weights
        codes, again, doc = chunked(data, offsets)
        found, at = self.features(codes, again, places=True)
        docs = len(labels)
        pooled, count = self.pooled(found, doc, docs)
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["offset"], -30, 30)))
        d = (p - labels) * importance / docs
        up = d[:, None] * w["out"]
        back = up[doc, :FILTERS] / count[doc]
        top = (found == pooled[doc, FILTERS:].astype(np.float32)).astype(np.float64)
        ties = np.zeros((docs, FILTERS))
        np.add.at(ties, doc, top)
        back += up[doc, FILTERS:] * top / ties[doc]
        back = (back * (found > 0)).astype(np.float32)
        g = {"out": pooled.T @ d, "offset": np.array([d.sum()]), "bias": back.sum(0)}
        g["filters"], g["again"], g["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["again"]), np.zeros_like(w["embed"])
        row = np.arange(len(codes))[:, None]
        for k in range(WIDTH):
            byte = codes[row, at * STRIDE + k]
            g["again"][k] = (again[row, at * STRIDE + k] * back).sum(0)
            g["filters"][k] = np.einsum("cfd,cf->df", w["embed"][byte], back)
            np.add.at(g["embed"], byte, back[:, :, None] * w["filters"][k].T[None])
        return g, p

    def fit(self, texts, labels, steps=STEPS, batch=BATCH, rate=RATE, seed=7):
        """Adam over shuffled batches; both classes weigh the same."""
        labels = np.asarray(labels, np.float64)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v, np.float64) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v, np.float64) for k, v in self.weights.items()}
        step, each = 0, -(-len(texts) // batch)
        for _ in range(-(-steps // each)):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = order[i:i + batch]
                parts = [texts[j] for j in own]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
                data = np.frombuffer(b"".join(parts), np.uint8)
                g, _ = self.gradients(data, offsets, labels[own], weight[own])
                step += 1
                pace = rate * max(0.02, 1 - step / steps)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - pace * change).astype(np.float32)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> list:
    """At most ``sample`` whole texts of either class, those first in the order of a hash."""
    learnable = labels.where((F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 != 2) & F.col("quality").isin(0, 1))
    one = learnable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    # Twice as many, since some texts are longer than a sampled one may be.
    chosen = [one.where(F.col("quality") == c).orderBy(place, "doc_id").limit(2 * sample) for c in (0, 1)]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most four times the sample
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    rows = short.join(wanted, "doc_id").withColumn("place", place)
    out = []
    for c in (0, 1):
        out += rows.where(F.col("quality") == c).orderBy("place", "doc_id", F.xxhash64("text")).limit(sample).select("text", "quality").collect()
    return [(r["text"].encode(), r["quality"]) for r in out]


def fit_network(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options):
    """A trained network, or the smoothed share of label 1 where only one class is known.

    Learns only from labels whose crc32 of the doc_id as text is not 2 modulo 4, at most
    ``sample`` texts per class of at most ``sample_bytes`` bytes each.
    """
    rows = labelled_sample(docs, labels, sample, sample_bytes)
    good = sum(q for _, q in rows)
    if good in (0, len(rows)):
        return (good + 9) / (len(rows) + 10)
    return Network().fit([t for t, _ in rows], [q for _, q in rows], **options).weights


def quality_scores(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """``docs`` with a probability of label 1 from every whole text (``text``).

    Null texts count as empty ones, whose score is what the network makes of no bytes.
    Equal texts have equal scores; nothing but the text is looked at. All columns pass;
    one called ``name`` is replaced. Empty tables stay empty.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != name]
    if isinstance(model, float):
        return docs.select(*rest, F.lit(model).alias(name))
    rows = docs.select(*rest, F.coalesce(F.col("text"), F.lit("")).alias("__body"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def score(batches):
        network = Network()
        network.weights = sent.value
        for part, data, offsets in blocks(batches, "__body", SCORE_BYTES):
            p = network.probability_of_long(data) if len(data) > SCORE_BYTES and part.num_rows == 1 else network.probability(data, offsets)
            kept = part.drop_columns(["__body"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(p.astype(np.float64))], [*kept.schema.names, name])

    schema = docs.select(*rest, F.lit(0.0).alias(name)).schema
    return rows.mapInArrow(score, schema)
