"""Document fingerprints of improbable features in chained Bloom filters.

Every window of bytes has an entropy; how rare that entropy is among all windows of
the documents ranks it. Within every span of consecutive windows the rarest one gains
a point, and windows with enough points are a document's features. In the order of the
text they fill a chain of small Bloom filters, whose bits in common, less what chance
explains, say how alike two documents are.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from isoplane.llm.arrays import MIX, blocks, mixed, ragged, span_hashes, text_bytes
from isoplane.llm.storage import stored

WINDOW = 32
SPAN = 64
POINTS = 16
LEVELS = 1024
WEAK_BITS = 1.0
FILTER_BITS = 2048
FILTER_FEATURES = 128
HASHES = 5
SIGNIFICANT = 4.0
#: Bytes that are ranked at once: a piece of a block that stays in the processor's cache.
PIECE = 1 << 17
SCALE = 1 << 10
#: count * log2(count) for the counts of one byte value in a window, in whole parts of SCALE.
SPREAD = np.array([0] + [round(k * np.log2(k) * SCALE) for k in range(1, WINDOW + 1)], np.int32)
GAIN = np.diff(SPREAD)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level 0 (one byte value) to LEVELS - 1 of the entropy of every window of ``data``.

    Moving a window by one byte changes its sum of count * log2(count) by what the byte that
    leaves and the byte that enters contribute; whole numbers keep equal windows equal.
    """
    n = len(data) - WINDOW + 1
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):  # equal bytes among the WINDOW - 1 before and after every byte
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(SPREAD[np.bincount(data[:WINDOW], minlength=256)].sum())
    change = GAIN[before[WINDOW:]] - GAIN[after[:n - 1]]
    total = np.concatenate([[first], first + np.cumsum(change, dtype=np.int64)])
    return np.minimum((int(SPREAD[-1]) - total) * LEVELS // int(SPREAD[-1]), LEVELS - 1).astype(np.int16)


def levels_of(data: np.ndarray) -> np.ndarray:
    """``entropy_levels`` of texts end to end, piece by piece."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    return np.concatenate([entropy_levels(data[at:min(at + PIECE, n) + WINDOW - 1]) for at in range(0, n, PIECE)])


def whole_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every text, none across two texts."""
    return offsets[:-1], np.maximum(np.diff(offsets) - WINDOW + 1, 0)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of every level, 0 for the rarest; windows of less than WEAK_BITS of entropy come after all others."""
    weak = np.arange(LEVELS) < WEAK_BITS / np.log2(WINDOW) * LEVELS
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts, weak))] = np.arange(LEVELS)
    return rank


def fit_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels by the windows of all texts of ``docs``; LEVELS sums reach the driver."""
    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for _, data, offsets in blocks(batches, "text", PIECE * 8):
            start, many = whole_windows(offsets)
            total += np.bincount(levels_of(data)[ragged(start, many)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = text.mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for row in rows:
        counts[row["level"]] = row["n"]
    return ranks_of(counts)


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows of every text in its order, and the texts' offsets among them.

    A window is selected when it is the rarest, the first on ties, in at least POINTS of the
    spans of SPAN windows. A text of fewer windows is one span; a text where none has enough
    points gives its window of most points, one shorter than a window itself, an empty one nothing.
    """
    size = np.diff(offsets)
    start, many = whole_windows(offsets)
    points = np.zeros(len(data), np.int64)
    if len(data) >= WINDOW:
        place = np.arange(len(data) - WINDOW + 1)
        key = (ranks[levels_of(data)] << 40) | place
        low, width = key, 1
        while width < SPAN:  # the least of 2, 4, ... consecutive windows
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        spans = ragged(start, np.maximum(many - SPAN + 1, 0))
        points += np.bincount(low[spans] & ((1 << 40) - 1), minlength=len(data)) if len(spans) else 0
        few = np.flatnonzero((many > 0) & (many < SPAN))
        if len(few):
            at = ragged(start[few], many[few])
            least = np.minimum.reduceat(key[at], np.concatenate([[0], np.cumsum(many[few])[:-1]])) & ((1 << 40) - 1)
            points[least] = SPAN
    chosen = points >= POINTS
    counted = np.concatenate([[0], np.cumsum(chosen)])
    for i in np.flatnonzero((size > 0) & (counted[offsets[1:]] == counted[offsets[:-1]])):
        chosen[offsets[i] + int(np.argmax(points[offsets[i]:offsets[i + 1]]))] = True
    at = np.flatnonzero(chosen)
    ends = np.minimum(at + WINDOW, offsets[np.searchsorted(offsets, at, "right")])
    return span_hashes(data, at, ends), np.searchsorted(at, offsets)


def filters(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chained filters of every text as packed bits, one row each, and the texts' offsets among them."""
    many = np.diff(offsets)
    chain = np.concatenate([[0], np.cumsum(-(-many // FILTER_FEATURES))])
    nth = np.arange(len(hashes)) - np.repeat(offsets[:-1], many)
    row = np.repeat(chain[:-1], many) + nth // FILTER_FEATURES
    bits = np.zeros((chain[-1], FILTER_BITS), np.uint8)
    h = mixed(hashes ^ MIX)
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), chain


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of every text, a matrix of bytes each."""
    packed, chain = filters(*features(data, offsets, ranks))
    return [packed[a:b] for a, b in zip(chain[:-1], chain[1:])]


def written(digest: np.ndarray) -> str:
    """A digest as text: base64 of its filters, empty for an empty document."""
    return base64.b64encode(digest.tobytes()).decode()


def read(text: str) -> np.ndarray:
    """The digest that ``written`` gave."""
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """How alike two digests are, 0 to 1: 1 for equal ones, 0 for an empty and a full one.

    Two filters share ``e`` bits, ``c`` of them by chance (the product of their bits over the
    filter's size) and at most ``m``, the bits of the emptier one. They score
    ``(e - c) / (m - c)``, or 0 where e lies within SIGNIFICANT deviations of c. Every filter of
    the shorter chain takes its best score; their mean, weighted by bits, is the result, of
    both directions for chains of equal length. Chains are compared in blocks of filters.
    """
    if left.shape == right.shape and np.array_equal(left, right):
        return 1.0
    if not len(left) or not len(right):
        return 0.0
    if len(left) > len(right):
        left, right = right, left
    a, b = (np.unpackbits(x, axis=1).astype(np.float32) for x in (left, right))
    na, nb = a.sum(1).astype(np.float64), b.sum(1).astype(np.float64)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 1024):
            x, y = na[i:i + 1024, None], nb[None, j:j + 1024]
            both = (a[i:i + 1024] @ b[j:j + 1024].T).astype(np.float64)
            least, chance = np.minimum(x, y), x * y / FILTER_BITS
            noise = SIGNIFICANT * np.sqrt(chance * (1 - x / FILTER_BITS) * (1 - y / FILTER_BITS))
            score = np.where(both > chance + noise, (both - chance) / np.maximum(least - chance, 1e-9), 0.0)
            best_a[i:i + 1024] = np.maximum(best_a[i:i + 1024], score.max(1))
            best_b[j:j + 1024] = np.maximum(best_b[j:j + 1024], score.max(0))
    out = np.average(best_a, weights=na)
    if len(a) == len(b):
        out = (out + np.average(best_b, weights=nb)) / 2
    return float(min(max(out, 0.0), 1.0))


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row; see ``edited_likeness`` for what odd rows give."""
    known = docs.sparkSession.sparkContext.broadcast(ranks)

    def describe(batches):
        for part, data, offsets in blocks(batches, "text", PIECE * 8):
            out = [written(d) for d in digests(data, offsets, known.value)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(describe, f"doc_id {kind}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The last half of ``text`` (code points, rounded down) replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _pairs(rows: list[tuple], following: list[str], ranks: np.ndarray) -> list[tuple]:
    """Results of ``(doc_id, text, digest)`` rows with the texts and digests that follow them."""
    made = [edited(text, after) for (_, text, _), (after, _) in zip(rows, following)]
    out = []
    for (doc, text, own), (_, nxt), new, print_ in zip(rows, following, made, digests(*text_bytes(pa.array(made, pa.string())), ranks)):
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(print_),
                    likeness(own, print_), likeness(own, nxt)))
    return out


RESULT = ["n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]
EDGES = ["part int", "head string", "tail string"]


def _batch(rows: list[tuple], names: list[str], doc_type) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    columns = list(zip(*rows)) if rows else [[]] * (1 + len(names))
    arrays = [pa.array(columns[0], doc_type)] + [pa.array(c, kinds[n.split()[1]]) for c, n in zip(columns[1:], names)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[n.split()[0] for n in names]])


def edited_likeness(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Every row's fingerprint against that of its edited text and that of the next document.

    ``docs`` holds ``doc_id`` and ``text``; the edited text has its last half replaced by the
    beginning of the next document in ascending doc_id, the first one after the last.
    Returns ``doc_id``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    Null texts are empty, their fingerprint is the empty string; two empty ones are alike (1),
    an empty and another one are not (0). Rows without a doc_id come first, rows of equal
    doc_id follow a hash of their text, so repeated rows follow each other. Other columns
    are ignored; an empty table gives an empty one.

    The rows are dealt out by range of their order and travel once. A part's last row and
    its successor, the first row of the next part with any, meet in a join afterwards.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(ranks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def walk(batches):
        part, carry, doc_type = TaskContext.get().partitionId(), None, None
        edge = lambda row, head, tail: (*row, part, head, tail)
        head = None  # the first row's text, until its result is known
        for rows, data, offsets in blocks(batches, "text", PIECE * 8):
            doc_type = rows.column(0).type
            texts, own = rows.column(1).to_pylist(), digests(data, offsets, known.value)
            here = list(zip(rows.column(0).to_pylist(), texts, own))
            if carry is None:
                head = texts[0]
            else:
                here.insert(0, carry)
            carry = here[-1]
            done = _pairs(here[:-1], [(t, d) for _, t, d in here[1:]], known.value)
            out = [edge(r, head if k == 0 else None, None) for k, r in enumerate(done)]
            head = head if not done else None
            yield _batch(out, RESULT + EDGES, doc_type)
        if carry is not None:
            doc, text, own = carry
            yield _batch([edge((doc, len(text), None, written(own), None, None, None), head, text)], RESULT + EDGES, doc_type)

    walked = stored(ranged.mapInArrow(walk, f"doc_id {kind}, {', '.join(RESULT + EDGES)}"))
    heads = walked.where("head is not null").select("part", "head")
    parts = sorted(row["part"] for row in heads.select("part").collect())  # at most one per partition
    after = spark.createDataFrame(list(zip(parts[-1:] + parts[:-1], parts)), "part int, after int")
    last = walked.where("tail is not null").select("doc_id", "part", "tail").join(F.broadcast(after), "part").join(
        heads.select(F.col("part").alias("after"), "head"), "after")

    def close(batches):
        for batch in batches:
            docs_, tails, heads_ = (batch.column(i).to_pylist() for i in range(3))
            own, nxt = (digests(*text_bytes(pa.array(x, pa.string())), known.value) for x in (tails, heads_))
            yield _batch(_pairs(list(zip(docs_, tails, own)), list(zip(heads_, nxt)), known.value), RESULT, batch.column(0).type)

    closed = last.select("doc_id", "tail", "head").mapInArrow(close, f"doc_id {kind}, {', '.join(RESULT)}")
    return walked.where("tail is null").select(closed.columns).unionByName(closed)
