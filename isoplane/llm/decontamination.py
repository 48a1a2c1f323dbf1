"""Benchmark passages in documents, by q-gram lemma filtering.

Both sides are lower-cased and everything but letters and digits becomes one space. A
benchmark item is cut into overlapping windows, which begin so densely that every piece
of a window's length lies within the edits of one. A text region within k edits of a
window of m characters shares at least ``m - q + 1 - k * q`` q-grams with it, all on
diagonals at most k apart. Shared q-grams are therefore counted per window in
overlapping bands of diagonals, and the bands that reach the bound are verified by an
alignment that stays inside the band.

The benchmark travels to the tasks in blocks of bounded size, one pass over the
documents per block; documents never move.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.llm.arrays import MIX, blocks, mixed, ragged, span_hashes, word_spans

Q = 8
WINDOW = 96
SHORTEST = 24
EDITS = 0.08
BLOCK_CHARS = 2 << 20
#: Bytes of documents looked at together; arrays over them take some eighty times as much.
TEXT_BYTES = 1 << 20
TABLE_BITS = 22
SPACE = 32
#: Second bytes of the letters and digits among U+0080 to U+00BF: feminine and masculine ordinal, micro, superscripts, fractions.
LATIN_WORD = np.array([0xAA, 0xBA, 0xB5, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE], np.uint8)


def symbols(data: np.ndarray, offsets: np.ndarray):
    """One byte per character of the normalised texts, their offsets, and each one's place in its text.

    Characters beyond ASCII are folded to 128 codes by their last bits; among them the
    punctuation of Latin-1, the general punctuation block and CJK punctuation count as such.
    """
    if not len(data):
        return data, np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(lead[1:], len(data)) - 1
    out = data[lead].copy()
    wide = np.flatnonzero(out >= 0xC0)
    head, second = out[wide], data[lead[wide] + 1]
    mark = (head == 0xC2) & ~np.isin(second, LATIN_WORD) | (head == 0xE2) & (second <= 0x81) | (head == 0xE3) & (second == 0x80)
    out[wide] = np.where(mark, SPACE, 128 | ((data[end[wide] - 1] & 1) << 6) | (data[end[wide]] & 0x3F))
    first = np.searchsorted(lead, offsets)
    place = np.arange(len(out)) - np.repeat(first[:-1], np.diff(first))
    word = (out >= 128) | ((out >= 97) & (out <= 122)) | ((out >= 48) & (out <= 57))
    before = np.empty(len(out), bool)
    before[0] = False
    before[1:] = word[:-1]
    keep = word | (before & (place > 0))
    out[~word] = SPACE
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[first], place[keep]


def q_grams(text: np.ndarray, q: int = Q) -> np.ndarray:
    """Every q-gram of a symbol array as one number, q at most 8."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - 8 * q))


def slot(grams, bits=TABLE_BITS):
    return ((grams * MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Index:
    """q-grams of some benchmark items by place, their windows, and short items by their words."""

    def __init__(self, items, q=Q, window=WINDOW, shortest=SHORTEST, edits=EDITS):
        self.q, self.window = q, window
        self.step = max(1, 2 * int(window * edits) or window // 2)
        self.item, self.text, self.begin, bodies, self.short, self.short_item = [], [], [], [], [], []
        first, regular = [], []
        for item, text in items:
            body, _, _ = symbols(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            body = body[:-1] if len(body) and body[-1] == SPACE else body
            if len(body) < shortest:
                if len(body):
                    self.short.append(body)
                    self.short_item.append(item)
                continue
            starts = [*range(0, max(1, len(body) - window), self.step)]
            first.append(len(self.item))
            regular.append(len(starts))
            if len(body) > window:
                starts.append(len(body) - window)
            bodies.append(body)
            for s in starts:
                self.item.append(item)
                self.text.append(body[s:s + window])
                self.begin.append(s)
        self.first, self.regular, self.begin = (np.array(x, np.int64) for x in (first, regular, self.begin))
        self.length = np.array([len(b) for b in bodies], np.int64)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = (self.size * edits).astype(np.int64)
        self.bound = np.maximum(1, self.size - q + 1 - self.edits * q)
        found = [q_grams(body, q) for body in bodies]
        many = np.array([len(f) for f in found], np.int64)
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        places = np.stack([np.repeat(np.arange(len(found)), many), ragged(np.zeros(len(found), np.int64), many)], 1)
        order = np.argsort(every, kind="stable")
        self.places = places[order].astype(np.int32)
        self.grams, self.starts = np.unique(every[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(every)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.grams)] = True

    @classmethod
    def of(cls, arrays):
        """The index that was sent as plain arrays."""
        out = cls.__new__(cls)
        vars(out).update(arrays)
        return out

    def windows_at(self, item, place):
        """All windows that hold the q-gram at a place of an item: (row, window)."""
        last_start = np.maximum(self.length[item] - self.window, 0)
        size = np.minimum(self.window, self.length[item])
        low = np.maximum(-((size - self.q - place) // self.step), 0)
        many = np.maximum(np.minimum(place // self.step, self.regular[item] - 1) - low + 1, 0)
        rows = np.repeat(np.arange(len(item)), many)
        end = np.flatnonzero((last_start > 0) & (place >= last_start))
        return np.concatenate([rows, end]), np.concatenate([ragged(self.first[item] + low, many), (self.first + self.regular)[item[end]]])

    def runs(self, text, offsets):
        """Short items as whole runs of words: (document, short item, first symbol)."""
        if not self.short or not len(text):
            return []
        starts, ends = word_spans(text != SPACE, offsets)
        words = span_hashes(text, starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        found = []
        by_words = {}
        for k, body in enumerate(self.short):
            a, b = word_spans(body != SPACE, np.array([0, len(body)]))
            by_words.setdefault(len(a), []).append((k, span_hashes(body, a, b)))
        for n, items in by_words.items():
            if len(words) < n:
                continue
            whole = owner[:len(words) - n + 1] == owner[n - 1:]
            run = lambda h, m, n=n: sum(mixed(h[j:j + m] + np.uint64(j)) for j in range(n))
            at = np.flatnonzero(whole & np.isin(run(words, len(whole)), np.concatenate([run(h, 1) for _, h in items])))
            for i in at:
                for k, _ in items:
                    body = self.short[k]
                    if np.array_equal(text[starts[i]:starts[i] + len(body)], body) and ends[i + n - 1] == starts[i] + len(body):
                        found.append((int(owner[i]), k, int(starts[i])))
        return found

    def matches(self, text, offsets):
        """Verified regions of a block: (document, window, first symbol, edits)."""
        if not len(self.grams) or len(text) < self.q:
            return []
        grams = q_grams(text, self.q)
        at = np.flatnonzero(self.table[slot(grams)])
        number = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[number] == grams[at]
        at, number = at[hit], number[hit]
        # Only hits that stand as densely as the least demanding window needs can add up to a match.
        least, span = int(self.bound.min()), int((self.size + self.edits).max())
        if len(at) < least:
            return []
        dense = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] < span)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, dense + least, -1)
        keep = np.cumsum(mark[:-1]) > 0
        at, number = at[keep], number[keep]
        if not len(at):
            return []
        many = self.counts[number]
        post = self.places[ragged(self.starts[number], many)]
        rows, window = self.windows_at(post[:, 0].astype(np.int64), post[:, 1].astype(np.int64))
        diagonal = (np.repeat(at, many) - post[:, 1])[rows] + self.begin[window]
        width = 2 * (self.edits[window] + 1)
        shift = 1 << 34
        bands = [(2 * ((diagonal + width * 4) // width), 0), (2 * ((diagonal + width * 4 - width // 2) // width) + 1, 1)]
        keys = np.concatenate([window * shift + b for b, _ in bands])
        keys, shared = np.unique(keys, return_counts=True)
        window, band = keys // shift, keys % shift
        enough = shared >= self.bound[window]
        return self.verify(text, offsets, window[enough], band[enough])

    def verify(self, text, offsets, window, band):
        """Align each window with the text along its band of diagonals."""
        found = []
        for k in np.unique(self.edits[window]) if len(window) else []:
            for m in np.unique(self.size[window[self.edits[window] == k]]):
                own = np.flatnonzero((self.edits[window] == k) & (self.size[window] == m))
                width = int(2 * (k + 1))
                low = (band[own] // 2) * width - 4 * width + (band[own] % 2) * (width // 2)
                middle = np.clip(low + (width + m) // 2, 0, len(text) - 1)
                doc = np.searchsorted(offsets, middle, "right") - 1
                begin, end = offsets[doc], offsets[doc + 1]
                pattern = np.stack([self.text[w] for w in window[own]])
                cost = np.zeros((len(own), width), np.int32)
                lane = np.arange(width)
                for i in range(int(m)):
                    place = low[:, None] + lane + i
                    inside = (place >= begin[:, None]) & (place < end[:, None])
                    same = inside & (text[np.clip(place, 0, len(text) - 1)] == pattern[:, i:i + 1])
                    step = cost + ~same
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(step - lane, axis=1) + lane
                best = cost.min(1)
                for j in np.flatnonzero(best <= k):
                    start = int(low[j] + cost[j].argmin())
                    found.append((int(doc[j]), int(window[own[j]]), min(max(start, int(begin[j])), int(end[j]) - 1), int(best[j])))
        return found


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options):
    """Broadcast indexes of blocks of the benchmark, each of about ``block_chars`` characters."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = benchmark.select("item_id", text.alias("text")).where("text <> ''")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        items = [(r["item_id"], r["text"]) for r in part.orderBy("item_id").collect()]
        # As plain arrays: executors need not have this module.
        yield benchmark.sparkSession.sparkContext.broadcast(vars(Index(items, **options)))


def regions(spans):
    """Overlapping ``(first, last, window, edits)`` as one region each: first, last, distinct windows, least edits."""
    out = []
    for first, last, window, edits in sorted(spans):
        if out and first <= out[-1][1]:
            was = out[-1]
            out[-1] = (was[0], max(was[1], last), was[2] | {window}, min(was[3], edits))
        else:
            out.append((first, last, {window}, edits))
    return [(first, last, len(windows), edits) for first, last, windows, edits in out]


def _with_folded(docs):
    return docs.select("*", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("__folded"))


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Benchmark passages found in ``docs`` (``doc_id``, ``text``).

    One row per row of ``docs``, benchmark item (``item_id``, ``text``) and region in which windows
    of it are found: ``doc_id``, ``item_id``, ``first`` and ``last`` (characters of the lower-cased
    text that overlapping windows span), ``windows`` (how many) and ``edits`` (the least of theirs).
    Null and empty texts contain nothing. Items with fewer than ``window`` normalised characters
    are looked for as a whole, those with fewer than ``shortest`` as exact runs of whole words;
    items without any letter or digit match nothing.
    Repeated rows and items are reported repeatedly. Other columns are ignored; an empty
    table on either side gives an empty result. ``options``: ``q``, ``window``,
    ``shortest``, ``edits`` (a share of the window), ``block_chars``.
    """
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    rows = _with_folded(docs.select("doc_id", "text")).select("doc_id", "__folded")
    out = None
    for index in indexes(benchmark, **options):
        def search(batches, index=index):
            known = Index.of(index.value)
            for part, data, offsets in blocks(batches, "__folded", TEXT_BYTES):
                text, at, place = symbols(data, offsets)
                spans = {}
                for doc, window, start, edits in known.matches(text, at):
                    stop = min(start + int(known.size[window]), int(at[doc + 1])) - 1
                    spans.setdefault((doc, known.item[window]), []).append((int(place[start]), int(place[stop]), window, edits))
                for doc, short, start in known.runs(text, at):
                    stop = start + len(known.short[short]) - 1
                    spans.setdefault((doc, known.short_item[short]), []).append((int(place[start]), int(place[stop]), -1, 0))
                best = [(doc, item, *region) for (doc, item), found in spans.items() for region in regions(found)]
                if best:
                    best.sort(key=lambda r: (r[0], str(r[1]), r[2]))
                    doc, item, *numbers = zip(*best)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(item), *[pa.array(v, pa.int64()) for v in numbers]],
                                                     ["doc_id", "item_id", "first", "last", "windows", "edits"])

        found = rows.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, first long, last long, windows long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``leaks`` finds no benchmark passage."""
    out = docs
    for index in indexes(benchmark, **options):
        def keep(batches, index=index):
            known = Index.of(index.value)
            for part, data, offsets in blocks(batches, "__folded", TEXT_BYTES):
                text, at, _ = symbols(data, offsets)
                bad = {doc for doc, *_ in [*known.matches(text, at), *known.runs(text, at)]}
                yield part.drop_columns(["__folded"]).filter(pa.array([i not in bad for i in range(part.num_rows)]))

        out = _with_folded(out).mapInArrow(keep, docs.schema)
    return out
