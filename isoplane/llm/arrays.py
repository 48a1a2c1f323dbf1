"""Vectorised access to the texts of Arrow batches: bytes, words and their hashes."""

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
BLOCK_BYTES = 4 << 20
LONG_WORD = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
PAD = np.zeros(8, np.uint8)


def mixed(h):
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX2
    h = (h ^ (h >> np.uint64(27))) * MIX
    return h ^ (h >> np.uint64(31))


def text_bytes(column):
    """Bytes of a string or binary array without nulls, with the offsets of its items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(batches, column, limit=BLOCK_BYTES):
    """Cut batches into runs of rows of about ``limit`` bytes of ``column``: (rows, bytes, offsets)."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        data, offsets = text_bytes(batch.column(i))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            at = offsets[first:last + 1]
            yield batch.slice(first, last - first), data[at[0]:at[-1]], at - at[0]
            first = last
    pa.default_memory_pool().release_unused()  # workers live on for other stages


def ascii_lower(data):
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(is_word, offsets):
    """Starts and ends of the runs of word bytes; runs end where their text ends."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (first[:-1] | ~before))
    ends = np.flatnonzero(is_word & (first[1:] | ~after)) + 1
    return starts, ends


def span_hashes(data, starts, ends):
    """64-bit hashes of byte spans, eight bytes at a time; long spans through a digest."""
    padded = np.concatenate([data, PAD])
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    length = ends - starts
    h = mixed(length.astype(np.uint64) + MIX)
    todo = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(todo):
        left = np.minimum(length[todo] - at, 8).astype(np.uint64)
        value = eight[starts[todo] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[todo] = mixed(h[todo] ^ (value * MIX))
        at += 8
        todo = todo[length[todo] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    return h


def ragged(starts, counts):
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` of all i in one array."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if total else np.zeros(0, np.int64)
    return np.arange(total) + shift


def lists(values, offsets):
    """An Arrow list array from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
