"""Token ids in binary files of patched frame-of-reference blocks.

Texts are dealt out by range of their order, encoded in order and written as pages
of whole documents. A page packs its ids in blocks: the block's least id is
subtracted, the rest is packed at the width that a percentile of it needs, and wider
values keep their low bits in place and their high bits in an exception list. The
starts of all blocks are in the page's header, those of all pages in an index table.
Spark's own writer commits the files, so lost tasks leave nothing behind.

Page, little-endian: magic ``PFR1``, bytes of the page u64, documents, ids, ids per
block, bytes of block data (u32 each); per document a flag (1: it has a doc_id), doc_id
i64 and number of ids u64; per block least id u32, width u8, exceptions u16, start u32;
then the blocks, each packed bits, positions u16 and high bits u32 of its exceptions.
A newline follows every page.
"""

import json
import struct
import zlib
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from isoplane.cluster import materialize
from isoplane.llm.arrays import PAD, ragged, span_hashes

MAGIC = b"PFR1"
HEAD = "<4sQIIII"
HEAD_BYTES = struct.calcsize(HEAD)
BLOCK = 256
PERCENTILE = 0.9
PAGE_IDS = 1 << 16
PAGES_PER_FILE = 64
CACHE = 300_000
RUN_CHARS = 1 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# The word vocabulary's own pattern, and what it makes of the characters of
# Latin-1 text; all other texts, and other vocabularies, go to the library whole.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BLANK, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b"\t\n\r\x0c ")] = BLANK
KINDS[list(range(97, 123)) + [0xB5, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
KINDS[list(range(48, 58)) + [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
UNUSUAL = bytes([0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0xAA, 0xBA])


def usual(text: str) -> bool:
    """Latin-1 throughout, without the few characters that libraries class differently."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, UNUSUAL)) == len(raw) and b"<|" not in raw


def piece_spans(data: np.ndarray):
    """Starts and ends of the vocabulary's pieces in lower-case Latin-1 bytes."""
    kind = KINDS[np.concatenate([data, PAD[:3]])]  # a little beyond the end, which is no letter
    n = len(data)
    begins = np.ones(n + 1, bool)
    begins[1:n] = (kind[1:n] != kind[:n - 1]) | (kind[1:n] == DIGIT)
    # An apostrophe of its own takes the letters of an English ending from the word behind it.
    mark = np.flatnonzero((data == 39) & begins[:n] & (kind[1:n + 1] == LETTER))
    one, two = np.concatenate([data, PAD])[mark + 1], np.concatenate([data, PAD])[mark + 2]
    single = np.isin(one, list(b"stmd"))
    double = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    taken = single + 2 * double
    mark, taken = mark[taken > 0], taken[taken > 0]
    begins[mark + 1] = False
    behind = mark + 1 + taken
    begins[behind[kind[behind] == LETTER]] = True
    at = np.flatnonzero(begins)
    own = kind[at[:-1]] != BLANK
    return at[:-1][own], at[1:][own]


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Starts and ends of the different spans, and which of them every span equals: by hash, then byte by byte."""
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, PAD]), strides=(1,))
    length, model = ends - starts, starts[first][which]
    same = length == (ends - starts)[first][which]
    todo, at = np.flatnonzero(same), 0
    while len(todo):
        beyond = np.uint64(64) - np.minimum(length[todo] - at, 8).astype(np.uint64) * np.uint64(8)
        same[todo] = (eight[starts[todo] + at] ^ eight[model[todo] + at]) << beyond == 0
        at += 8
        todo = todo[same[todo] & (length[todo] > at)]
    apart = np.flatnonzero(~same)  # of different spans with one hash, all but the first stand alone
    which[apart] = len(first) + np.arange(len(apart))
    first = np.concatenate([first, apart])
    return starts[first], ends[first], which


class Pieces(dict):
    """Ids of the pieces met so far, as bytes; forgotten when there are too many.

    A piece needs no normalising or splitting any more, so it goes straight to the merges.
    """

    def __init__(self, tokenizer, kind):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.code = tokenizer.model, np.dtype(kind).char
        self.spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, raw):
        if len(self) >= CACHE:
            self.clear()
        piece = raw.decode("latin-1")
        spelled = piece if piece.isascii() and piece.isprintable() else self.spell(piece)[0][0]
        ids = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self[raw] = ids
        return ids


class Encoder:
    """Ids of whole texts. Equal pieces of texts, which the vocabulary encodes on their own, are looked up once."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pieces = Pieces(self.tokenizer, self.kind)
        steps = (parts.get("normalizer") or {}).get("normalizers", [])
        splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_piece = ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
                         and splits[0].get("pattern") == {"Regex": PATTERN} and splits[0].get("invert") is True
                         and parts.get("post_processor") is None)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoded([text])[0]

    def encoded(self, texts: list) -> list:
        """Ids of every text."""
        out = [None if self.by_piece and usual(t) else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind)
               for t in texts]
        some = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(some, self.by_pieces([texts[i].lower().encode("latin-1") for i in some])):
            out[i] = ids
        return out

    def by_pieces(self, texts: list) -> list:
        """Ids of lower-case Latin-1 texts."""
        raw = b"\n".join(texts)
        if not raw:
            return [np.zeros(0, self.kind)] * len(texts)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = piece_spans(data)
        low, high, which = equal_spans(data, starts, ends)
        each = [self.pieces[raw[a:b]] for a, b in zip(low.tolist(), high.tolist())]
        flat = np.frombuffer(b"".join(each), self.kind)
        count = np.fromiter(map(len, each), np.int64, len(each)) // flat.itemsize
        many = count[which]
        ids = flat[ragged((np.cumsum(count) - count)[which], many)]
        total = np.concatenate([[0], np.cumsum(many)])
        after = np.cumsum([len(t) + 1 for t in texts])  # where the next text begins
        return np.split(ids, total[np.searchsorted(starts, after[:-1])])


@lru_cache(maxsize=1)
def encoder_of(definition: str) -> Encoder:
    """The encoder that all tasks of a worker share; frequent pieces and the vocabulary are read once."""
    return Encoder(definition)


def runs(batch, chars: int = RUN_CHARS):
    """Names and texts of a batch's rows, as many at a time as ``chars`` characters take."""
    names, texts, total = [], [], 0
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        names.append(name)
        texts.append(text.as_py())
        total += len(texts[-1])
        if total >= chars:
            yield names, texts
            names, texts, total = [], [], 0
    if names:
        yield names, texts


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE):
    """Least ids, widths, numbers of exceptions, starts and the bytes of all blocks."""
    n = -(-len(ids) // block)
    rows = np.empty((n, block), np.uint32)
    flat = rows.reshape(-1)
    flat[:len(ids)] = ids
    flat[len(ids):] = ids[-1] if len(ids) else 0
    least = rows.min(1)
    rows -= least[:, None]
    rank = max(0, int(np.ceil(percentile * block)) - 1)
    usual = np.partition(rows, rank, axis=1)[:, rank]
    widths = np.zeros(n, np.int64)
    for bit in range(32):
        widths += usual >= np.uint64(1) << np.uint64(bit)
    high = (rows.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    at_row, at_place = np.nonzero(high)
    exceptions = np.bincount(at_row, minlength=n)
    packed = -(-block * widths // 8)
    size = packed + 6 * exceptions
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]) if n else np.zeros(0, np.int64)
    out = np.zeros(int(size.sum()), np.uint8)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            bits = (rows[own][:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
            data = np.packbits(bits.astype(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
            out[starts[own][:, None] + np.arange(data.shape[1])] = data
    if len(at_row):
        nth = np.arange(len(at_row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        place = starts[at_row] + packed[at_row]
        out[(place + 2 * nth)[:, None] + np.arange(2)] = at_place.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(place + 2 * exceptions[at_row] + 4 * nth)[:, None] + np.arange(4)] = (
            high[at_row, at_place].astype("<u4").view(np.uint8).reshape(-1, 4))
    return least, widths.astype(np.uint8), exceptions.astype(np.uint16), starts.astype(np.uint32), out


def unpack_blocks(n_ids: int, block: int, least, widths, exceptions, starts, data) -> np.ndarray:
    """The ids that ``pack_blocks`` packed."""
    n = len(least)
    rows = np.zeros((n, block), np.uint32)
    widths, exceptions, starts = widths.astype(np.int64), exceptions.astype(np.int64), starts.astype(np.int64)
    packed = -(-block * widths // 8)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            raw = data[starts[own][:, None] + np.arange(-(-block * width // 8))]
            bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :block * width].reshape(len(own), block, width)
            rows[own] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    if exceptions.sum():
        row = np.repeat(np.arange(n), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        place = starts[row] + packed[row]
        at = np.ascontiguousarray(data[(place + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        high = np.ascontiguousarray(data[(place + 2 * exceptions[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        rows[row, at] |= (high.astype(np.uint64) << widths[row].astype(np.uint64)).astype(np.uint32)
    return (rows + np.asarray(least, np.uint32)[:, None]).reshape(-1)[:n_ids]


def write_page(doc_ids: list, counts: list, ids: np.ndarray, block: int, percentile: float) -> bytes:
    """Bytes of one page."""
    least, widths, exceptions, starts, data = pack_blocks(ids, block, percentile)
    body = b"".join([
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(counts, "<u8").tobytes(),
        least.astype("<u4").tobytes(), widths.tobytes(), exceptions.astype("<u2").tobytes(), starts.astype("<u4").tobytes(),
        data.tobytes()])
    return struct.pack(HEAD, MAGIC, HEAD_BYTES + len(body), len(doc_ids), len(ids), block, len(data)) + body


def read_pages(content: bytes):
    """Every page of a file: its offset, doc_ids, numbers of ids, ids."""
    at = 0
    while at < len(content):
        magic, size, docs, n, block, n_data = struct.unpack_from(HEAD, content, at)
        if magic != MAGIC:
            raise ValueError(f"no page at byte {at}")
        blocks, place = -(-n // block), at + HEAD_BYTES
        parts = []
        for kind, count in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u4", blocks), ("u1", blocks),
                            ("<u2", blocks), ("<u4", blocks), ("u1", n_data)):
            parts.append(np.frombuffer(content, kind, count, place))
            place += parts[-1].nbytes
        known, names, counts, *packed = parts
        names = [int(d) if k else None for k, d in zip(known, names)]
        yield at, names, counts.astype(np.int64), unpack_blocks(n, block, *packed)
        at += size + 1


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, order=None,
                 block: int = BLOCK, percentile: float = PERCENTILE, page_ids: int = PAGE_IDS) -> None:
    """Encode the texts of ``docs`` (``doc_id``, ``text``) and write them to ``folder``.

    ``tokenizer`` is the path of a vocabulary file on the driver. ``order`` names the columns
    that order the documents, ``doc_id`` by default (nulls first); equal ones follow a hash
    of their text. Null and empty texts hold only ``end_id``. Repeated rows are written
    repeatedly. Other columns are ignored. Empty tables give files without pages.
    """
    with open(tokenizer) as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    keys = [f"order{i}" for i in range(len(order or ["doc_id"]))]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       *[F.col(c).alias(k) for c, k in zip(order or ["doc_id"], keys)])
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("text")).select("doc_id", "text")
    end = [] if end_id is None else [end_id]

    def encode(batches):
        encoder = encoder_of(definition.value)
        last = np.array(end, encoder.kind)
        names, counts, parts, total = [], [], [], 0
        page = lambda: pa.RecordBatch.from_arrays(
            [pa.array([write_page(names, counts, np.concatenate(parts), block, percentile)], pa.binary())], ["value"])
        for batch in batches:
            for some, texts in runs(batch):
                for name, ids in zip(some, encoder.encoded(texts)):
                    names.append(name)
                    counts.append(len(ids) + len(last))
                    parts += [ids, last]
                    total += counts[-1]
                    if total >= page_ids:
                        yield page()
                        names, counts, parts, total = [], [], [], 0
        if names:
            yield page()

    pages = ranged.mapInArrow(encode, "value binary")
    pages.select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", PAGES_PER_FILE).text(folder)


@contextmanager
def one_row_batches(spark: SparkSession):
    """Rows of whole files reach Python one at a time; what runs in between takes the setting, which is then put back."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, 1)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of written files in their order, one row each.

    ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` of the ids as unsigned
    32-bit integers, ``file`` and ``page_start`` (the page's byte in it), and ``ids`` on request.
    """
    files = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = 0
                for at, names, counts, ids in read_pages(memoryview(content.as_buffer())):
                    ends = np.cumsum(counts)
                    each = [ids[e - c:e] for e, c in zip(ends, counts)]
                    columns = [pa.array([name] * len(names)), pa.array([at] * len(names), pa.int64()), pa.array(names, pa.int64()),
                               pa.array(before + ends - counts), pa.array(counts),
                               pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                    fields = ["file", "page_start", "doc_id", "local", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        fields.append("ids")
                    before += int(ends[-1]) if len(ends) else 0
                    yield pa.RecordBatch.from_arrays(columns, fields)

    rows = files.mapInArrow(decode, "file string, page_start long, doc_id long, local long, n_tokens long, ids_crc32 long"
                            + (", ids array<long>" if with_ids else ""))
    if not with_ids:
        with one_row_batches(spark):
            rows = materialize(rows)
    # Files are numbered in the order of their names, which Spark gives by partition.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", number)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(bases), "file")
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "page_start",
                      *(["ids"] if with_ids else []))


def page_index(tokens: DataFrame) -> DataFrame:
    """Where every page begins: ``file``, ``page_start`` (byte), ``start`` (ids before it), ``docs``, ``n_tokens``."""
    return tokens.groupBy("file", "page_start").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("n_tokens"))


def read_order(docs: DataFrame) -> tuple[DataFrame, list | None]:
    """``doc_id`` and ``text`` of ``docs`` with columns for its rows' order in Parquet files, if it was read from some."""
    try:
        out = docs.select("doc_id", "text", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("__part"),
                          F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        return docs, None
    return out, ["__part", "__file", "__row"]
