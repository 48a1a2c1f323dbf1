"""Tokens of documents attributed to their sections.

Every whole document is encoded once. Byte lengths of its tokens give their character
spans, which are joined with the spans of its sections. A token that crosses a
boundary goes whole to the section that holds most of its characters, to the earlier
one on a tie; tokens outside every section are counted apart.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def line_starts(text: str) -> np.ndarray:
    """First characters of the lines; a line break belongs to the line it ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(codes == 10) + 1])
    return starts if len(starts) == 1 or starts[-1] < len(codes) else starts[:-1]


def token_spans(data: bytes, lengths: np.ndarray):
    """First and last character of each token, from the byte lengths of all."""
    raw = np.frombuffer(data, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1]


def allot(first, last, starts, ends):
    """Section of every token (-1: none) and whether it touches another section.

    Sections are disjoint and sorted; ``ends`` are exclusive.
    """
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, last, "right") - 1
    section = np.where(low > high, -1, low)
    crossing = low < high
    for i in np.flatnonzero(crossing):
        among = np.arange(low[i], high[i] + 1)
        held = np.minimum(ends[among], last[i] + 1) - np.maximum(starts[among], first[i])
        section[i] = among[held.argmax()]
    return section, crossing


def disjoint(spans):
    """Sections as sorted arrays; one that begins inside an earlier one is cut to begin at its end."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1], i))
    starts, ends, at = [], [], 0
    for i in order:
        s, e = max(spans[i][0], at), max(spans[i][1], at, spans[i][0])
        starts.append(s)
        ends.append(e)
        at = max(at, e)
    return order, np.array(starts, np.int64), np.array(ends, np.int64)


def section_tokens(docs: DataFrame, ranks: str, pattern: str, sections: DataFrame | None = None) -> DataFrame:
    """Token counts of every section of every row of ``docs`` (``doc_id``, ``text``).

    ``ranks`` is the path of a byte-level rank file on the driver, ``pattern`` its splitting
    pattern. ``sections`` has ``doc_id``, ``section``, ``first`` and ``last`` (characters, the
    latter exclusive); without it a document's lines are its sections, numbered from 0.

    Returns ``doc_id``, ``section``, ``first``, ``last``, ``n_tokens`` and ``n_crossing`` (of these
    tokens, those that touch another section). Tokens outside every section are a row
    without a section. Counts of a document add up to its tokens. Null and empty texts are
    one empty line. Overlapping sections are cut (see ``disjoint``); null bounds and
    documents without sections leave their tokens outside. Repeated rows are counted
    repeatedly; other columns are ignored; an empty table gives an empty one.
    """
    with open(ranks, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    if sections is None:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<first: long, last: long, section: long>>"))
        kind = "bigint"
    else:
        kind = sections.schema["section"].dataType.simpleString()
        spans = sections.where("first is not null and last is not null").groupBy(F.col("doc_id").alias("of")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"),
                                                 "section"))).alias("spans"))  # the sections of one document
        rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
            "doc_id", "text", F.coalesce("spans", F.array().cast(f"array<struct<first: long, last: long, section: {kind}>>")).alias("spans"))

    def count(batches):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        size = np.zeros(max(known.values()) + 1, np.int64)
        size[list(known.values())] = [len(k) for k in known]
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                body, given = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                data = body.encode()
                lengths = size[np.array(encoding.encode_ordinary(body), np.int64)]
                if given is None:
                    starts = line_starts(body)
                    ends = np.append(starts[1:], len(body))
                    names = range(len(starts))
                else:
                    order, starts, ends = disjoint([(s["first"], s["last"]) for s in given])
                    names = [given[k]["section"] for k in order]
                if len(lengths):
                    section, crossing = allot(*token_spans(data, lengths), starts, ends)
                else:
                    section, crossing = np.zeros(0, np.int64), np.zeros(0, bool)
                tokens = np.bincount(section + 1, minlength=len(starts) + 1)
                across = np.bincount(section[crossing] + 1, minlength=len(starts) + 1)
                doc = batch.column(0)[i].as_py()
                found += [(doc, name, int(s), int(e), int(n), int(x)) for name, s, e, n, x in zip(names, starts, ends, tokens[1:], across[1:])]
                if tokens[0]:
                    found.append((doc, None, None, None, int(tokens[0]), 0))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), out_types)], out_names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, section {kind}, first long, last long, n_tokens long, n_crossing long"
    out_names = ["doc_id", "section", "first", "last", "n_tokens", "n_crossing"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out_types = [arrow.get(docs.schema["doc_id"].dataType.simpleString()), arrow.get(kind), *[pa.int64()] * 4]
    return rows.mapInArrow(count, schema)
