import base64

import numpy as np
import public_tokenizers
import tiktoken

from isoplane.llm import token_counts as op
from tests.llm.helpers import DOCS, documents, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def brute_force(text, spans):
    """Tokens per span by overlap, one token at a time."""
    e, at, out, across, none = encoding(), 0, [0] * len(spans), [0] * len(spans), 0
    data = text.encode()
    for token in e.encode_ordinary(text):
        size = len(e.decode_single_token_bytes(token))
        first = sum(b & 0xC0 != 0x80 for b in data[:at + 1]) - 1
        last = sum(b & 0xC0 != 0x80 for b in data[:at + size]) - 1
        held = [max(0, min(b, last + 1) - max(a, first)) for a, b in spans]
        at += size
        if not any(held):
            none += 1
            continue
        k = max(range(len(spans)), key=lambda i: (held[i], -i))
        out[k] += 1
        across[k] += sum(h > 0 for h in held) > 1
    return out, across, none


def test_lines(spark):
    rows = [(1, "first line\nsecond\n\n\nlast", "s"), (2, "", "s"), (3, None, "s"), (4, "ends\n", "s"), (5, "é中\n文 😀 x", "s"), (1, "first line\n", "s")]
    out = op.section_tokens(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    e = encoding()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: sum(len(e.encode_ordinary(t or "")) for j, t, _ in rows if j == i) for i in range(1, 6)}
    assert [(r.section, r["first"], r["last"]) for r in out if r.doc_id == 5] == [(0, 0, 3), (1, 3, 8)]
    assert [(r.section, r.n_tokens) for r in out if r.doc_id in (2, 3)] == [(0, 0), (0, 0)]


def test_given_sections_match_brute_force(spark):
    r = np.random.default_rng(5)
    rows, sections, want = [], [], {}
    for i in range(30):
        text = prose(i, 12) + " Ünïcödé 中文 😀!\n\n" + prose(i + 50, 5)
        cuts = sorted(set(r.integers(0, len(text) + 1, 8).tolist()))
        spans = [(a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k % 4 != 3]
        rows.append((i, text, "s"))
        sections += [(i, f"part{k:02d}", a, b, "x") for k, (a, b) in enumerate(spans)]
        want[i] = (spans, *brute_force(text, spans))
    rows.append((99, "no sections", "s"))
    sections += [(0, "null", None, 4, "x"), (98, "no document", 0, 4, "x")]
    table = spark.createDataFrame(sections, "doc_id long, section string, first long, last long, text string")
    out = op.section_tokens(documents(spark, rows), RANKS, public_tokenizers.PATTERN, table).collect()
    for i, (spans, tokens, across, none) in want.items():
        own = sorted((x for x in out if x.doc_id == i and x.section), key=lambda x: x.section)
        assert [(x["first"], x["last"], x.n_tokens, x.n_crossing) for x in own] == [(a, b, t, c) for (a, b), t, c in zip(spans, tokens, across)]
        assert sum(x.n_tokens for x in out if x.doc_id == i and x.section is None) == none
    assert sum(x.n_crossing for x in out) > 0
    assert [x.section for x in out if x.doc_id == 99] == [None]


def test_overlaps_are_cut():
    order, starts, ends = op.disjoint([(5, 9), (0, 6), (7, 8)])
    assert order == [1, 0, 2] and starts.tolist() == [0, 6, 9] and ends.tolist() == [6, 9, 9]


def test_long_text_and_empty_table(spark):
    text = "a" * 200_000 + "\n" + prose(1, 20_000)
    out = op.section_tokens(documents(spark, [(1, text, "s")]), RANKS, public_tokenizers.PATTERN).collect()
    assert [r["last"] for r in out] == [200_001, len(text)]
    assert op.section_tokens(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0
