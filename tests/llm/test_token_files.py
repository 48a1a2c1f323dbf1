import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from isoplane.llm import token_files as op
from isoplane.llm.storage import new_folder
from tests.llm.helpers import DOCS, documents, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([32, 256]),
       st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, block, percentile):
    packed = op.pack_blocks(np.array(ids, np.uint32), block, percentile)
    assert op.unpack_blocks(len(ids), block, *packed).tolist() == ids


def test_outliers_are_exceptions():
    ids = np.arange(256, dtype=np.uint32) % 16 + 1000
    ids[[3, 200]] = 60_000
    least, widths, exceptions, _, data = op.pack_blocks(ids)
    assert (least[0], widths[0], exceptions[0], len(data)) == (1000, 4, 2, 128 + 12)


def test_pages_round_trip():
    ids = np.random.default_rng(0).integers(0, 49408, 5000).astype(np.uint16)
    one = op.write_page([3, None, 9], [4000, 0, 1000], ids, 256, 0.9)
    pages = list(op.read_pages(one + b"\n" + one + b"\n"))
    assert [p[0] for p in pages] == [0, len(one) + 1]
    assert pages[1][1] == [3, None, 9] and pages[1][2].tolist() == [4000, 0, 1000] and (pages[1][3] == ids).all()
    with pytest.raises(ValueError, match="no page"):
        list(op.read_pages(b"x" * 64))


def test_pieces_equal_the_library():
    encode = op.Encoder(open(WORDS).read())
    r = random.Random(3)
    alphabet = [chr(i) for i in range(1, 256)] + list("ab ST'.,1 ") * 20 + ["́", "中", "İ", "<|endoftext|>", " "]
    for _ in range(800):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_texts_at_once_equal_the_library():
    encode = op.Encoder(open(WORDS).read())
    r = random.Random(4)
    parts = ["can't", "'S", "'re", "'ve ", "''s", "it'll", "!'d", "'", "x'y", "1²3", "Étonètre", "ß", "\n", "  ", "中", "<|endoftext|>", "word"]
    texts = ["", " ", *("".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(500)), "long" * 50, "long" * 50 + "er", ""]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode.encoded(texts)] == want
    assert encode.encoded([]) == [] and [len(x) for x in encode.encoded(["", ""])] == [0, 0]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    encode = op.Encoder(open(WORDS).read())
    texts = ["one two one, three twelveletters twelvelettres", "two"]
    assert [x.tolist() for x in encode.encoded(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tasks_share_the_encoder():
    definition = open(WORDS).read()
    assert op.encoder_of(definition) is op.encoder_of(definition)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_written_and_read_back(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, prose(i, i % 40), "s") for i in range(60)] + [(60, None, "s"), (61, "", "s"), (62, "long " * 30_000, "s"),
                                                             (-5, "Ünï 中文 I'm", "s"), (7, prose(7, 7), "s"), (None, "no id", "s")]
    folder = new_folder(spark, "test")
    op.write_tokens(documents(spark, rows), path, folder, page_ids=500)
    out = sorted(op.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(path)
    at = 0
    known = {}
    for i, t, _ in rows:
        known.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert [r.doc_id for r in out] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in out:
        assert r.ids in known[r.doc_id] and r.n_tokens == len(r.ids) and r.start == at
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    index = op.page_index(op.read_tokens(spark, folder)).collect()
    assert len(index) > 3 and sum(p.n_tokens for p in index) == at


def test_order_of_files(spark):
    docs = documents(spark, [(i, f"t{i}", "s") for i in range(50)])
    folder = new_folder(spark, "rows")
    docs.repartitionByRange(5, -docs.doc_id).sortWithinPartitions(-docs.doc_id).write.parquet(folder)
    ordered, order = op.read_order(spark.read.parquet(folder))
    out = new_folder(spark, "tokens")
    op.write_tokens(ordered, WORDS, out, order=order)
    rows = sorted(op.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(49, -1, -1))
    assert op.read_order(docs)[1] is None


def test_empty_table(spark):
    folder = new_folder(spark, "test")
    op.write_tokens(spark.createDataFrame([], DOCS), WORDS, folder)
    assert op.read_tokens(spark, folder).count() == 0


def test_files_are_read_one_at_a_time(spark, monkeypatch):
    folder = new_folder(spark, "test")
    op.write_tokens(documents(spark, [(i, prose(i, 9), "s") for i in range(40)]), WORDS, folder)
    seen, materialize, before = [], op.materialize, spark.conf.get(op.ARROW_ROWS)
    monkeypatch.setattr(op, "materialize", lambda df: seen.append(spark.conf.get(op.ARROW_ROWS)) or materialize(df))
    assert op.read_tokens(spark, folder).count() == 40
    assert seen == ["1"] and spark.conf.get(op.ARROW_ROWS) == before
