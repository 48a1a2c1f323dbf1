"""Every registered query of this folder against its SQL, and the pipeline against its parts."""

import glob
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from isoplane.llm import queries
from isoplane.llm.mixing import mixed
from tests.llm.helpers import documents
from tests.llm.test_near_duplicates import brute_force

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "none"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    out = queries.QUERIES[name](spark, SF_DIR)
    expected = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(out.columns) == sorted(names)
    assert cells(out.columns, [tuple(r) for r in out.collect()]) == cells(names, expected.fetchall())


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES) == list(range(1, 14))


def test_token_query_matches_the_library(spark, duck):
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in duck.execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = queries.QUERIES["op2_token_files"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == want


def test_leak_query_matches_plain_search(spark, duck):
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [(i, fold(t)) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    want = {(d, i) for d, t in duck.execute("select doc_id, text from documents").fetchall() for i, x in items if x in fold(t or "")}
    out = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_qgram_leaks"](spark, SF_DIR).collect()}
    assert want and want <= out and len(out - want) <= 1


def test_quality_query_on_held_out_rows(spark, duck):
    truth = dict(duck.execute("select doc_id, quality from labels").fetchall())
    out = queries.QUERIES["op7_quality_network"](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.85


def test_pipeline_stages(spark, duck):
    docs = queries.table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_folder(spark, f"test-{name}")
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before_ids
        if name == "quality":
            bad = {d for d, q in duck.execute("select doc_id, quality from labels").fetchall() if q == 0}
            assert len(bad & set(ids)) <= 0.4 * len(bad) and len(before_ids - set(ids) - bad) < 0.2 * len(before_ids)
        if name in ("mixing", "tokens"):
            assert set(ids) == before_ids
        if name != "tokens":
            assert after.columns == columns
        if name == "mixing":
            order = [r.doc_id for r in after.collect()]
        docs = after
    assert [r.doc_id for r in sorted(docs.collect(), key=lambda r: r.start)] == order
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(order)


def test_pipeline_stages_match_plain_versions(spark, duck):
    """Every stage on what the stage before it kept."""
    def staged(stage, docs):
        path = corpus_pipeline.new_folder(spark, "test-plain")
        stage(spark, docs, SF_DIR).write.parquet(path)
        return spark.read.parquet(path)

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    docs = staged(corpus_pipeline.quality, queries.table(spark, SF_DIR, "documents"))
    before, docs = texts(docs), staged(corpus_pipeline.near_duplicate, docs)
    kept = {i for i, _, _, first in brute_force([(i, t, None) for i, t in before.items()], 5) if first}
    assert len(kept) < len(before) and docs.count() == len(kept)
    assert texts(docs) == {i: before[i] for i in kept}

    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [fold(t) for t, in duck.execute("select text from benchmark").fetchall()]
    before, docs = texts(docs), staged(corpus_pipeline.decontamination, docs)
    after, leaking = texts(docs), {i for i, t in before.items() if any(x in fold(t or "") for x in items)}
    dropped = before.keys() - after.keys()
    assert leaking and leaking <= dropped and len(dropped - leaking) <= 1
    assert after == {i: t for i, t in before.items() if i not in dropped} and docs.count() == len(after)

    order = [r.doc_id for r in sorted(mixed(docs).select("doc_id", "place").collect(), key=lambda r: r.place)]
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc in order:
        ids = tokenizer.encode(after[doc] or "", add_special_tokens=False).ids + [1]
        want.append((at, doc, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = staged(corpus_pipeline.tokens, staged(corpus_pipeline.mixing, docs)).collect()
    assert sorted((r.start, r.doc_id, r.ids_crc32) for r in out) == want


def test_line_token_query_matches_one_token_at_a_time(spark, duck):
    """All lines of all documents, each token given to the line that holds most of its characters."""
    from tests.llm.test_token_counts import encoding

    e, want = encoding(), {}
    sizes = {}
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        text = text or ""
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        ends = starts[1:] + [len(text)]
        counts, across = [0] * len(starts), [0] * len(starts)
        char, at, line = [k for k, c in enumerate(text) for _ in c.encode()], 0, 0
        for token in e.encode_ordinary(text):
            size = sizes.setdefault(token, len(e.decode_single_token_bytes(token)))
            first, last = char[at], char[at + size - 1]
            at += size
            while ends[line] <= first:
                line += 1
            touched = [k for k in range(line, len(starts)) if starts[k] <= last]
            best = max(touched, key=lambda k: (min(ends[k], last + 1) - max(starts[k], first), -k))
            counts[best] += 1
            across[best] += len(touched) > 1
        want[doc] = list(zip(starts, ends, counts, across))
    got = {}
    for r in sorted(queries.QUERIES["op8_section_tokens"](spark, SF_DIR).collect(), key=lambda r: (r.doc_id, r.section)):
        got.setdefault(r.doc_id, []).append((r["first"], r["last"], r.n_tokens, r.n_crossing))
    assert got == want


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows and columns named like the operators' own pass every stage; empty tables stay empty."""
    from pyspark.sql import functions as F

    plain = queries.table(spark, SF_DIR, "documents").limit(30)
    odd = spark.createDataFrame([(900_001, None, None, None, 0), (None, "a row without a name", "en", "s", 20), (900_002, "", "en", "s", 0)], plain.schema)
    docs = plain.unionByName(odd).unionByName(odd)
    extra = {"slot": F.lit("mine"), "part": F.lit(77), "weight": F.lit(0.5), "u1": F.lit("u"), "__part": F.lit(1), "t": F.lit("x"), "lang 2": F.col("lang")}
    docs = docs.withColumns(extra)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.new_folder(spark, f"test-odd-{name}")
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == names and after.dtypes == docs.dtypes
        bad = after.where("slot <> 'mine' or part <> 77 or weight <> 0.5 or u1 <> 'u' or __part <> 1 or t <> 'x' or not lang <=> `lang 2`")
        assert bad.count() == 0
        if name == "mixing":
            assert after.count() == docs.count()
        if name == "near_duplicates":
            assert after.where("doc_id is null").count() == docs.where("doc_id is null").count()
        docs = after
    out = corpus_pipeline.tokens(spark, docs, SF_DIR)
    assert out.count() == docs.count() > 0
    empty = plain.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name


def test_pipeline_stages_send_small_batches(spark):
    """A stage bounds the rows of an Arrow batch, which an executor's memory grows with; a smaller number stays."""
    docs = documents(spark, [(1, "a b c", "s")])
    for before, after in (("10000", "500"), ("0", "500"), ("64", "64")):
        spark.conf.set(corpus_pipeline.ARROW_ROWS, before)
        try:
            corpus_pipeline.tokens(spark, docs, SF_DIR)
            assert spark.conf.get(corpus_pipeline.ARROW_ROWS) == after
        finally:
            spark.conf.unset(corpus_pipeline.ARROW_ROWS)
