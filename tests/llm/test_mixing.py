import pytest

from isoplane.llm import mixing as op
from tests.llm.helpers import DOCS, documents


def mixed_rows(df):
    rows = sorted(df.collect(), key=lambda r: r.place)
    assert len({r.place for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values())
    assert sorted(by_slot) == list(range(len(by_slot)))
    return rows, [next(iter(by_slot[s]))[0] for s in sorted(by_slot)]


def test_less_than_one_block_from_every_share(spark):
    counts = {"a": 400, "b": 90, "c": 35, None: 12}
    rows = [(k * 1000 + i, "t", s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    out, order = mixed_rows(op.mixed(documents(spark, rows), parts=40, block_rows=3))
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    weight = {r.source: r.weight for r in out}
    blocks = {s: -(-n // 3) for s, n in counts.items()}
    share = {s: round(w * sum(round(x * 40) for x in weight.values())) for s, w in weight.items()}
    full = min(blocks[s] // share[s] for s in blocks) * sum(share.values())  # slots before any source runs out
    assert full > 0
    done = dict.fromkeys(counts, 0)
    for t, s in enumerate(order[:full], 1):
        done[s] += 1
        assert all(abs(done[x] - weight[x] * t) < 1 for x in counts)


def test_target_table_and_clashing_columns(spark):
    rows = [(i, "t", "ab"[i % 2]) for i in range(200)]
    target = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, target double")
    out, order = mixed_rows(op.mixed(documents(spark, rows), target, parts=4, block_rows=1))
    assert order[:8].count("a") == 6
    assert isinstance(out[0].slot, int)  # the caller's column of that name is replaced


def test_empty_repeated_and_null(spark):
    assert op.mixed(spark.createDataFrame([], DOCS)).count() == 0
    out, _ = mixed_rows(op.mixed(documents(spark, [(1, "t", "a")] * 7 + [(None, None, None)] * 3), block_rows=2))
    assert len(out) == 10


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="3 sources"):
        op.mixed(documents(spark, [(i, "t", str(i)) for i in range(3)]))


def test_hot_source_among_a_thousand_keeps_its_target(spark):
    counts = {f"s{i:04}": 1 + i % 4 for i in range(999)} | {"hot": 2000}
    rows = [(k * 10_000 + i, "t", s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    out, order = mixed_rows(op.mixed(documents(spark, rows), block_rows=1))
    assert len(out) == len(rows)
    target = {s: n ** 0.5 for s, n in counts.items()}
    weight = {r.source: r.weight for r in out}
    assert all(abs(weight[s] - target[s] / sum(target.values())) < 1e-9 for s in counts)
    # The mix that gives all sources that are left slots in proportion to their targets.
    by_end = sorted(counts, key=lambda s: counts[s] / target[s])
    gone, live, phases = 0, sum(target.values()), []
    for s in by_end:
        phases.append((gone + live * counts[s] / target[s], gone, live))
        gone, live = gone + counts[s], live - target[s]
    done, k = dict.fromkeys(counts, 0), 0
    for t, s in enumerate(order, 1):
        done[s] += 1
        while k < len(phases) - 1 and phases[k][0] <= t:
            k += 1
        for x in counts if t % 50 == 0 else ("hot", s):
            share = min(counts[x], target[x] * (t - phases[k][1]) / phases[k][2])
            assert abs(done[x] - share) < 1 + 1e-6, (t, x, done[x], share)


def test_skewed_sources_match_sql(spark):
    """Sources of very different sizes, repeated rows and rows without a source, place by place."""
    import duckdb
    import pandas as pd

    from isoplane.llm.queries import MIX_SQL

    sizes = {"hot": 1500, "b": 700, "c": 251, "d": 50, "e": 1, None: 33}
    frame = pd.DataFrame([(len(s or "") * 10_000 + i + ord((s or "n")[0]) * 10**6, s) for s, n in sizes.items() for i in range(n)], columns=["doc_id", "source"])
    con = duckdb.connect()
    con.register("frame", frame)
    con.execute("create table documents as select * from frame")
    want = con.execute(f"select doc_id, source, block, release, deadline, slot, place, weight from ({MIX_SQL}) order by place").fetchall()
    out = op.mixed(spark.createDataFrame(frame, "doc_id long, source string")).orderBy("place").collect()
    assert [(r.doc_id, r.source, r.block, r.release, r.deadline, r.slot, r.place) for r in out] == [w[:7] for w in want]
    assert [r.weight for r in out] == pytest.approx([w[7] for w in want], rel=1e-12) and len({w[7] for w in want}) == 6
