"""Interleaving sources at target weights by Pfair scheduling.

A source's documents form blocks. In a fluid mix every source that still has blocks gets
slots at a rate proportional to its target. A block may run from the slot in which the
fluid mix begins it on and has to by the slot in which the fluid mix ends it; the ready
block that ends earliest runs. At any slot every source is less than one block away from its target
share, however long the mix and however small the share. One task walks over all slots
and keeps each round's first state, a number per source; rounds, whose length grows with
the square root of the mix, are then scheduled from their first state, each on its own.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from isoplane.cluster import materialize
from isoplane.llm.sharding import BITS, uniform_key

PARTS = 200
BLOCK_ROWS = 16
MAX_SOURCES = 2_000
BROADCAST_ROWS = 200_000
RANK_ROWS = 20_000
SCALE = 1 << 50
OWN = ("weight", "block", "release", "deadline", "slot", "place")


def tempered(rows: Column) -> Column:
    """Default target: the square root of a source's documents."""
    return F.sqrt(rows.cast("double"))


def source_table(keys: DataFrame, target, block_rows: int) -> DataFrame:
    """``source``, its number ``idx``, ``blocks``, ``share``, ``weight`` and how it ends. Bounded by MAX_SOURCES rows.

    ``share`` is the target in whole numbers that add up to SCALE, in long mixes to less, so
    that products with a number of blocks are longs. When the source runs out in the fluid
    mix, those before it had ``gone`` blocks and it and the others have ``live`` shares; it
    has no blocks left from slot ``end`` on.
    """
    counts = keys.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if isinstance(target, DataFrame):
        known = target.select(F.col("source").alias("t"), F.col("target").cast("double").alias("target"))
        counts = counts.join(known, F.col("source").eqNullSafe(F.col("t")), "left").drop("t")
        counts = counts.withColumn("target", F.coalesce("target", F.lit(0.0)))
    else:
        counts = counts.withColumn("target", target(F.col("rows")))
    counts = materialize(counts)
    n = counts.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} can be scheduled together, so group them first")
    every = Window.partitionBy()  # at most MAX_SOURCES rows
    counts = counts.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    some = F.when((F.col("target") > 0) & ~F.isnan("target"), F.col("target"))
    scale = F.least(F.lit(SCALE), F.expr(f"{1 << 61}L div sum(blocks) over ()"))
    share = F.greatest(F.lit(1), F.floor(some / F.sum(some).over(every) * scale + 0.5)).cast("long")
    out = counts.withColumn("share", F.coalesce(share, F.lit(1).cast("long"))).withColumn(
        "idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1)
    by_end = Window.orderBy(F.col("blocks") / F.col("share"), "idx")
    out = out.withColumns({
        "weight": F.col("share") / F.sum("share").over(every),
        "gone": F.coalesce(F.sum("blocks").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        "live": F.sum("share").over(by_end.rowsBetween(0, Window.unboundedFollowing))})
    return materialize(out.withColumn("end", F.expr("gone + (live * blocks + share - 1) div share")))


#: State after slot t: blocks ``done`` per source, and the phase ``k``, which says what has run out.
STEP = """aggregate(
    array(if(get(phases, state.k + 1).end <= t + 1, state.k + 1, state.k)),
    state,
    (same, k) -> aggregate(
        array(array_min(transform(s, (x, i) -> if(
            same.done[i] < x.blocks and (x.end <= t + 1 or same.done[i] * phases[k].live < x.share * (t + 1 - phases[k].gone)),
            named_struct('due', (same.done[i] + 1) / x.share, 'i', i), null)))),
        same,
        (old, p) -> named_struct('done', transform(old.done, (d, i) -> if(i = p.i, d + 1, d)), 'k', k{picks})))"""


def schedule(sources: DataFrame, parts: int) -> DataFrame:
    """One row per block: ``idx`` of its source, ``block`` in it, its ``slot`` and window in the mix."""
    every = sources.agg(F.sort_array(F.collect_list(F.struct("idx", "share", "blocks", "end", "gone", "live"))).alias("s"),
                        F.sum("blocks").alias("total")).where("total > 0")
    every = every.withColumn("length", F.ceil(F.sqrt("total") / parts).cast("long") * parts)
    every = every.withColumn("phases", F.expr("""transform(
        array_sort(array_distinct(concat(array(0L), s.end))),
        e -> named_struct('end', e, 'gone', aggregate(s, 0L, (a, x) -> a + if(x.end <= e, x.blocks, 0L)),
                          'live', aggregate(s, 0L, (a, x) -> a + if(x.end > e, x.share, 0L))))"""))
    every = materialize(every)
    firsts = F.expr(f"""aggregate(
        sequence(0L, (total - 1) div length),
        named_struct('now', named_struct('done', transform(s, x -> 0L), 'k', 0),
                     'firsts', cast(array() as array<struct<done: array<bigint>, k: int>>)),
        (acc, r) -> named_struct(
            'now', aggregate(sequence(r * length, least(total, (r + 1) * length) - 1), acc.now, (state, t) -> {STEP.format(picks="")}),
            'firsts', array_append(acc.firsts, acc.now)),
        acc -> acc.firsts)""")
    rounds = materialize(every.select(F.posexplode(firsts).alias("round", "first")))
    picked = F.expr(f"""aggregate(
        sequence(round * length, least(total, (round + 1) * length) - 1),
        named_struct('done', first.done, 'k', first.k, 'picks', cast(array() as array<struct<i: int, block: bigint>>)),
        (state, t) -> {STEP.format(picks=", 'picks', array_append(old.picks, named_struct('i', p.i, 'block', old.done[p.i]))")},
        state -> state.picks)""")
    # Rounds are dealt out over the tasks; every one needs the small table of sources.
    slots = rounds.repartition("round").crossJoin(F.broadcast(every))
    slots = slots.select("s", (F.col("round") * F.col("length")).alias("base"), F.posexplode(picked).alias("at", "p"))
    slots = slots.select("s", F.expr("s[p.i].share").alias("share"), F.col("p.i").alias("idx"), "p.block", (F.col("base") + F.col("at")).alias("slot"))
    # Slots pass ever more slowly as sources run out, so the least of all lines holds.
    return slots.select(
        "idx", "block", "slot",
        F.expr("array_min(transform(s, x -> x.gone + (x.live * block) div share))").alias("release"),
        F.expr("array_min(transform(s, x -> x.gone + (x.live * (block + 1) + share - 1) div share))").alias("deadline"))


def mixed(docs: DataFrame, target=tempered, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``source``) with its place in the mix.

    ``target`` maps a source's row count to its weight, or is a table ``source``, ``target``
    (sources it lacks weigh nothing and come when the others have run out). ``parts`` slots
    are the least round; no result depends on it.
    Adds ``weight`` (the target share of the full mix), ``block`` in the source, the block's
    ``slot`` in the mix with its window ``release <= slot < deadline``, and ``place``, which
    orders all rows: by slot, then by row of the block. No row is dropped: when a source runs out the others
    go on in proportion. Documents of a source come in the order of a hash of their
    doc_id; rows without one, and repeated rows, stand side by side. Rows without a source
    are a source of their own. Columns of these names are replaced, all others pass.
    An empty table gives an empty one; more than ``MAX_SOURCES`` sources raise.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", uniform_key(name).alias("key"))
    keys = materialize(rows.select("source", "key"))
    sources = source_table(keys, target, block_rows)
    slots = materialize(schedule(sources, parts))

    # Rank within the source: rows before the key's range, plus the row number inside it.
    total = keys.count()
    bits = max(6, (total // RANK_ROWS).bit_length())
    span = F.shiftright("key", BITS - bits)
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keys.groupBy("source", span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("source", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    info = F.broadcast(sources.select("source", "idx", "weight")).alias("i")
    ranges = materialize(ranges.alias("r").join(info, F.col("r.source").eqNullSafe(F.col("i.source"))).select(
        F.col("r.source").alias("at_source"), F.col("span").alias("at_span"), "first", "idx", "weight"))
    small = F.broadcast if ranges.count() <= BROADCAST_ROWS else (lambda t: t)
    few = F.broadcast if slots.count() <= BROADCAST_ROWS else (lambda t: t)
    placed = rows.withColumn("span", span).join(
        small(ranges), F.col("source").eqNullSafe(F.col("at_source")) & (F.col("span") == F.col("at_span")))
    inside = Window.partitionBy("at_source", "at_span").orderBy("key", "doc.doc_id")
    placed = placed.withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)
    placed = placed.withColumns({"block": F.expr(f"rank div {block_rows}"), "row": F.col("rank") % block_rows})
    out = placed.join(few(slots), ["idx", "block"])
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in OWN]
    return out.select(*kept, "weight", "block", "release", "deadline", "slot",
                      (F.col("slot") * block_rows + F.col("row")).alias("place"))
