"""Near-equal shards by histogram sort.

Rows are ordered by a uniform 60-bit key, then by a second one. Exact bytes are
counted between equally spaced probes; only the intervals that hold an unmet
boundary get finer probes, round by round, until every boundary lies on an edge
within tolerance. The driver sees histograms of at most ``2**DIGIT`` bins per open
boundary. Rows are then dealt out once, into pieces small enough for a task, and
numbered within their shard.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from isoplane.cluster import materialize

BITS = 60
DIGIT = 12
PIECES = 64
PIECE_BYTES = 64 << 20
BROADCAST_ROWS = 200_000


def uniform_key(text):
    """60 bits of a digest as a non-negative long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long")


def _values(spark: SparkSession, rows, names) -> DataFrame:
    """A small table of whole numbers."""
    body = ", ".join("(" + ", ".join(f"{int(v)}L" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(names)})")


def _histogram(rows: DataFrame, nodes, level: int) -> dict:
    """Bytes per bin of every open node: ``{node: [(bin, bytes), ...]}`` in key order."""
    part, shift = ("k1", BITS - DIGIT * (level + 1)) if level < BITS // DIGIT else ("k2", 2 * BITS - DIGIT * (level + 1))
    digit = F.shiftright(part, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
    if level == 0:
        keyed = rows.withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    else:
        in_first = level <= BITS // DIGIT
        first = F.shiftright("k1", BITS - DIGIT * level) if in_first else F.col("k1")
        second = F.lit(0).cast("long") if in_first else F.shiftright("k2", 2 * BITS - DIGIT * level)
        wanted = _values(rows.sparkSession, nodes, ["p1", "p2"])
        keyed = rows.withColumns({"p1": first, "p2": second}).join(F.broadcast(wanted), ["p1", "p2"])
    bins = keyed.groupBy("p1", "p2", digit.alias("bin")).agg(F.sum("size").alias("bytes")).collect()
    out = {}
    for r in sorted(bins, key=lambda r: r["bin"]):
        out.setdefault((r["p1"], r["p2"]), []).append((r["bin"], r["bytes"]))
    return out


def splitters(rows: DataFrame, shards: int, total: int, tolerance: float = 0.0, split_above: float = 0.1) -> list:
    """The first key ``(k1, k2)`` of shards 1, 2, ...; None where no row is left for them.

    ``rows`` has ``k1``, ``k2`` and ``size``. A boundary goes to the nearest edge
    between keys ``k1`` that is refined to within ``tolerance`` of an ideal shard
    (0: until no edge is nearer). Keys with more than ``split_above`` of an ideal
    shard may be cut, between values of ``k2``.
    """
    levels = BITS // DIGIT
    found = [None] * (shards - 1)
    # node -> bytes before it; boundary j wants total * j / shards bytes below it
    open_nodes = {(0, 0): (0, list(range(1, shards)))}

    def edge(level, node, number):
        """Key at the lower end of a bin; the bin after the last one ends its node."""
        p1, p2 = node
        value = ((p1 if level < levels else p2) << DIGIT) + number
        if level < levels:
            key = (value << (BITS - DIGIT * (level + 1)), 0)
        else:
            key = (p1, value << (2 * BITS - DIGIT * (level + 1)))
        if key[1] >> BITS:
            key = (key[0] + 1, 0)
        return None if key[0] >> BITS else key

    for level in range(2 * levels):
        if not open_nodes:
            break
        counted = _histogram(rows, list(open_nodes), level)
        deeper = {}
        for node, (before, wanted) in open_nodes.items():
            at = before
            bins = counted[node]
            for number, size in bins:
                for j in [j for j in wanted if at * shards <= total * j < (at + size) * shards]:
                    under, over = total * j - at * shards, (at + size) * shards - total * j
                    alone = level == levels - 1 and size * shards <= split_above * total
                    if min(under, over) <= tolerance * total or alone or level == 2 * levels - 1:
                        found[j - 1] = edge(level, node, number if under <= over else number + 1)
                    else:
                        p1, p2 = node
                        below = ((p1 << DIGIT) + number, 0) if level < levels else (p1, (p2 << DIGIT) + number)
                        deeper.setdefault(below, (at, []))[1].append(j)
                at += size
        open_nodes = deeper
    return found


def histogram_shards(df: DataFrame, shards: int, tolerance: float = 0.0, split_above: float = 0.1,
                     piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Deal the rows of ``df`` into ``shards`` of near-equal bytes.

    ``df`` needs ``k1``, ``k2`` (longs below 2**60, rows of one group share ``k1``),
    ``size`` (long) and a ``tie`` to order rows of equal keys; other columns pass.
    Adds ``shard`` and ``slot``, gapless from 0 within a shard in key order. Groups
    stay whole up to ``split_above`` of an ideal shard; a larger one is cut between
    its rows. Null keys and sizes are not accepted: callers hash and fill them.
    Shards may stay empty when there are fewer rows. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = materialize(df.select("k1", "k2", "size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = splitters(rows, shards, total, tolerance, split_above) if shards > 1 and total else []
    live = [c for c in cuts if c is not None]
    # Boundaries are few and known: a sorted array of them gives the shard.
    if live:
        edges = F.array(*[F.struct(F.lit(a).cast("long").alias("k1"), F.lit(b).cast("long").alias("k2")) for a, b in live])
        shard = F.size(F.filter(edges, lambda e: e <= F.struct(F.col("k1"), F.col("k2")))).cast("int")
    else:
        shard = F.lit(0).cast("int")
    # Pieces: equal ranges of k1; a key that fills a piece by itself is cut by k2.
    piece = max(1, min(piece_bytes, total // PIECES))
    bits = max(0, (total // piece).bit_length()) if total else 0
    hot = materialize(rows.groupBy("k1").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > piece)
                      .groupBy(F.shiftright("k1", BITS - bits).alias("range")).agg(F.sort_array(F.collect_list("k1")).alias("hot")))

    def pieces(table):
        out = table.withColumns({"shard": shard, "range": F.shiftright("k1", BITS - bits)}).join(
            F.broadcast(hot), "range", "left")  # at most total / piece_bytes keys
        own = F.coalesce(F.array_contains("hot", F.col("k1")), F.lit(False))
        less = F.coalesce(F.size(F.filter("hot", lambda h: h < F.col("k1"))), F.lit(0))
        return out.withColumns({"part": 2 * less + F.when(own, 1).otherwise(0),
                                "cut": F.when(own, F.shiftright("k2", BITS - 6)).otherwise(0)}).drop("hot")

    where = ["shard", "range", "part", "cut"]
    counts = pieces(rows).groupBy(*where).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("range", "part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"))
    small = F.broadcast if starts.count() <= BROADCAST_ROWS else (lambda t: t)
    order = Window.partitionBy(*where).orderBy("k1", "k2", "tie")
    placed = pieces(df).join(small(starts), where)
    return placed.withColumn("slot", F.col("first") + F.row_number().over(order) - 1).drop("range", "part", "cut", "first")
