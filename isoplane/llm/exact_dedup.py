"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the digits of a number in base B, taken modulo a prime in three
lanes. Chunks are hashed on their own and combine by length-shifted arithmetic,
``H(xy) = H(x) + B^len(x) * H(y)``, so a huge document is cut into segments that
different tasks hash. Equal fingerprints are then confirmed chunk by chunk: within
a group every chunk must have an equal least and greatest value, which Spark
aggregates map-side; no task holds a whole group.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoplane.cluster import materialize
from isoplane.llm.arrays import blocks

PRIME = 2**31 - 1
#: One base per lane; any three distinct numbers below PRIME would do.
BASES = (1_103_515_245, 747_796_405, 1_597_334_677)
CHUNK = 4096
LANES = [f"fp{i}" for i in range(len(BASES))]


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n - 1)`` modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate([out, out * step % np.uint64(PRIME)])
    return out[:n]


def combine(left: int, left_bytes: int, right: int, base: int) -> int:
    """Fingerprint of two joined texts from theirs."""
    return (left + pow(base, left_bytes, PRIME) * right) % PRIME


class Fingerprint:
    """Fingerprints of byte arrays, one chunk per matrix row."""

    def __init__(self):
        self.weights = np.stack([powers(b, CHUNK) for b in BASES], 1).astype(np.float64)

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all chunks. Sums stay below 2**51, so doubles hold them exactly."""
        n = -(-len(data) // CHUNK)
        padded = np.zeros(n * CHUNK)
        padded[:len(data)] = data
        return (padded.reshape(n, CHUNK) @ self.weights).astype(np.uint64) % np.uint64(PRIME)

    def of(self, data: np.ndarray) -> list[int]:
        """One number per lane."""
        if len(data) <= CHUNK:
            values = data.astype(np.float64) @ self.weights[:len(data)]
            return [int(v) % PRIME for v in values]
        hashes = self.chunks(data)
        out = []
        for lane, base in enumerate(BASES):
            shift = powers(pow(base, CHUNK, PRIME), len(hashes))
            out.append(int((hashes[:, lane] * shift % np.uint64(PRIME)).sum() % np.uint64(PRIME)))
        return out


def _whole(batches):
    """Fingerprints of whole texts; all other columns pass."""
    hasher = Fingerprint()
    for rows, data, offsets in blocks(batches, "body"):
        found = np.array([hasher.of(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64).reshape(-1, len(BASES))
        rest = [rows.column(i) for i, c in enumerate(rows.schema.names) if c != "body"]
        names = [c for c in rows.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays(rest + [pa.array(found[:, i]) for i in range(len(BASES))], names + LANES)


def _segments(batches):
    """Fingerprints of segments, shifted to their place in the document."""
    for out in _whole(batches):
        at = out.column("at").to_numpy()
        names = [c for c in out.schema.names if c not in LANES]
        shifted = [pa.array([h * pow(b, int(a), PRIME) % PRIME for h, a in zip(out.column(lane).to_pylist(), at)], pa.int64())
                   for lane, b in zip(LANES, BASES)]
        yield pa.RecordBatch.from_arrays([out.column(c) for c in names] + shifted, names + LANES)


def fingerprints(docs: DataFrame, huge_bytes: int = 8 << 20, segment_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id``, ``bytes``, ``quick`` (a 64-bit hash), ``sha`` and the lanes ``fp0..`` of every row.

    Texts above ``huge_bytes`` are cut into segments that are dealt out to all tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("quick"),
        F.sha2(text, 256).alias("sha"), text.alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lanes = ", ".join(f"{c} long" for c in LANES)
    usual = rows.where(F.col("bytes") <= huge_bytes).mapInArrow(
        _whole, f"doc_id {kind}, bytes long, quick long, sha string, {lanes}")
    count = F.ceil(F.col("bytes") / segment_bytes)
    cut = rows.where(F.col("bytes") > huge_bytes).withColumn(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn(
        "at", F.col("at") * segment_bytes).withColumn("body", F.substring(F.encode("body", "UTF-8"), (F.col("at") + 1).cast("int"), F.lit(segment_bytes)))
    dealt = cut.repartition("doc_id", "sha", "at").mapInArrow(
        _segments, f"doc_id {kind}, bytes long, quick long, sha string, at long, {lanes}")
    # Repeated rows of one document have equal segments: counted once, then restored.
    single = dealt.groupBy("doc_id", "bytes", "quick", "sha", "at").agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in LANES])
    huge = single.groupBy("doc_id", "bytes", "quick", "sha").agg(
        F.max("copies").alias("copies"), *[(F.sum(c) % PRIME).alias(c) for c in LANES])
    huge = huge.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
    return usual.unionByName(huge)


def unequal_groups(docs: DataFrame, members: DataFrame, compare_bytes: int = 64 << 10) -> DataFrame:
    """Groups ``gid`` whose texts differ although their fingerprints agree, found chunk by chunk."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bodies = docs.select(F.col("doc_id"), F.octet_length(text).cast("long").alias("bytes"),
                         F.xxhash64(text).alias("quick"), F.encode(text, "UTF-8").alias("body"))
    met = bodies.alias("b").join(members.alias("m"), (F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")))
                                 & (F.col("b.bytes") == F.col("m.bytes")) & (F.col("b.quick") == F.col("m.quick")))
    chunks = met.select("m.gid", "b.body", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.col("b.bytes") / compare_bytes))).alias("chunk"))
    chunk = F.substring(F.col("body"), (F.col("chunk") * compare_bytes + 1).cast("int"), F.lit(compare_bytes))
    compared = chunks.select("gid", "chunk", chunk.alias("piece")).groupBy("gid", "chunk").agg(
        F.min("piece").alias("least"), F.max("piece").alias("greatest"))
    return compared.where(F.col("least") != F.col("greatest")).select("gid").distinct()


def exact_duplicates(docs: DataFrame, huge_bytes: int = 8 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """The group of equal texts of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``keep_id`` (largest doc_id of the group), ``group_size``,
    ``kept``, ``text_sha256`` and ``bytes``. Null texts count as empty ones, which
    are one group. Repeated rows of one doc_id and text each give a row, count in
    ``group_size`` and share the decision, since a doc_id names one document; rows
    without a doc_id are kept only where their group has no other. One doc_id with
    several texts is judged per text. Other columns are ignored. An empty table
    gives an empty one.

    Membership tables are broadcast up to ``broadcast_rows`` rows, else joined by shuffle.
    """
    prints = materialize(fingerprints(docs, huge_bytes))
    key = [*LANES, "bytes"]
    groups = materialize(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
                         .where("n > 1").withColumn("gid", F.xxhash64(*key)))
    size = groups.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("m")).first()
    small = F.broadcast if size["g"] <= broadcast_rows else (lambda df: df)
    few = F.broadcast if size["m"] <= broadcast_rows else (lambda df: df)
    members = materialize(prints.join(small(groups.select(*key, "gid")), key).select(
        "doc_id", "bytes", "quick", "gid").distinct())
    wrong = materialize(unequal_groups(docs, few(members)))
    if not wrong.isEmpty():
        # Unequal texts with equal fingerprints: such groups are told apart by their digests too.
        bad = groups.join(wrong, "gid", "left_semi").select(*key, F.lit(True).alias("split"))
        prints = materialize(prints.join(bad, key, "left").withColumn(
            "apart", F.when(F.col("split"), F.col("sha")).otherwise("")).drop("split"))
        key = [*key, "apart"]
        groups = materialize(prints.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where("n > 1"))
    out = prints.join(small(groups.select(*key, "n", "top")), key, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), "bytes")
