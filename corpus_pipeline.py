"""From raw documents to token files: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept; ``run`` applies them to ``documents``. All but the last return the columns of
``documents``. The mix takes effect through the order of the rows in its files, in
which the last stage writes the token ids.

In every stage a null text counts as empty and repeated rows are judged alike; rows
without a doc_id are judged like others but never named a copy; a null source is a
source of its own; further columns pass unchanged, whatever their names; an empty table
stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from isoplane.llm.decontamination import without_leaks
from isoplane.llm.mixing import BLOCK_ROWS, MAX_SOURCES, mixed
from isoplane.llm.near_duplicates import near_duplicates, without_copies
from isoplane.llm.quality import fit_network, quality_scores
from isoplane.llm.queries import QUALITY_CUT, table, word_vocabulary
from isoplane.llm.storage import new_folder
from isoplane.llm.token_files import ARROW_ROWS, read_order, read_tokens, write_tokens

FILE_ROWS = 20_000
FILE_BYTES = 64 << 20
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Batches of a few hundred whole texts for Python, unless the session has a smaller number of its own.

    An executor keeps the memory of its largest batches outside its heap for all later
    stages; 10,000 texts, the default, are tens of MB in each task.
    """
    rows = int(spark.conf.get(ARROW_ROWS))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the network learns from ``labels``."""
    small_batches(spark)
    model = fit_network(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, model, "__quality")
    return scored.where(F.col("__quality") >= QUALITY_CUT).select([F.col(f"`{c}`") for c in docs.columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    small_batches(spark)
    return without_copies(docs, near_duplicates(docs, words=5, threshold=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    small_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, by file and by row within a file."""
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["rows"] // FILE_ROWS), -(-size["bytes"] // FILE_BYTES))
    bound = size["rows"] + MAX_SOURCES * BLOCK_ROWS  # every source's last block may be short
    # Other columns travel under names that the schedule does not use.
    own = {c: f"u{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source")}
    out = mixed(docs.select([F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]))
    ordered = out.withColumn("part", F.floor(F.col("place") * parts / F.lit(bound)).cast("int"))
    dealt = ordered.repartitionById(parts, F.col("part")).sortWithinPartitions("place")
    return dealt.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the order of the mix and read back, one row per document."""
    small_batches(spark)
    folder = new_folder(spark, "tokens")
    ordered, order = read_order(docs)
    write_tokens(ordered, word_vocabulary(), folder, order=order)
    return read_tokens(spark, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination),
          ("mixing", mixing), ("tokens", tokens)]

#: A trained network and a tokenizer have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
