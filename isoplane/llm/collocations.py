"""Phrases that stick together, by multikey quicksort of suffix pointers.

A word's suffix is the word and the up to four that follow it in its piece. Leading
pairs of words are counted over everything first: suffixes whose pair is infrequent are
abandoned and all others end where an infrequent pair begins. Tasks sort the rest by
three-way partitioning, word by word: the size of a partition whose words are equal is
a phrase's count. Equal suffixes of a task travel once, to the task of their leading
pair, where partitions of infrequent size are abandoned; suffixes of very frequent pairs
are dealt over all tasks, whose counts are added up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from isoplane.llm.arrays import MIX, MIX2, ascii_lower, blocks, mixed, span_hashes, text_bytes, word_spans
from isoplane.llm.storage import stored

DEPTH = 5
BLOCK = 2 << 20
PIECE_ENDS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
#: Bits of the filter of frequent pairs: some per pair, never more than this.
PAIR_BITS = 1 << 27
BITS_EACH = 32
#: Suffixes that a task of the last sort should hold.
TASK_ROWS = 500_000
BROADCAST_ROWS = 200_000


def suffix_sort(words: np.ndarray, weights: np.ndarray, least: int):
    """Frequent prefixes of weighted suffixes, and the suffixes that are equal as a whole.

    ``words`` has a row per suffix, 0 where it has ended. Multikey quicksort, all open
    partitions in step: each takes the word of its middle pointer as pivot and splits into
    pointers with a smaller, an equal and a larger word at its depth. The equal part's
    weight is its prefix's count and it goes on one word deeper; parts of a weight below
    ``least`` are abandoned, since no prefix in them can be frequent. Both results are triples
    of length, a row that begins so (that is so) and weight.
    """
    most = words.shape[1]
    pointers, sizes = np.arange(len(words)), np.array([len(words)])
    starts, depths = np.zeros(1, np.int64), np.zeros(1, np.int64)
    prefixes, whole = [], []
    while len(pointers):
        part = np.repeat(np.arange(len(starts)), sizes)
        pivot = words[pointers[starts + sizes // 2], depths]
        here, middle = words[pointers, depths[part]], pivot[part]
        side = (here > middle).astype(np.int8) - (here < middle) + 1  # 0 smaller, 1 equal, 2 larger
        child = part * 3 + side
        many = np.bincount(child, minlength=3 * len(starts))
        weight = np.bincount(child, weights[pointers], minlength=3 * len(starts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        moved = np.empty_like(pointers)
        for s in range(3):  # pointers of a side keep their order
            of = np.flatnonzero(side == s)
            before = np.cumsum(many[s::3]) - many[s::3]
            moved[first[child[of]] + np.arange(len(of)) - before[part[of]]] = pointers[of]
        keep = (weight >= least) & (many > 0)
        equal = np.arange(len(many)) % 3 == 1
        depth = np.repeat(depths, 3) + equal
        ended = equal & (np.repeat(pivot, 3) == 0)
        full = equal & (depth == most) & ~ended
        for out, of, length in ((prefixes, keep & equal & ~ended, depth), (whole, keep & (ended | full), depth - ended)):
            at = np.flatnonzero(of)
            out.append((length[at], moved[first[at]], weight[at]))
        keep &= ~ended & ~full
        pointers, sizes, depths = moved[np.repeat(keep, many)], many[keep], depth[keep]
        starts = np.cumsum(sizes) - sizes
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    return join(prefixes), join(whole)


class Words:
    """Words of texts end to end: language, hash, and how many words are left in their piece."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.data = data = ascii_lower(data)
        ends = np.isin(data, PIECE_ENDS)
        self.starts, self.stops = word_spans(~(ends | (data == 32) | (data == 9)), offsets)
        self.hashes = np.maximum(span_hashes(data, self.starts, self.stops), np.uint64(1))  # 0 stands for no word
        row = np.searchsorted(offsets, self.starts, "right") - 1
        langs = part.column(part.schema.get_field_index("lang")).dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)[row]
        # A word is linked to the next one unless a text or piece ends between them.
        cut = np.cumsum(ends)[self.starts] if len(data) else np.zeros(0, np.int64)
        self.linked = (cut[1:] == cut[:-1]) & (row[1:] == row[:-1])
        names, at = text_bytes(self.langs.cast(pa.string()))
        self.pairs = pair_hashes(self.hashes[:-1], self.hashes[1:], span_hashes(names, at[:-1], at[1:])[self.lang[:-1]])


def pair_hashes(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A hash of language and two words; the order of the words counts."""
    return mixed((mixed(first + MIX) ^ second) * MIX2 + lang)


def _by_language(lang, keys):
    """Distinct (language, key) with counts and the first place of each."""
    order = np.lexsort((keys, lang))
    a, b = lang[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``h`` (hash), ``word`` and its count ``f`` for all words."""
    def count(batches):
        for part, data, offsets in blocks(batches, "text", BLOCK):
            w = Words(part, data, offsets)
            at, many = _by_language(w.lang, w.hashes)
            words = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[at], w.stops[at])]
            yield pa.RecordBatch.from_arrays(
                [w.langs.take(pa.array(w.lang[at])).cast(pa.string()), pa.array(w.hashes[at].view(np.int64)), pa.array(words, pa.string()), pa.array(many)],
                ["lang", "h", "word", "f"])

    return _rows(docs).mapInArrow(count, "lang string, h long, word string, f long").groupBy("lang", "h").agg(
        F.min("word").alias("word"), F.sum("f").alias("f"))


def pair_counts(docs: DataFrame, least: int) -> DataFrame:
    """Hash ``p`` of language and two words that stand together at least ``least`` times, and their count ``f``."""
    def count(batches):
        for part, data, offsets in blocks(batches, "text", BLOCK):
            w = Words(part, data, offsets)
            p, many = np.unique(w.pairs[w.linked], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(many)], ["p", "f"])

    return _rows(docs).mapInArrow(count, "p long, f long").groupBy("p").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def pair_filter(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit field that holds every pair of a written table, and its size in bits.

    It has BITS_EACH bits per pair but never more than PAIR_BITS (16 MB): with many more
    pairs it passes some infrequent ones too, which costs work and changes no count.
    """
    n = pairs.count()
    bits = 1 << 16
    while bits < min(n * BITS_EACH, PAIR_BITS):
        bits *= 2
    slot = F.pmod("p", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = pairs.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("set"))
    frame = rows.toPandas()  # at most one row per 64 bits of the field
    field = np.zeros(bits // 64, np.int64)
    field[frame["word"].to_numpy(np.int64)] = frame["set"].to_numpy(np.int64)
    return field, bits


def in_filter(p: np.ndarray, field: np.ndarray, bits: int) -> np.ndarray:
    slot = (p & np.uint64(bits - 1)).astype(np.int64)
    return (field[slot >> 6] >> (slot & 63)) & 1 == 1


def suffixes(w: Words, field: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all suffixes that begin with a pair of the filter, up to where one ends, and their first words' places."""
    good = w.linked & in_filter(w.pairs, field, bits) if len(w.pairs) else np.zeros(0, bool)
    at = np.flatnonzero(good)
    out = np.zeros((len(at), DEPTH), np.uint64)
    if not len(at):
        return out, at
    out[:, 0], out[:, 1] = w.hashes[at], w.hashes[at + 1]
    on = np.ones(len(at), bool)
    padded = np.concatenate([good, np.zeros(DEPTH, bool)])
    for k in range(2, DEPTH):
        on = on & padded[at + k - 1]
        out[on, k] = w.hashes[at[on] + k]
    return out, at


def _key(words: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words of a phrase as binary, eight bytes each, big-endian."""
    inside = np.arange(words.shape[1])[None] < lengths[:, None]
    raw = np.ascontiguousarray(words[inside].astype(">u8")).tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _words_of(column) -> np.ndarray:
    """The words of a binary column of phrases, 0 where they have ended."""
    raw, at = text_bytes(column)
    out = np.zeros((len(column), DEPTH), np.uint64)
    out[np.arange(DEPTH)[None] < np.diff(at)[:, None] // 8] = raw.view(">u8")
    return out


def with_language(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes with their language's code as the first word."""
    return np.concatenate([lang.astype(np.uint64)[:, None] + np.uint64(1), words], 1)


def phrase_counts(docs: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase`` (hashes, eight bytes a word) and count ``f`` of all phrases of 2 to DEPTH words with ``f >= least``.

    ``pairs`` is the written table of ``pair_counts``. A pair of more than its task's share of
    the rows is hot: its suffixes are dealt by all their words, and what the tasks count of
    their prefixes is added up.
    """
    spark = docs.sparkSession
    total = pairs.agg(F.sum("f")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    share = max(total // (4 * parts), 4 * least)
    hot = np.sort(np.array([r["p"] for r in pairs.where(F.col("f") > share).select("p").collect()], np.int64).view(np.uint64))  # under 4 * parts
    known = spark.sparkContext.broadcast((*pair_filter(pairs), hot))

    def deal(batches):
        field, bits, hot = known.value
        for part, data, offsets in blocks(batches, "text", BLOCK):
            w = Words(part, data, offsets)
            words, at = suffixes(w, field, bits)
            if not len(at):
                continue
            _, (lengths, row, many) = suffix_sort(with_language(w.lang[at], words), np.ones(len(at), np.int64), 1)
            kept, first, lengths = words[row], at[row], lengths - 1
            p = w.pairs[first]
            is_hot = np.isin(p, hot)
            spread = p.copy()
            for k in range(2, DEPTH):
                spread = np.where(is_hot, mixed((spread ^ kept[:, k]) * MIX2 + np.uint64(k)), spread)
            yield pa.RecordBatch.from_arrays(
                [pa.array((mixed(spread) % np.uint64(parts)).astype(np.int32)), w.langs.take(pa.array(w.lang[first])).cast(pa.string()),
                 pa.array(is_hot), _key(kept, lengths), pa.array(many)], ["part", "lang", "hot", "phrase", "f"])

    def sort(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        words = with_language(langs.indices.to_numpy(), _words_of(table.column("phrase")))
        weights, is_hot = table.column("f").to_numpy(), table.column("hot").combine_chunks().to_numpy(zero_copy_only=False)
        for rows, enough in ((~is_hot, least), (is_hot, 1)):
            own = words[rows]
            (depth, row, f), _ = suffix_sort(own, weights[rows], enough)
            phrase = depth > 2  # the language is the first word
            depth, row, f = depth[phrase], row[phrase], f[phrase]
            lang = langs.dictionary.take(pa.array((own[row, 0] - np.uint64(1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, _key(own[row, 1:], depth - 1), pa.array(f)], ["lang", "phrase", "f"])

    dealt = _rows(docs).mapInArrow(deal, "part int, lang string, hot boolean, phrase binary, f long")
    sorted_ = dealt.repartitionById(parts, F.col("part")).mapInArrow(sort, "lang string, phrase binary, f long")
    return sorted_.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _some(table: DataFrame) -> DataFrame:
    """A broadcast of a written table up to BROADCAST_ROWS rows; beyond, Spark joins by shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def scored(phrases: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a`` and its lowest-scoring cut: ``l``, ``r``, ``n``, ``score``.

    ``phrases`` and ``words`` hold ``lang``, ``phrase`` and count ``f``, ``sizes`` ``lang`` and ``n``. The products
    are decimals of 38 digits, exact while a * n stays below 10^35.
    """
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, cast(octet_length(phrase) / 8 as int) - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring(phrase, 1, 8 * k)"), "rest": F.expr("substring(phrase, 8 * k + 1)")})
    counts = _some(words.unionByName(phrases))
    met = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(_some(sizes), "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (whole("a") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    best = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(found: DataFrame, phrases: DataFrame, cover: int) -> DataFrame:
    """``found`` without phrases that stand inside a longer one with at least ``cover`` percent of their count.

    The phrases one word longer decide: whatever is longer still occurs at most as often
    as one of those it contains.
    """
    longer = phrases.where("octet_length(phrase) > 16").select("lang", "f", F.explode(F.array(
        F.expr("substring(phrase, 1, octet_length(phrase) - 8)"), F.expr("substring(phrase, 9)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return found.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, cover: int = 100) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (``text``, ``lang``) that stand together most.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, those into words at
    blanks and tabs. Candidates are phrases of 2 to DEPTH words within a piece, at least ``least``
    times in their language, overlaps included. A cut into a first part and a rest scores
    ``floor(1000 * a * n / (l * r))`` with the counts of phrase, all words, first part and rest; the
    lowest-scoring cut, the first on ties, counts. Candidates inside a longer one with at
    least ``cover`` percent of their count go. Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``,
    ``score`` by descending score and count, then by phrase.

    Null and empty texts have no words, a null language is ``und``; repeated rows count
    each; other columns are ignored; an empty table gives an empty one. Words are told
    apart by 64-bit hashes. Counts cover all rows; nothing is capped or sampled.
    """
    is_frequent = F.col("f") >= least
    rare_apart = word_counts(docs).select("lang", F.when(is_frequent, F.col("h")).alias("h"), F.when(is_frequent, F.col("word")).alias("word"), "f")
    words = stored(rare_apart.groupBy("lang", "h", "word").agg(F.sum("f").alias("f")))  # the rare ones of a language are one row
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    named = words.where("h is not null").select("lang", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("phrase"), "word", "f")
    phrases = stored(phrase_counts(docs, stored(pair_counts(docs, least)), least))
    found = stored(uncovered(scored(phrases, named.drop("word"), sizes), phrases, cover))

    order = [F.col("score").desc(), F.col("a").desc()]
    first = found.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    first = stored(first)
    each = first.select("lang", "phrase", F.explode(F.expr("sequence(0, cast(octet_length(phrase) / 8 as int) - 1)")).alias("k"))
    each = each.withColumn("part", F.expr("substring(phrase, 8 * k + 1, 8)"))
    spelt = each.join(_some(named.select("lang", F.col("phrase").alias("part"), "word")), ["lang", "part"]).groupBy("lang", "phrase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))
    out = first.join(spelt, ["lang", "phrase"]).drop("phrase").withColumnRenamed("text", "phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
