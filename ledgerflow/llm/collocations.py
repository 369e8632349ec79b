"""Phrase collocation mining by dynamic itemset counting.

Counts
    The documents are dealt into ``shards`` that are scanned in a cycle, one
    a step. Words are counted from the first step on; a longer phrase becomes
    active at the step after both its subphrases (without its last, without
    its first word) have reached the threshold, so lengths are interleaved,
    and is counted until its own full cycle is over, wherever that began. A
    phrase that reaches the threshold has subphrases that do, so all of them
    are found and their counts are those of the whole corpus. The scans end
    when no phrase has shards left.

A step
    The tasks cut the shard's texts into words and count the active phrases;
    their counts are added to the written table of phrases (one exchange).
    What tasks know of that table is, for each of ``1 << filter_bits`` slots
    by hash, the first step at which a phrase of the slot reached the
    threshold: a proven bound on what is broadcast. A slot's step never
    changes once it is set, so all tasks of all steps agree on when a phrase
    became active: after the slots of all the phrases it holds are set, so
    that no shard of its cycle passes it over. Phrases that share a slot can
    only make others active early or in vain; each is still counted in every
    shard exactly once.
    A phrase that has had its full cycle without reaching the threshold
    leaves the table.

Collocations
    Every cut of a candidate into two parts gives 2,000,000 a / (l + r),
    floored; the lowest counts, ties to the earliest cut. A candidate within a
    longer one that is found in ``CONTAINED_PERCENT`` of its places goes.
    Products are taken as decimals, beyond 64 bits.

Everything is per language (null: ``und``). Null texts count as empty. Texts
are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those
into words ``[^\\x20\\x09]+``; no phrase crosses pieces. Repeated rows count
each; ids play no part. An empty table gives an empty answer. A task holds
``BLOCK_WORDS`` words (more only if one text has more) and the distinct words
of its part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import prepare, scratch_path, text_of

THRESHOLD = 30
LONGEST = 4
TOP = 2000
CONTAINED_PERCENT = 80
SHARDS = 2
FILTER_BITS = 24
# Bytes of text cut into words at once, and words counted at once.
CHUNK_BYTES = 4 << 20
BLOCK_WORDS = 3 << 19
ROWS_AT_ONCE = 100_000
NO_LANGUAGE = "und"
NEVER = 255
MOST_STEPS = 250

_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "phrase string, lang string, slot int, start int, count bigint"
PHRASES = "phrase string, lang string, slot int, start int, reach int, count bigint"


def words_of(data: np.ndarray, starts: np.ndarray):
    """(words as an Arrow array, piece of each, text of each) of texts that lie one after the other in ``data``."""
    import pyarrow as pa

    kind = _KIND[data]
    word = kind == _WORD
    starts_here = starts[starts < len(data)]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[starts_here] = word[starts_here]
    at = np.flatnonzero(begins)
    marks = kind == _BREAK
    marks[starts_here] = True
    letters, running = _LOWER[data[word]], np.cumsum(word, dtype=np.int32)
    offsets = np.append(running[at] - 1, len(letters)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.cumsum(marks, dtype=np.int64)[at], np.searchsorted(starts, at, "right") - 1


class ShardCounter:
    """Counts of one task's texts at one step: rows (phrase, lang, slot, start, count) of the active phrases.

    ``first`` has for each slot the first step at which a phrase of it reached the threshold, or ``NEVER``.
    """

    def __init__(self, step: int, shards: int, longest: int, first: np.ndarray) -> None:
        self.step, self.shards, self.longest, self.first = step, shards, longest, first
        self.shift = np.uint64(64 - (len(first).bit_length() - 1))
        self.languages: dict[str, int] = {}
        self.block: list[tuple] = []
        self.waiting, self.piece = 0, 0

    def batch(self, languages: list[str], texts):
        """Take an Arrow array of texts; yields record batches when a block is full."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        codes = np.array([self.languages.setdefault(x, len(self.languages)) for x in languages], np.int64)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
            words, piece, text = words_of(data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row])
            if len(words):
                self.block.append((words, (piece + self.piece).astype(np.int32), codes[row:end][text].astype(np.int32)))
                self.piece += int(piece[-1]) + 1
                self.waiting += len(words)
            row = end
            if self.waiting >= BLOCK_WORDS:
                yield from self.flush()

    def flush(self):
        """Count what is waiting."""
        import pandas as pd
        import pyarrow as pa
        import xxhash

        if not self.block:
            return
        words, piece, language = zip(*self.block)
        self.block, self.waiting, self.piece = [], 0, 0
        coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        known, names = coded.dictionary, list(self.languages)
        pairs = np.concatenate(language).astype(np.int64) * len(known) + coded.indices.to_numpy(zero_copy_only=False)
        numbers, distinct = pd.factorize(pairs)
        numbers, piece = numbers.astype(np.int32), np.concatenate(piece)
        del words, language, coded, pairs
        of_word, spelled = distinct // len(known), known.take(pa.array(distinct % len(known)))
        seeds = [f"{len(x)}:{x}".encode() for x in names]
        hashed = (xxhash.xxh3_64_intdigest(seeds[n] + w) for n, w in zip(of_word.tolist(), spelled.to_pylist()))
        hashes = np.fromiter(hashed, np.uint64, len(distinct))
        yield from self._counted(numbers, piece, hashes, of_word, pa.array(names, pa.string()), spelled)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def _counted(self, words: np.ndarray, piece: np.ndarray, hashes: np.ndarray, language: np.ndarray, names, spelled):
        """``words`` are numbers of ``spelled`` words, which have a hash and the number of a language's name."""
        slot = self._slots(hashes)
        if self.step < self.shards:  # words are counted in the first cycle
            counts = np.bincount(words, minlength=len(language))
            totals = np.bincount(language, counts, len(names)).astype(np.int64)
            yield from self._rows(names, spelled, language, [np.arange(len(language))], slot, np.zeros(len(slot)), counts)
            yield from self._rows(names, None, None, [np.flatnonzero(totals)], None, None, totals[totals > 0])
        first = self.first[slot][words]
        # Of the phrases of one size less whose slot, and those of all they hold, have reached the threshold:
        # where they stand, when the last of these slots did, and their hash.
        place = np.flatnonzero(first != NEVER)
        first, mixed = first[place], hashes[words[place]]
        for size in range(2, self.longest + 1):
            joined = np.flatnonzero((place[1:] == place[:-1] + 1) & (piece[place[:-1]] == piece[place[:-1] + size - 1]))
            place = place[joined]
            since = np.maximum(first[joined], first[joined + 1]).astype(np.int16)
            mixed = mixed[joined] * _MULTIPLIER + hashes[words[place + size - 1]]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _MULTIPLIER
            active = np.flatnonzero((since < self.step) & (self.step <= since + self.shards))
            code, one = _grouped(words, place[active], size, mixed[active])
            parts = [words[place[active[one]] + i] for i in range(size)]
            slot, start = self._slots(mixed[active[one]]), since[active[one]] + 1
            yield from self._rows(names, spelled, language, parts, slot, start, np.bincount(code, minlength=len(one)))
            if size < self.longest:
                first = self.first[self._slots(mixed)]
                going = np.flatnonzero(first != NEVER)
                # Another phrase may have set the slot before the phrases it holds became known.
                first = np.maximum(first[going], since[going]).astype(np.uint8)
                place, mixed = place[going], mixed[going]

    def _rows(self, names, spelled, language, parts: list[np.ndarray], slots, starts, counts: np.ndarray):
        """Record batches of phrases given by their words; without ``language`` totals by language."""
        import pyarrow as pa
        import pyarrow.compute as pc

        for i in range(0, len(counts), ROWS_AT_ONCE):
            part = slice(i, i + ROWS_AT_ONCE)
            here = [p[part] for p in parts]
            n = len(here[0])
            if language is None:
                phrase, lang = pa.array([""] * n), names.take(pa.array(here[0]))
                slot = start = np.zeros(n, np.int32)
            else:
                each = [spelled.take(pa.array(p)) for p in here]
                phrase = (pc.binary_join_element_wise(*each, b" ") if len(each) > 1 else each[0]).cast(pa.string())
                lang = names.take(pa.array(language[here[0]]))
                slot, start = slots[part].astype(np.int32), starts[part].astype(np.int32)
            columns = [phrase, lang, pa.array(slot), pa.array(start), pa.array(counts[part].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["phrase", "lang", "slot", "start", "count"])


def _grouped(words: np.ndarray, place: np.ndarray, size: int, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each place's phrase, a place's index for each number): by hash, and by the words should two hashes be equal."""
    import pandas as pd

    def with_one(code, n):
        one = np.zeros(n, np.int64)
        one[code] = np.arange(len(code))
        return code, one

    code, distinct = pd.factorize(mixed)
    code, one = with_one(code, len(distinct))
    if all(np.array_equal(words[place + i], words[place[one] + i][code]) for i in range(size)):
        return code, one
    code = words[place].astype(np.int64)
    for i in range(1, size):
        code, distinct = pd.factorize(code << 32 | words[place + i])
    return with_one(code, len(distinct))


class _Kept:
    """A table under the shared folder that gives way to its successor."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path, before = scratch_path(self.spark, self.name), self.path
        df.write.parquet(path)
        self.path = path
        if before:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)


def sharded(docs: DataFrame, shards: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, text, shard), written with a folder per shard; each task deals its rows out in turn."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        text_of(text_col).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    path = scratch_path(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _size() -> Column:
    """The number of words of ``phrase``."""
    spaces = F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "), F.lit("")))
    return F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).cast("int")


def _first_words(size: Column) -> Column:
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), size)


def _scan(shard: DataFrame, phrases: DataFrame, step: int, shards: int, threshold: int, longest: int, filters) -> DataFrame:
    """The table of phrases after one step."""

    def run(batches):
        counter = ShardCounter(step, shards, longest, filters.value)
        for batch in batches:
            yield from counter.batch(batch.column(0).to_pylist(), batch.column(1))
        yield from counter.flush()

    counted = shard.select("lang", "text").mapInArrow(run, COUNTED).withColumn("reach", F.lit(None).cast("int"))
    summed = (
        phrases.unionByName(counted).groupBy("phrase", "lang")
        .agg(*[F.min(c).alias(c) for c in ("slot", "start", "reach")], F.sum("count").alias("count"))
    )
    now = F.when((F.col("phrase") != "") & (F.col("count") >= threshold), F.lit(step))
    over = (F.col("phrase") != "") & F.col("reach").isNull() & (F.col("start") + shards - 1 <= step)
    columns = ["phrase", "lang", "slot", "start", "reach", "count"]
    return summed.withColumn("reach", F.coalesce("reach", now).cast("int")).where(~over).select(*columns)


def _filter(phrases: DataFrame, longest: int, filter_bits: int) -> np.ndarray:
    """The first step by slot; one row per slot reaches the driver."""
    slots = (
        phrases.where(F.col("reach").isNotNull() & (_size() < longest))
        .groupBy("slot").agg(F.min("reach").alias("first")).toArrow()
    )
    first = np.full(1 << filter_bits, NEVER, np.uint8)
    first[slots.column("slot").to_numpy()] = slots.column("first").to_numpy()
    return first


def phrase_counts(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(phrase, lang, slot, start, reach, count, size): all phrases of 1 to ``longest`` words found ``threshold`` times or more.

    ``start`` and ``reach`` are the steps at which a phrase became active and
    reached the threshold. A row of size 0 holds the language's number of words.
    """
    spark = docs.sparkSession
    prepare(spark)
    if shards * longest > MOST_STEPS:
        raise ValueError(f"at most {MOST_STEPS} steps: {shards} shards, phrases of {longest} words")
    dealt = sharded(docs, shards, lang_col, text_col)
    kept = _Kept(spark, "phrases")
    phrases = spark.createDataFrame([], PHRASES)
    first = np.full(1 << filter_bits, NEVER, np.uint8)
    step, newest = 0, -1
    while step < shards or step <= newest + shards:
        sent = spark.sparkContext.broadcast(first)
        shard = dealt.where(F.col("shard") == step % shards)
        phrases = kept.put(_scan(shard, phrases, step, shards, threshold, longest, sent))
        sent.destroy()
        first = _filter(phrases, longest, filter_bits)
        newest = int(first[first != NEVER].max(initial=0)) if (first != NEVER).any() else -1
        step += 1
    return phrases.withColumn("size", _size())


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words and more, by their lowest cut."""
    reached = phrases.where(F.col("reach").isNotNull())
    left = reached.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l"))
    right = reached.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r"))
    cuts = (
        reached.where(F.col("size") > 1)
        .select("lang", "phrase", "size", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .withColumn("left", _first_words(F.col("k")))
        .withColumn("right", _first_words(F.col("k") - F.col("size")))
        .join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
    )
    score = F.call_function("div", _exact("a") * F.lit(2_000_000).cast("decimal(8,0)"), _exact("l") + _exact("r")).alias("score")
    lowest = F.min(F.struct(score, "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def without_contained(candidates: DataFrame, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The candidates without those that a longer one holds in ``percent`` of their places."""
    words = F.split("phrase", " ")
    inner = (
        candidates.where(F.col("size") > 2)
        .select("lang", "a", "size", words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
        .select("lang", "a", "words", "inner", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("start"))
        .select("lang", "a", F.array_join(F.slice("words", F.col("start"), F.col("inner")), " ").alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    contained = _exact("longer") * F.lit(100).cast("decimal(8,0)") >= _exact("a") * F.lit(percent).cast("decimal(8,0)")
    return candidates.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(contained, F.lit(False))).drop("longer")


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    top: int = TOP,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases = phrase_counts(docs, threshold, longest, shards, filter_bits, lang_col, text_col)
    kept = without_contained(scored(phrases))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = phrases.where(F.col("size") == 0).select("lang", F.col("count").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The collocations for DuckDB."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH pieces AS (
            SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
        ), places AS (
            SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM worded, range(1, {LONGEST + 1}) s(size)
        ), counted AS MATERIALIZED (
            SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
        ), candidates AS MATERIALIZED (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counted WHERE size > 1 AND f >= {THRESHOLD}
        ), cuts AS (
            SELECT c.*, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f)::HUGEINT)::BIGINT AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
            JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ')
            JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, array_to_string(words[i:i + short - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, size - short + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS short FROM candidates))
            GROUP BY ALL
        ), ranked AS (
            SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM lowest LEFT JOIN inside USING (lang, phrase)
            WHERE longer IS NULL OR 100::HUGEINT * longer < {CONTAINED_PERCENT}::HUGEINT * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
    """
