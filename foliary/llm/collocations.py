"""Phrase collocations: n-grams as rows, counted by language, scored in exact decimals.

Each task cuts its texts into pieces and words and makes the n-grams rows of
language, phrase and count, equal ones of a chunk of text as one; a hash
aggregation adds them up by language and phrase. It goes by number of words: a
phrase can be frequent only if what it is without its last and without its first
word is, so those of two words or more become rows if a bit table of frequent
phrases of one word less knows both. The table may know too much, never too
little, so no frequent phrase is lost and its count is exact.

Only phrases of `least` or more occurrences, and single words for their sum, are
written and go on: a part of a candidate occurs at least as often as it, so the
joins with counts of first and last parts lose nothing. A longer phrase that
holds a candidate has an extension of it by one word that occurs as often or
more, so an anti-join with candidates of one word more drops all that are held
by any.

Scale: rows are combined by chunk and by task before each shuffle, by language
and phrase, so neither a language nor a word is one task. The bit table has at
most 2^28 bits (32 MB) and goes through the driver; past some millions of
frequent phrases it passes more rows than need be. What follows works on frequent
phrases only; a language's first `top` are ranked from the first `top` of every
task. Within a chunk of text, equal 64-bit hashes count as equal.

Edge cases: null and empty texts and pieces without words have no phrases; a null
language is `und`, one with languages of that name. Repeated rows count again,
whatever their ids; columns besides lang and text are ignored. Ties of score go
by occurrences, then by the bytes of the phrase. A long text is a chunk by
itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

#: Bytes of text that a task takes at once.
CHUNK = 2 << 20
#: Bits of the table of frequent phrases: so many for each, and at most 2 to the power of MOST_BITS.
BITS_EACH = 32
MOST_BITS = 28

# What a byte is: a letter of a word, a blank between words, or an end of a piece; fixed values.
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_LETTER = ~_ENDS
_LETTER[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = ta.U64(0x9E3779B97F4A7C55)


class Words:
    """The words of texts, in a buffer in which each is followed by one blank."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        own = ta.from_arrow(pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
        letter = np.zeros(len(own.buf) + 1, bool)
        letter[1:] = _LETTER[own.buf]  # every text ends with the end of a piece, so no word does
        change = np.flatnonzero(letter[1:] != letter[:-1])
        starts, ends = change[::2], change[1::2]
        self.buf = np.where(letter[1:], _LOWER[own.buf], np.uint8(0x20))[letter[1:] | letter[:-1]]
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        #: Of each word the piece that it is in.
        self.piece = np.searchsorted(np.flatnonzero(_ENDS[own.buf]), starts)
        self.hash = ta.hash_runs(self.buf, self.starts, self.ends)
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, np.asarray(coded.indices, np.int64)[np.searchsorted(own.offsets, starts, "right") - 1]
        told = ta.from_arrow(self.langs)
        self.lang_hash = ta.hash_runs(told.buf, told.offsets[:-1], told.offsets[1:])[self.lang]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes, which count the language in, of all phrases of n words."""
        first = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)
        value = self.lang_hash[first]
        for i in range(n):
            value = value * _STEP + self.hash[first + i]
        return first, ta.mix64(value)

    def rows(self, n: int, first: np.ndarray, hashes: np.ndarray) -> pa.Table:
        """lang, phrase, f: a row for each distinct phrase of n words among those that begin at words `first`."""
        code = np.asarray(pa.array(hashes).dictionary_encode().indices)
        f = np.bincount(code)
        at = np.zeros(len(f), np.int64)
        at[code] = np.arange(len(code))  # any of its places stands for a phrase
        first = first[at]
        begin, size = self.starts[first], self.ends[first + n - 1] - self.starts[first]
        ends = np.cumsum(size)
        data = self.buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        phrase = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        return pa.table({"lang": self.langs.take(pa.array(self.lang[first])), "phrase": phrase.cast(pa.string()), "f": pa.array(f, pa.int64())})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of lang and text columns, in chunks of about CHUNK bytes of text."""
    held, size = [], 0
    for batch in batches:
        for begin, end in ta.slices(batch.column(1), CHUNK):
            part = batch.slice(begin, end - begin)
            own = int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
            if held and size + own > CHUNK:
                yield Words(*(pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (1, 0)))
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield Words(*(pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (1, 0)))


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> ta.U64(64 - (len(table).bit_length() + 5))
    return (table[(at >> ta.U64(6)).astype(np.int64)] >> (at & ta.U64(63))) & ta.U64(1) != 0


def counted(documents: DataFrame, n: int, table: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, f: how often each phrase of n words occurs in its language.

    With a `table` only phrases whose first and last parts of one word less it knows.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            first, hashes = words.phrases(n)
            if table is not None:
                shorter, own = words.phrases(n - 1)
                known = np.zeros(len(words.piece) + 1, bool)
                known[shorter[_known(table, own)]] = True
                kept = known[first] & known[first + 1]
                first, hashes = first[kept], hashes[kept]
            yield from words.rows(n, first, hashes).to_batches(1 << 16)

    cluster.bounded_batches(documents.sparkSession)
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(explode, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _table(frequent: DataFrame, n: int) -> np.ndarray | None:
    """A bit table of frequent phrases (lang, phrase) of n words, null if there are none."""
    many = frequent.count()
    if not many:
        return None
    bits = min(max((BITS_EACH * many - 1).bit_length(), 16), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            _, hashes = words.phrases(n)
            yield pa.RecordBatch.from_arrays([pa.array((hashes >> ta.U64(64 - bits)).astype(np.int64))], ["at"])

    cluster.bounded_batches(frequent.sparkSession)
    rows = frequent.select("lang", "phrase").mapInArrow(places, "at long")
    words = rows.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(words["i"])] = np.asarray(words["w"])
    return out.view(ta.U64)


def score(a: str, left: str, right: str) -> str:
    """1000000 a a / (left right), rounded down: an expression over longs that is exact in decimals of 38 digits, for counts below 10^16."""
    exact = lambda c: f"cast({c} as decimal(16,0))"
    return f"(cast(1000000 as decimal(7,0)) * ({exact(a)} * {exact(a)})) div ({exact(left)} * {exact(right)})"


def mine(documents: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `max_words` words.

    A phrase is dropped if a longer one that holds it occurs `share` percent as often or more.
    """
    kept = cluster.written(counted(documents, 1).withColumn("words", F.lit(1)))  # rare ones count for their language
    level = kept.where(F.col("f") >= least)
    for n in range(2, max_words + 1):
        table = _table(level, n - 1)
        if table is None:
            break
        level = cluster.written(counted(documents, n, table).withColumn("words", F.lit(n)).where(F.col("f") >= least))
        kept = kept.unionByName(level)
    of_lang = kept.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = kept.where(F.col("f") >= least)
    candidates = frequent.where("words > 1").withColumnRenamed("f", "a")
    # Every cut: the parts' counts, and the score in exact decimals.
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = candidates.withColumn("k", cut)
    parts = F.split("phrase", " ")
    cuts = cuts.withColumns({"head": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(score("a", "l", "r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    # Each phrase's longest parts: what it has without its last and without its first word.
    longer = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), F.expr("explode(array(substring_index(phrase, ' ', words - 1), substr(phrase, instr(phrase, ' ') + 1)))").alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(held, (scored.lang == held.lang) & (scored.phrase == held.phrase) & (100 * held.longer >= share * scored.a), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(of_lang), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
