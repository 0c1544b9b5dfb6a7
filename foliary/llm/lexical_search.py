"""Ranked lexical search over impact-ordered postings, score at a time.

A posting's impact is what its document's frequency and length make of a term,
(10^9 tf) div (1000 tf + 8 m), whatever the term's weight; the postings of a
shard are grouped by term and exact impact. An item takes the groups of all its
terms in descending order of what they add to a score. It stops once the sum of
what each term may still add proves that no document outside a candidate set can
be among the best, and completes the scores of that set from the documents' own
terms. Stopping never changes a result: all numbers are exact integers.

Items are taken in blocks of at most BLOCK_TERMS terms. For each block one pass
over the documents writes an index of the block's terms (for each document how
many terms it has, and the frequencies of those of the block) to the shared
folder, and a second takes shards of at most SHARD_POSTINGS postings from it and
sends on the best of each item in each task; only these meet in a shuffle.

Terms are compared by 64-bit hash.

Edge cases: null and empty texts and those without terms are no documents, and
items without terms get no rows. Rows that share a doc_id are documents of their
own; a null doc_id comes last among equals. Equal rows of items ask once; items
that share an id but not a text each get their rows, and a null id is one. A long
text is one document. Columns besides those named are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

#: Terms, repeats included, of a block of items; a longer item is a block of its own.
BLOCK_TERMS = 1 << 20
#: Postings and documents of a shard, at most.
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 14
#: Postings of the first round of an item; each further round takes twice as many.
FIRST_ROUND = 1 << 11
#: Candidates to complete; more of them go on with the postings.
COMPLETED = 256

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_hashes(texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and for each text the range of its own (n + 1 bounds)."""
    buf = _LOWER[texts.buf]
    starts, ends = ta.Texts(buf, texts.offsets).edges(_IS_TERM[buf])
    return ta.hash_runs(buf, starts, ends), np.searchsorted(starts, texts.offsets)


class Vocabulary:
    """The distinct terms of a block's items, told by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.filter = np.zeros(1 << 20, bool)  # most other terms are told apart here
        self.filter[(self.hashes >> ta.U64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of terms of the vocabulary, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> ta.U64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[number] == hashes[maybe]
        return maybe[same], number[same]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def _index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term: numbers of the vocabulary's terms in it, ascending, and their frequencies."""

    def of_batch(batch: pa.RecordBatch) -> pa.Table | None:
        parts = []
        for begin, end in ta.slices(batch.column(1)):
            hashes, bounds = term_hashes(ta.from_arrow(batch.column(1).slice(begin, end - begin)))
            n = np.diff(bounds)
            at, number = vocabulary.find(hashes)
            doc = np.searchsorted(bounds, at, "right") - 1
            key, tf = np.unique(doc * max(1, len(vocabulary)) + number, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(n) + 1) * max(1, len(vocabulary)))
            rows = pa.table({
                "doc_id": batch.column(0).slice(begin, end - begin).cast(pa.int64()), "n": pa.array(n, pa.int64()),
                "terms": _lists(key % max(1, len(vocabulary)), cuts, pa.int32()), "tfs": _lists(tf, cuts, pa.int32()),
            })
            parts.append(rows.filter(pa.array(n > 0)))
        return pa.concat_tables(parts) if parts else None

    return cluster.map_batches(docs.select(F.col("doc_id").cast("long"), cluster.text_or_empty().alias("text")), of_batch, "doc_id long, n long, terms array<int>, tfs array<int>")


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Of each term of the vocabulary how many documents hold it; tasks count their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    cluster.bounded_batches(index.sparkSession)
    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


class Shard:
    """Postings of some documents in two orders: by document, and by term and descending impact with the runs of equal impact."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, docs: int, words: int) -> None:
        m = 25 + (75 * n * docs) // words
        self.count, self.bounds, self.terms = len(n), bounds, terms
        of = np.repeat(np.arange(len(n)), np.diff(bounds))
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of])
        order = np.lexsort((-self.impact, terms))
        self.doc = of[order]
        term, impact = terms[order], self.impact[order]
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        #: Of each run of equal impact: its first posting (and one more bound), impact and term; and each term's first run.
        self.run = np.flatnonzero(np.append(new, True))
        self.run_impact = impact[self.run[:-1]]
        self.term_run = np.searchsorted(term[self.run[:-1]], np.arange(size + 1))

    def completed(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents from their own terms; `weight` is that of each term of the vocabulary, 0 for those the item lacks."""
        sizes = self.bounds[docs + 1] - self.bounds[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[docs] - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.impact[at])])
        return total[ends] - total[ends - sizes]

    def best(self, terms: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best of an item, and their scores, of those of score `least` or more; at least the k best of these with all their equals.

        `terms` and `weights` are the item's distinct terms and their weights times repeats.
        """
        first, last = self.term_run[terms], self.term_run[terms + 1]
        held = last > first
        first, last, weights = first[held], last[held], weights[held]
        runs = last - first
        if not len(runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.cumsum(runs) - runs
        which = np.repeat(np.arange(len(runs)), runs)
        run = np.arange(len(which)) + np.repeat(first - begins, runs)
        adds = weights[which] * self.run_impact[run]
        order = np.argsort(-adds, kind="stable")
        sizes = (self.run[run + 1] - self.run[run])[order]
        upto = np.cumsum(sizes)
        score = np.zeros(self.count, np.int64)
        taken = np.zeros(len(runs), np.int64)  # runs of each term
        at, round_size = 0, FIRST_ROUND
        while True:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + round_size, "right")))
            part = order[at:end]
            number = sizes[at:end]
            lengths = np.cumsum(number)
            places = np.arange(lengths[-1]) + np.repeat(self.run[run[part]] - (lengths - number), number)
            np.add.at(score, self.doc[places], np.repeat(adds[part], number))
            taken += np.bincount(which[part], minlength=len(runs))
            at, round_size = end, 2 * round_size
            if at >= len(order):
                found = np.flatnonzero(score >= max(least, 1))
                return found, score[found]
            # What each term may still add is its next run; runs of a term come in their order.
            left = taken < runs
            rest = int(adds[(begins + taken)[left]].sum())
            bound = max(least, 1, int(np.partition(score, -k)[-k]) if self.count >= k else 1)
            if rest < bound:
                may = np.flatnonzero(score + rest >= bound)
                if len(may) <= COMPLETED:
                    exact = self.completed(may, weight)
                    kept = exact >= max(least, 1)
                    return may[kept], exact[kept]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_ids, n, bounds, terms, tfs of rows put together up to the size of a shard; a document of more postings is one by itself."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def together() -> tuple:
        of = lambda i: pa.chunked_array([b.column(i) for b in held])
        lists = of(2).combine_chunks()
        bounds = np.asarray(lists.offsets, np.int64)
        return of(0), np.asarray(of(1), np.int64), bounds - bounds[0], np.asarray(lists.flatten(), np.int64), np.asarray(of(3).combine_chunks().flatten(), np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        own = len(batch.column(2).flatten())
        if held and (size + own > SHARD_POSTINGS or rows + batch.num_rows > SHARD_DOCS):
            yield together()
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + own, rows + batch.num_rows
    if held:
        yield together()


def _ordered(score: np.ndarray, doc_id: pa.Array, k: int) -> np.ndarray:
    """Places of the k best: by descending score, then ascending doc_id, null last."""
    missing = np.asarray(doc_id.is_null())
    return np.lexsort((np.asarray(doc_id.fill_null(0)), missing, -score))[:k]


def _search(index: DataFrame, items: list[np.ndarray], size: int, weights: np.ndarray, docs: int, words: int, k: int) -> DataFrame:
    """number (of the item), doc_id, score: the k best of each item in each task; `items` are numbers of terms, with repeats, and `weights` the terms' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [np.unique(x, return_counts=True) for x in items]
        best: dict[int, tuple[np.ndarray, pa.Array]] = {}
        weight = np.zeros(size, np.int64)
        for doc_ids, n, bounds, terms, tfs in _shards(batches):
            shard = Shard(n, bounds, terms, tfs, size, docs, words)
            doc_ids = doc_ids.combine_chunks()
            for number, (own, repeats) in enumerate(asked):
                known = best.get(number)
                least = int(known[0][-1]) if known and len(known[0]) == k else 1
                weight[own] = weights[own] * repeats
                found, score = shard.best(own, weight[own], weight, k, least)
                weight[own] = 0
                if len(found):
                    ids = doc_ids.take(pa.array(found))
                    if known:
                        score, ids = np.concatenate([known[0], score]), pa.concat_arrays([known[1], ids])
                    kept = _ordered(score, ids, k)
                    best[number] = score[kept], ids.take(pa.array(kept))
        for number, (score, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), ids, pa.array(score)], ["number", "doc_id", "score"])

    cluster.bounded_batches(index.sparkSession)
    return index.mapInArrow(run, "number long, doc_id long, score long")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """item_ids, and hashes of the terms of each item, in blocks of at most BLOCK_TERMS terms; rows come to the driver one partition at a time."""
    ids, terms, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        hashes, _ = term_hashes(ta.from_strings([r.text]))
        if not len(hashes):
            continue
        if terms and size + len(hashes) > BLOCK_TERMS:
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(r.item_id)
        terms.append(hashes)
        size += len(hashes)
    if terms:
        yield ids, terms


def rank(documents: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, by descending score, then ascending doc_id.

    `documents` has doc_id and text, `benchmark` item_id and text.
    """
    spark, parts = documents.sparkSession, []
    for ids, terms in _blocks(benchmark):
        vocabulary = Vocabulary(np.concatenate(terms))
        index = cluster.written(_index(documents, vocabulary))
        docs, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not docs:
            break
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in _frequencies(index, len(vocabulary)).tolist()], np.int64)
        found = _search(index, [np.searchsorted(vocabulary.hashes, t) for t in terms], len(vocabulary), weights, docs, words, k)
        best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), "number long, item_id long")  # of one block
        parts.append(found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
